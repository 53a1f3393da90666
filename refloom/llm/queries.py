"""The queries of the corpus operators over the tables of a folder, and their SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.bpe import encoded, public_vocabulary
from refloom.llm.common import table
from refloom.llm.decontam import contamination
from refloom.llm.quality import fit as fit_quality
from refloom.llm.quality import judged
from refloom.llm.secrets import found_secrets
from refloom.llm.rollups import Rollup, counted, deletes, inserts, revisions
from refloom.llm.simhash import near_duplicate_classes
from refloom.llm.substrings import repeat_digests
from refloom.llm.toxicity import fit, scored
from refloom.llm.urls import judged_urls
from refloom.llm.warc import archive_folder, read_archives, with_referred, write_archives
from refloom.session import scratch, written


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, from archives that were written and read again."""
    to = archive_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), to)
    found = with_referred(read_archives(spark, to))
    page = F.regexp_extract("refers_to", r"<urn:page:(.*)>", 1)
    return found.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", page).cast("long").alias("refers_to"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay when spans of smaller documents are removed."""
    return repeat_digests(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, likelihood ratio and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", F.round("score", 4).alias("score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return found_secrets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the lexicon is fitted on the labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(-1))  # a null id is in no fold
    lexicon = fit(docs, labels.where(fold > 0))
    return scored(docs, lexicon).select(
        "doc_id",
        (fold == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    found = judged_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_vocabulary(spark), keep_ids=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches: all documents come, counted by
    one tokenizer; they come as counted by a second one; those of low quality leave; toxic ones move from
    the first tokenizer to the second's counts. The second batch is sent twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counts = written(counted(docs, "space-1", "letter-2"), "counts")
    first, second = (counts.where(F.col("version") == v) for v in ("space-1", "letter-2"))
    marked = written(counts.join(marks, F.col("id") == F.col("doc_id")).drop("doc_id"), "marked")
    toxic = marked.where("quality != 0 AND toxic = 1")
    store = Rollup(spark, scratch(spark, "rollup"))
    store.commit("load", inserts(first))
    for _ in range(2):
        store.commit("load-2", inserts(second))
    store.commit("junk", deletes(marked.where("quality = 0")))
    store.commit("revised", revisions(toxic.where("version = 'space-1'"), toxic.where("version = 'letter-2'")))
    return store.totals()


QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_urls": op8_urls,
    "op9_bpe": op9_bpe,
    "op10_token_counts": op10_token_counts,
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_LETTERS = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^\x00-\x7F]+'))"

ORACLE: dict[str, str] = {
    "op10_token_counts": f"""
        WITH marks AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        counts AS (
            SELECT d.doc_id, source, lang, {_WORDS} AS words, {_LETTERS} AS letters, quality, toxic
            FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
        changes AS (
            SELECT source, lang, 'space-1' AS version, 1 AS docs, words AS tokens FROM counts
            UNION ALL SELECT source, lang, 'letter-2', 1, letters FROM counts
            UNION ALL SELECT source, lang, 'space-1', -1, -words FROM counts WHERE quality = 0
            UNION ALL SELECT source, lang, 'letter-2', -1, -letters FROM counts WHERE quality = 0
            UNION ALL SELECT source, lang, 'space-1', -1, -words FROM counts WHERE quality != 0 AND toxic = 1
            UNION ALL SELECT source, lang, 'letter-2', 1, letters FROM counts WHERE quality != 0 AND toxic = 1)
        SELECT source, lang, version, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM changes GROUP BY source, lang, version HAVING sum(docs) != 0 OR sum(tokens) != 0""",
}
