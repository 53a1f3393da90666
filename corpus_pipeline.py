"""A corpus pipeline of five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.bpe import encoded, public_vocabulary
from refloom.llm.common import table, without
from refloom.llm.decontam import contamination
from refloom.llm.quality import fit, judged
from refloom.llm.secrets import redacted
from refloom.llm.similar import without_near_duplicates
from refloom.session import passing, remove, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, blank and short texts, repetitive ones, and those whose
    log ratio is too low. Every row is judged by its text alone, however long, repeated rows alike."""
    packed = docs.select(F.struct("*").alias("row"), "text")  # so that no column's name clashes with a count's
    found = judged(packed, fit(docs, table(spark, sf_dir, "labels")))
    return found.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays: close fingerprints (SimHash of words in fives),
    or a share of 0.8 of such shingles. The smallest id stays, of equal rows one; null ids come last. Texts
    without a word are one class."""
    return without_near_duplicates(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, repeated rows alike. Null and empty texts hold none,
    nor do items without a word."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    losers = written(found.where("n_hit > 0").select("_rk").distinct(), "contaminated")
    return without(docs, losers, "doc_id", "text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars, if there is such a column, follows the text. Null texts stay null."""
    masked = redacted(docs)
    if "n_chars" not in docs.columns:
        return masked
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number and digests; the text goes. Null texts have none. Columns of the
    new names (n_tokens, ids_sha256, decoded_sha256, ids) are replaced, all others stay."""
    return encoded(docs, public_vocabulary(spark))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. Only the last stage's table is left in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with passing(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(found.schema).parquet(path), path
    return docs


#: Hashed n-grams, SimHash and byte-pair encoding are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
