"""SimHash fingerprints of word shingles, and the classes of documents whose fingerprints are close.

Pigeonhole: a fingerprint of 64 bits is cut into four blocks of 16. Two fingerprints that differ in
at most two bits agree in at least two whole blocks, so they meet in one of the six tables keyed by a
pair of blocks; a join on these keys proposes pairs, and the Hamming distance decides.

A key that more than MOST_IN_BLOCK fingerprints share would propose a square of pairs. Its members go
another exact way: each is sent to itself and its 64 one-bit neighbours. Two fingerprints at distance
two or less have such a neighbour in common, at most 65 fingerprints can meet there, and all that meet
are at distance two or less, so linking them to the smallest one keeps every class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import with_row_key, without
from refloom.llm.components import connected_components
from refloom.session import ship, written

SEED = 42
BLOCKS = 4
MOST_IN_BLOCK = 64
#: Shingles whose bits are counted at once, which bounds the memory for a very long text.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles (repeats
    count). A text of fewer words is one shingle; no word at all gives zero. A-Z are lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        part = words[at : at + AT_ONCE + width - 1]
        runs = zip(*(part[i:] for i in range(width)), strict=False) if len(words) >= width else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """docs with its text column replaced by ``fp``, the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for b in batches:
            own = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(text)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(own.view(np.int64))], [*rest, "fp"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)


def close_links(fps: DataFrame, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) at two or fewer differing bits.

    Those of crowded blocks are stars, so not every close pair has a row of its own, but any two
    fingerprints that close pairs connect stay connected.
    """
    tables = [
        F.struct(F.lit(k).alias("t"), F.shiftleft(_block(i), 16).bitwiseOR(_block(j)).alias("key"))
        for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    keyed = fps.select("fp", F.inline(F.array(*tables)))
    crowd = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(crowd, ["t", "key"]), "blocks")

    few = met.where(F.col("n") <= most_in_block).select("t", "key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "u")
        .join(few.withColumnRenamed("fp", "v"), ["t", "key"])
        .where((F.col("u") > F.col("v")) & (_distance("u", "v") <= 2))
        .select("u", "v")
    )
    one_off = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    near = (
        met.where(F.col("n") > most_in_block)
        .select("fp")
        .distinct()
        .select("fp", F.explode(one_off).alias("at"))
        .groupBy("at")
        .agg(F.min("fp").alias("v"), F.collect_set("fp").alias("us"))  # 65 at most
        .where(F.size("us") > 1)
        .select(F.explode("us").alias("u"), "v")
        .where("u != v")
    )
    return pairs.union(near).distinct()


def near_duplicate_classes(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, most_in_block: int = MOST_IN_BLOCK
) -> DataFrame:
    """(id, _rk, fp, root, component): the fingerprint of every row of docs, and the smallest fingerprint
    and id that it reaches over fingerprints differing in two or fewer bits.

    Null texts count as empty. Rows with a null id belong to classes, but a class is named by its
    smallest id that isn't null (null if it has none). Repeated rows are returned as often as they
    occur. Other columns are ignored; an empty table gives an empty result.
    """
    own = with_row_key(docs.select(id, text), id, text)
    rows = written(fingerprints(own, text, width), "fingerprints")
    kinds = written(rows.groupBy("fp").agg(F.min(id).alias("least")), "kinds")
    roots = written(connected_components(close_links(kinds.select("fp"), most_in_block)), "roots")
    linked = kinds.join(roots, kinds.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(linked.join(named, "root").select("fp", "root", "component"), "fp")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest id (ids before nulls,
    equal ids by the hash of the row), of equal rows one."""
    classes = written(near_duplicate_classes(docs, id, text, width), "classes")
    rank = F.struct(F.col(id).isNull().alias("a"), F.col(id).alias("b"), F.col("_rk").alias("c"))
    best = classes.groupBy("root").agg(F.min(rank)["c"].alias("best"))
    beside = classes.join(best, "root")
    losers = written(beside.where("_rk != best").select("_rk").distinct(), "losers")
    once = classes.groupBy("_rk").count().where("count > 1").limit(1).count() > 0
    return without(docs, losers, id, text, once=once)
