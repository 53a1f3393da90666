"""Benchmark passages in training texts, found by winnowing.

Words are hashed to 64 bits. A window is GRAM consecutive words of an item, or the whole item if it
has fewer. Of every run of SPAN consecutive k-grams (K words each) of a text the smallest hash is kept,
the rightmost of equals; K + SPAN - 1 = GRAM, so a window that occurs in both texts has a kept k-gram at
the same place in both. Kept k-grams of documents are matched with those of the benchmark; the windows
around each match are then compared as a whole, by their own hashes, which extends the hits exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import least_places, sized, with_row_key
from refloom.session import ship, written

GRAM = 10
K = 5
SPAN = GRAM - K + 1
#: Up to so many kept k-grams of the benchmark are sent to every task; more are joined by a shuffle.
SENT_GRAMS = 2_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Word hashes that a worker remembers (some 30 MB); then it starts anew.
REMEMBERED = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Of the words of a text: runs of letters, digits and anything beyond ASCII, A-Z lower-cased."""
    words = _WORD.findall(text.encode().lower()) if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, by their order; scattered over 64 bits."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= _BASE
        out += words[i : i + m]
    out += np.uint64(n)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def benchmark_windows(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(id, size, window, gram): every window of every item with one kept k-gram inside it; of an item
    of fewer than GRAM words the k-gram is the whole item. Items without a word have none."""
    spark = items.sparkSession
    schema = f"id {items.schema[id].dataType.simpleString()}, size int, window bigint, gram bigint"

    def run(batches):
        for b in batches:
            ids, sizes, windows, grams = [], [], [], []
            for i, x in zip(b.column(id), b.column(text), strict=True):
                w = word_hashes(x.as_py())
                if len(w) == 0:
                    continue
                size = min(GRAM, len(w))
                own = gram_hashes(w, size)
                if size < GRAM:
                    inside = own
                else:
                    g = gram_hashes(w, K)
                    inside = g[least_places(g, SPAN)]
                ids += [i.as_py()] * len(own)
                sizes += [size] * len(own)
                windows.append(own)
                grams.append(inside)
            none = np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, b.schema.field(id).type),
                    pa.array(sizes, pa.int32()),
                    _signed(np.concatenate([none, *windows])),
                    _signed(np.concatenate([none, *grams])),
                ],
                ["id", "size", "window", "gram"],
            )

    ship(spark)
    return items.select(id, text).mapInArrow(run, schema).distinct()


def _document_windows(docs: DataFrame, text: str, short: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(_rk, n_words, gram, places, sizes, windows): of each row of docs (_rk, text) a row with its
    number of words, and for each kept k-gram a row with the windows that hold it. wanted: only
    k-grams of this sorted array."""

    def run(batches):
        for b in batches:
            key, count, gram, places, sizes, windows = [], [], [], [], [], []
            for rk, x in zip(b.column("_rk").to_pylist(), b.column(text), strict=True):
                w = word_hashes(x.as_py())
                key.append(rk)
                count.append(len(w))
                gram.append(None)
                places.append([])
                sizes.append([])
                windows.append([])
                for size in [*short, GRAM]:
                    if len(w) < size:
                        continue
                    own = gram_hashes(w, size)
                    g, at, span = (own, np.arange(len(own)), 1) if size < GRAM else (gram_hashes(w, K), None, SPAN)
                    if at is None:
                        at = np.unique(least_places(g, SPAN))
                    if wanted is not None:
                        at = at[_among(g[at], wanted)]
                    for p in at.tolist():
                        q = np.arange(max(0, p - span + 1), min(p + 1, len(own)))
                        key.append(rk)
                        count.append(None)
                        gram.append(int(g[p : p + 1].view(np.int64)[0]))
                        places.append(q.astype(np.int32))
                        sizes.append(np.full(len(q), size, np.int32))
                        windows.append(own[q].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key, pa.binary()),
                    pa.array(count, pa.int64()),
                    pa.array(gram, pa.int64()),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(sizes, pa.list_(pa.int32())),
                    pa.array(windows, pa.list_(pa.int64())),
                ],
                ["_rk", "n_words", "gram", "places", "sizes", "windows"],
            )

    schema = "_rk binary, n_words bigint, gram bigint, places array<int>, sizes array<int>, windows array<bigint>"
    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if len(wanted) == 0:
        return np.zeros(len(hashes), bool)
    return wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes


def _covered(spans: Column) -> Column:
    """Words in a union of (place, size), sorted by place."""
    start = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"))

    def add(a, x):
        stop = F.greatest(a["stop"], (x["place"] + x["size"]).cast("long"))
        return F.struct(stop.alias("stop"), (a["n"] + stop - F.greatest(a["stop"], x["place"].cast("long"))).alias("n"))

    return F.aggregate(spans, start, add, lambda a: a["n"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    sent_grams: int = SENT_GRAMS,
) -> DataFrame:
    """(id, _rk, n_words, n_hit, items): of every row of docs its words, those inside an occurrence of
    a window of the benchmark, and the sorted distinct ids (as strings) of the items with such windows.

    Null texts have no words; an item without words has no window; repeated items count once by their
    id, items with a null id are left out of items but their words are hit. Repeated rows of docs are
    returned as often as they occur. Empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    bench = written(benchmark_windows(items, item_id, text), "windows")
    short = sorted(r[0] for r in bench.where(F.col("size") < GRAM).select("size").distinct().collect())  # 9 at most
    grams = bench.select("gram").distinct()
    few = grams.limit(sent_grams + 1).count() <= sent_grams
    wanted = np.sort(grams.toArrow()["gram"].to_numpy().view(np.uint64)) if few else None
    own = with_row_key(docs.select(id, text), id, text)
    found = written(_document_windows(own.select("_rk", text), text, short, wanted), "candidates")
    counts = found.where("gram IS NULL").select("_rk", "n_words").distinct()
    near = found.where("gram IS NOT NULL")
    if not few:
        near = near.join(grams, "gram", "left_semi")
    place = F.arrays_zip(F.col("places").alias("place"), F.col("sizes").alias("size"), F.col("windows").alias("window"))
    whole = near.select("_rk", F.inline(place).alias("place", "size", "window")).distinct()
    # sent around if small; else both sides are dealt anew, so that a window of many documents can be split
    hits = whole.join(sized(written(bench.select("id", "size", "window").distinct(), "item-windows")), ["size", "window"])
    hit = hits.groupBy("_rk").agg(
        _covered(F.array_sort(F.collect_set(F.struct("place", "size")))).alias("n_hit"),
        F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("items"),
    )
    return (
        own.select(id, "_rk")
        .join(counts, "_rk")
        .join(hit, "_rk", "left")
        .select(
            id,
            "_rk",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
