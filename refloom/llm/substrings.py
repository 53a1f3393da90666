"""Long word spans that repeat across documents, by compaction of a de Bruijn graph.

The graph's edges are the windows of WINDOW consecutive words, its nodes what neighbouring windows share.
It is never laid out window by window: each window belongs to its least K-gram (its minimizer), and the
consecutive windows of a text with the same minimizer form one piece, an already compacted path. Only
pieces whose minimizer occurs in two documents are looked at further:

* pieces of equal content are one edge of the graph, known by a hash of all their words;
* where a minimizer has pieces of different content, the graph branches inside them: in the first
  document of each content they are split into single windows.

An edge that another one follows in all its occurrences, and that precedes it in all of its own, is joined
with it; such nonbranching paths are found by joining edges with their neighbours, and are read off by
their coordinates in each source. At last the words at the coordinates are hashed with 128 bits: an
occurrence counts if a document with a smaller id has the same words there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import least_places, sized
from refloom.session import ship, written

WINDOW = 50
#: Words of a minimizer. A window has WINDOW - K + 1 of them, so about one in (WINDOW - K + 2) / 2 is kept.
K = 12
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A row: its id, and 64 bits of its id and text. Only rows of one id could share them by chance.
ROW = ["_rk", "id"]
#: Word hashes that a worker remembers (some 30 MB); then it starts anew.
REMEMBERED = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but ASCII white space."""
    return text.encode().split() if text else []


class Spans:
    """Hashes of any spans of a word list, from sums of powers."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
        powers = np.full(n + 1, _BASE, np.uint64)
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        powers[0] = inverse[0] = 1
        np.cumprod(powers, out=powers)
        self.inverse = np.cumprod(inverse, out=inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, stop: np.ndarray | slice, size) -> np.ndarray:
        out = (self.sums[stop] - self.sums[start]) * self.inverse[start] + np.asarray(size, np.uint64)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))

    def every(self, size: int) -> np.ndarray:
        """Of all spans of a size, by their start."""
        n = len(self.sums) - size
        return self(slice(0, max(n, 0)), slice(size, None), size) if n > 0 else np.zeros(0, np.uint64)


def pieces_of(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, ...]:
    """(minimizer, content, start, windows) of the runs of windows that share their minimizer."""
    none = np.zeros(0, np.uint64)
    if len(words) < window:
        return none, none, none.astype(np.int32), none.astype(np.int32)
    spans = Spans(words)
    grams = spans.every(k)
    at = least_places(grams, window - k + 1)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(start, len(at)))
    stop = start + count + window - 1
    return grams[at[start]], spans(start, stop, stop - start), start.astype(np.int32), count.astype(np.int32)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _pieces(docs: DataFrame, id: str, text: str, window: int, k: int) -> DataFrame:
    """Of each row of docs (_rk, id, text) a row with n_words and sha (of all its words), and a row for each
    piece: minimizer, content, start, windows."""
    schema = T.StructType([T.StructField("_rk", T.LongType()), docs.schema[id]]).add("n_words", "long").add("sha", "binary")
    schema = schema.add("minimizer", "long").add("content", "long").add("start", "integer").add("windows", "integer")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sizes, n, sha, found = [], [], [], []
                for x in part.column(text):
                    words = words_of(x.as_py())
                    own = pieces_of(words, window, k)
                    sizes.append(len(own[0]))
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).digest())
                    found.append(own)
                m, c, s, w = (np.concatenate(x) for x in zip(*found, strict=True))
                at, total = np.repeat(np.arange(part.num_rows), sizes), sum(sizes)
                rows = pa.array(np.concatenate([np.arange(part.num_rows), at]))
                doc = lambda v, t: pa.concat_arrays([pa.array(v, t), pa.nulls(total, t)])
                piece = lambda v: pa.concat_arrays([pa.nulls(part.num_rows, v.type), v])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_rk").take(rows), part.column(id).take(rows), doc(n, pa.int64()), doc(sha, pa.binary())]
                    + [piece(_signed(m)), piece(_signed(c)), piece(pa.array(s)), piece(pa.array(w))],
                    schema.names,
                )

    ship(docs.sparkSession)
    return docs.select("_rk", id, text).mapInArrow(run, schema)


def _texts_with(docs: DataFrame, lists: DataFrame, text: str) -> DataFrame:
    """docs (_rk, id, text) with the list of their row in lists (a written table); others are left out before
    anything is shuffled if the lists are few."""
    return docs.select(*ROW, text).join(sized(lists.select(*ROW)), ROW, "left_semi").join(lists, ROW)


def _windows(docs: DataFrame, lists: DataFrame, text: str, window: int) -> DataFrame:
    """(_rk, id, edge, start) of the single windows of listed pieces (_rk, id, pieces)."""
    schema = T.StructType([docs.schema["_rk"], T.StructField("id", lists.schema["id"].dataType)]).add("edge", "long").add("start", "integer")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                at = [np.arange(p["start"], p["start"] + p["windows"]) for p in b.column("pieces")[i].as_py()]
                at = np.concatenate(at).astype(np.int32)
                edge = Spans(words_of(b.column(text)[i].as_py()))(at, at + window, window)
                rows = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [b.column("_rk").take(rows), b.column("id").take(rows), _signed(edge), pa.array(at)], schema.names
                )

    return _texts_with(docs, lists, text).select("_rk", "id", "pieces", text).mapInArrow(run, schema)


def _paths(edges: DataFrame) -> DataFrame:
    """(_rk, id, path, start, windows): occurrences of compacted paths from those of edges (_rk, id, edge,
    start, windows). A path is named by its first edge."""
    along = Window.partitionBy(*ROW).orderBy("start")
    adjoins = F.lead("start").over(along) == F.col("start") + F.col("windows")
    follows = F.lag(F.col("start") + F.col("windows")).over(along) == F.col("start")
    near = edges.withColumns(
        {"after": F.when(adjoins, F.lead("edge").over(along)), "before": F.when(follows, F.lag("edge").over(along))}
    )
    near = written(near, "neighbours")

    def only(c: str) -> Column:
        return F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))

    nodes = written(near.groupBy("edge").agg(only("after").alias("after"), only("before").alias("before")), "nodes")
    ahead = nodes.where("after IS NOT NULL").select(F.col("edge").alias("before"), F.col("after").alias("edge"))
    joined = nodes.select("edge", "before").where("before IS NOT NULL").join(ahead, ["edge", "before"], "left_semi")
    told = near.join(joined.select("edge", F.lit(True).alias("joined")), "edge", "left")
    begins = F.col("joined").isNull()
    told = told.withColumn("part", F.sum(begins.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy("_rk", "id", "part").agg(
        F.min_by("edge", "start").alias("path"), F.min("start").alias("start"), F.sum("windows").cast("int").alias("windows")
    )


def _checked(docs: DataFrame, lists: DataFrame, text: str, window: int) -> DataFrame:
    """(_rk, id, path, start, stop, words): the listed occurrences (_rk, id, spans) with a 128-bit hash of the
    words that stand there."""
    schema = T.StructType([docs.schema["_rk"], T.StructField("id", lists.schema["id"].dataType)])
    schema = schema.add("path", "long").add("start", "integer").add("stop", "integer").add("words", "binary")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, rows = words_of(b.column(text)[i].as_py()), []
                for s in b.column("spans")[i].as_py():
                    stop = s["start"] + s["windows"] + window - 1
                    rows.append((s["path"], s["start"], stop, xxhash.xxh3_128_digest(b" ".join(words[s["start"] : stop]))))
                at = pa.array(np.full(len(rows), i))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("_rk").take(at), b.column("id").take(at), *columns], schema.names)

    return _texts_with(docs, lists, text).select("_rk", "id", "spans", text).mapInArrow(run, schema)


def _found(own: DataFrame, pieces: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(_rk, id, path, start, stop, repeats): verified occurrences of paths that are in two documents or
    more; repeats tells those for which a smaller id has the same words."""
    p = pieces.where(F.col("minimizer").isNotNull() & F.col(id).isNotNull())
    p = p.select("_rk", F.col(id).alias("id"), "minimizer", "content", "start", "windows")
    heads = p.groupBy("minimizer").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), (F.min("content") != F.max("content")).alias("branches")
    )
    heads = written(heads.where("a != b").select("minimizer", "branches"), "minimizers")
    shared = written(p.join(sized(heads), "minimizer"), "shared")
    # written, so that the join deals both sides anew and a content of many copies can be split
    contents = written(shared.groupBy("content").agg(F.min("id").alias("first"), F.max("id").alias("last")), "contents")
    shared = written(shared.join(contents, "content"), "occurrences")
    whole = shared.where("first != last").select("_rk", "id", F.col("content").alias("edge"), "start", "windows").distinct()

    split = shared.where("branches AND id = first").groupBy("_rk", "id")
    split = written(split.agg(F.collect_set(F.struct("start", "windows")).alias("pieces")), "branching")
    single = written(_windows(own, split, text, window), "windows")
    again = single.groupBy("edge").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("edge")
    single = single.join(written(again, "edges"), "edge").select("_rk", "id", "edge", "start", F.lit(1).alias("windows")).distinct()

    paths = _paths(whole).union(_paths(single)).groupBy("_rk", "id")
    lists = written(paths.agg(F.collect_set(F.struct("path", "start", "windows")).alias("spans")), "paths")
    checked = written(_checked(own, lists, text, window), "checked")
    least = checked.groupBy("path", "words").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b")
    told = checked.join(written(least, "verified"), ["path", "words"])
    return written(told.select("_rk", "id", "path", "start", "stop", (F.col("id") > F.col("a")).alias("repeats")), "spans")


def _cut(docs: DataFrame, spans: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """(_rk, id, n_removed, sha, text): of the rows with repeating spans the number of words inside them, the
    hash of the other words joined by a space and, if asked for, these."""
    lists = spans.where("repeats").groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    lists = written(lists, "removed")

    def run(batches):
        for b in batches:
            n, sha, kept = [], [], []
            for x, own in zip(b.column(text), b.column("spans").to_pylist(), strict=True):
                words = words_of(x.as_py())
                gone = np.zeros(len(words) + 1, np.int64)
                for s in own:
                    gone[s["start"]] += 1
                    gone[s["stop"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                rest = b" ".join(words[i] for i in np.flatnonzero(~gone).tolist())
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(rest).digest())
                kept.append(rest.decode() if keep_text else None)
            columns = [pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("_rk"), b.column("id"), *columns], schema.names)

    schema = T.StructType([docs.schema[c] for c in ROW]).add("n_removed", "long").add("sha", "binary").add("text", "string")
    found = _texts_with(docs, lists, text).select(*ROW, text, "spans")
    return written(found.mapInArrow(run, schema), "cut").dropDuplicates(ROW)


def _prepared(docs: DataFrame, id: str, text: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(id, text).alias("_rk"))
    return own, written(_pieces(own, "id", "text", window, k), "pieces")


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, path, start, stop, repeats): where paths of windows that two documents or more share stand, in
    words; the same path number means the same words. repeats: a smaller id has them too."""
    own, pieces = _prepared(docs, id, text, window, k)
    return _found(own, pieces, "id", "text", window).select(F.col("id").alias(id), "path", "start", "stop", "repeats").distinct()


def repeat_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row: words covered by a window whose words also start
    in a row with a smaller id are removed; the hash is that of the others, joined by a space.

    Null and blank texts have no word; texts of fewer words than a window lose none. Rows with a null id
    are left whole and take nothing from others; of rows with the same id neither is the smaller one.
    Repeated rows give repeated results, further columns are ignored, an empty table stays empty.
    """
    own, pieces = _prepared(docs, id, text, window, k)
    cut = _cut(own, _found(own, pieces, "id", "text", window), "text", False)
    every = pieces.where("minimizer IS NULL").select(*ROW, "n_words", F.col("sha").alias("all"))
    return every.join(sized(cut.select(*ROW, "n_removed", "sha")), ROW, "left").select(
        F.col("id").alias(id),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.lower(F.hex(F.coalesce("sha", "all"))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with the repeating words of their texts removed; what is left of such a text is joined by single
    spaces, other texts stay as they are. Rows as in repeat_digests."""
    own, pieces = _prepared(docs, id, text, window, k)
    cut = _cut(own, _found(own, pieces, "id", "text", window), "text", True).select(*ROW, F.col("text").alias("left"))
    packed = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"), F.xxhash64(id, text).alias("_rk"))
    joined = packed.join(cut, ROW, "left")
    return joined.select(*(F.coalesce("left", f"row.{text}").alias(text) if c == text else f"row.`{c}`" for c in docs.columns))
