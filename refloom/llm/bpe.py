"""Byte-level BPE encoding and decoding with a given rank file.

Two tiers. A minimal perfect hash (hash and displace) maps every token of the vocabulary to a slot of
its own; a pre-token that is in the vocabulary as a whole is resolved there. Any other pre-token is
merged byte by byte: its bytes form a linked list, a heap holds the adjacent pairs by rank and place,
and the lowest pair is merged until none is in the vocabulary. Results per pre-token are remembered
within a Python worker, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from refloom.session import ship

#: Pre-tokens that a worker remembers (some 40 MB); then it starts anew.
REMEMBERED = 200_000
#: Longer pre-tokens aren't remembered.
LONGEST_REMEMBERED = 64
_MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: as many slots as strings, none shared.

    Strings are dealt into buckets of about two by a 64-bit hash. From the fullest bucket on, a
    displacement is searched that sends its strings to free slots; a string alone in its bucket gets
    a free slot outright, written as -1 - slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots = np.full(self.n, -1, np.int64)  # slot -> place in keys
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        if len(set(hashes)) < self.n:
            raise ValueError("repeated keys")
        members: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            members.setdefault(h % self.buckets, []).append(i)
        free = 0
        for b, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                while self.slots[free] >= 0:
                    free += 1
                self.slots[free], self.shift[b] = own[0], -1 - free
                continue
            d = 0
            while True:
                at = [self._slot(hashes[i], d) for i in own]
                if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.slots[at], self.shift[b] = own, d

    def _slot(self, h: int, d: int) -> int:
        x = (h + d * 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x ^ (x >> 31)) % self.n

    def place(self, key: bytes) -> int:
        """The place that key has in the list if it is there; else that of some other key."""
        h = xxhash.xxh64_intdigest(key)
        d = int(self.shift[h % self.buckets])
        return int(self.slots[-1 - d if d < 0 else self._slot(h, d)])


class Vocabulary:
    """Tokens by rank, with the pattern that splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.ranks = ranks
        self.by_rank = {r: t for t, r in ranks.items()}
        self.keys = list(ranks)
        self.whole = PerfectHash(self.keys)
        self._memo: dict[str, bytes] | None = None

    @classmethod
    def from_tiktoken(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a base64 token and its rank on each line."""
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    def token(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not piece:
            return []
        found = self.keys[self.whole.place(piece)]
        return [self.ranks[found]] if found == piece else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Ids by merging adjacent parts, the lowest rank first and the leftmost of equals."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # end of the part that begins here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # a part of this pair has been merged since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := rank(piece[j:stop])) is not None:
                heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self._memo is None or len(self._memo) > REMEMBERED:
            self._memo = _Memo(self)
            self._split = regex.compile(self.pattern)
        # finditer would hold less, findall is several times faster; a text fits in a row anyway
        return np.frombuffer(b"".join(map(self._memo.__getitem__, self._split.findall(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_rank.__getitem__, ids.tolist()))


class _Memo(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.of = vocabulary.token

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.of(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            self[piece] = ids
        return ids


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs, its text replaced by n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Null texts count as empty: no token, the hashes of no bytes. Rows stay as they are, repeated ones
    too; a column of docs with one of the new names is replaced. The vocabulary (bounded by its file)
    is broadcast; the text is never shuffled.
    """
    spark = docs.sparkSession
    new = [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
        *([T.StructField("ids", T.ArrayType(T.LongType(), False), False)] if keep_ids else []),
    ]
    names = [f.name for f in new]
    rest = [c for c in docs.columns if c != text and c not in names]
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        for b in batches:
            rows = []
            for x in b.column(text):
                ids = v.encode(x.as_py() or "")
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(ids.tobytes()).hexdigest(),
                        hashlib.sha256(v.decode(ids)).hexdigest(),
                        *([ids.astype(np.int64)] if keep_ids else []),
                    )
                )
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *columns], [*rest, *names])

    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())][: len(new)]
    ship(spark)
    return docs.select(*rest, text).mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest), *new]))


def decoded(ids: DataFrame, vocabulary: Vocabulary, column: str = "ids", to: str = "text") -> DataFrame:
    """ids with the text (bytes that aren't UTF-8 replaced) of each id list in place of the list; null
    lists give null."""
    rest = [c for c in ids.columns if c not in (column, to)]
    schema = T.StructType([*(ids.schema[c] for c in rest), T.StructField(to, T.StringType())])
    shared = ids.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        for b in batches:
            texts = [
                None if x.as_py() is None else v.decode(np.array(x.as_py(), np.int64)).decode("utf-8", "replace")
                for x in b.column(column)
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, to])

    ship(ids.sparkSession)
    return ids.select(*rest, column).mapInArrow(run, schema)


def public_vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    """One of the vocabularies of the installed package, read on the driver."""
    import public_tokenizers

    return Vocabulary.from_tiktoken(public_tokenizers.path(name), public_tokenizers.PATTERN)
