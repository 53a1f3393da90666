"""Toxicity by a weighted lexicon.

Texts are folded: accents and homoglyphs (Cyrillic, Greek, full-width) become Latin letters, digits and
signs inside words the letters that they stand for. An Aho-Corasick automaton finds the terms of the
lexicon (whole words, and stems that words begin with) and the exception phrases; a term inside an
exception phrase doesn't count. The terms, their weights, and the two numbers that turn the sum of weights
for the length of a text into a score, are fitted on labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import sized
from refloom.session import ship, written

#: Insults to start from. Fitting keeps those that it sees, and adds others that mark toxic rows.
SEEDS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "worthless", "pathetic",
    "disgusting", "clown", "clowns", "imbecile", "dumbass", "retard", "bastard", "asshole", "bitch", "whore", "slut",
    "shit", "fuck", "fucking", "cunt", "vermin", "subhuman", "filth", "garbage",
)
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = (
    "clown fish", "clown nose", "circus clown", "clown school", "trash can", "trash bin", "trash bag", "trash collection",
    "take out the trash", "garbage collection", "garbage collector", "garbage truck", "garbage bag", "stupid question",
    "sore loser", "idiot proof", "the idiot by dostoevsky", "pond scum", "soap scum", "moron test",
)
#: Letters that look like others, and signs that stand for letters; fixed values.
LOOKALIKES = dict(
    zip(
        "абвгдеёзіїјкмнорстухѕԁɡһӏԛԝүѵαβγεζηικμνορτυχωϲϳıɑ０１３４５７@$!|€£",
        "abbrdeeeiijkmhopctyxsdghlqwyvabyeznikuvoptuxwcjiaoieastasiiel",
        strict=True,
    )
)
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Labelled rows of either label that fitting reads at most, those with the smallest hashes.
FIT_ROWS = 5_000
#: A term joins the lexicon if it is in so many toxic rows that aren't near copies of each other, in this
#: share of them, and this much likelier there (log odds).
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 5, 0.02, 4.0
#: Lengths of stems.
STEMS = range(4, 9)
#: A longer term replaces the one that it begins with if it keeps this share of its toxic rows.
SAME_SHARE = 0.95


def _table() -> dict[int, str]:
    out = {ord(k): v for k, v in LOOKALIKES.items()}
    for c in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode().lower()
        if plain:
            out[c] = plain
    out |= {0xDF: "ss", 0xE6: "ae", 0xC6: "ae", 0xF8: "o", 0xD8: "o", 0x142: "l", 0x131: "i"}
    out |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    return out | {0x200B: "", 0x200C: "", 0x200D: "", 0xAD: "", 0x2060: ""}


_FOLD = _table()
_DIGITS = str.maketrans(DIGITS)


def folded(text: str | None) -> tuple[str, int]:
    """The words of a text in plain lower-case letters, with a space before and after each; and their
    number. A run of digits stays a number; digits between or beside letters become letters."""
    words = []
    for w in (text or "").lower().translate(_FOLD).split():
        if not w.isalpha():
            if not w.isdigit():
                w = w.translate(_DIGITS)
            w = "".join(c if c.isalpha() or c.isdigit() else " " for c in w)
        words += w.split()
    return f" {' '.join(words)} ", len(words)


@dataclass
class Lexicon:
    #: Terms end with a space if they are whole words.
    weights: dict[str, float] = field(default_factory=lambda: {f"{w} ": 1.0 for w in SEEDS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: score = 1 / (1 + exp(-(offset + slope * log(1 + weight per ten thousand words))))
    offset: float = -3.0
    slope: float = 1.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def _automaton(self):
        if "_machine" not in self.__dict__:
            m = ahocorasick.Automaton()
            for w, x in self.weights.items():
                m.add_word(f" {w}", (len(w) + 1, x))
            for p in self.exceptions:
                m.add_word(f" {p} ", (len(p) + 2, None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def density(self, text: str | None) -> float:
        """Weight of the lexicon's words for each ten thousand words of the text, exceptions taken out."""
        plain, n = folded(text)
        if not n or not self.weights and not self.exceptions:
            return 0.0
        safe: list[tuple[int, int]] = []
        seen: list[tuple[int, int, float]] = []
        for end, (size, x) in self._automaton().iter(plain):
            if x is None:
                safe.append((end - size + 1, end))
            else:
                seen.append((end - size + 1, end, x))
        # of the phrases that begin no later than a hit the one that reaches furthest decides
        safe.sort()
        begins, reach = [p for p, _ in safe], [-1, *accumulate((q for _, q in safe), max)]
        total = sum(x for a, b, x in seen if reach[bisect_right(begins, a)] < b)
        return 1e4 * max(0.0, total) / n

    def score(self, text: str | None) -> float:
        z = self.offset + self.slope * math.log1p(self.density(text))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from labelled rows: up to ``rows`` of either label, those with the smallest hashes of
    their id. A text counts once for each of its terms, near copies of it (the same least hash of
    three-word shingles) together once. Without labelled rows of both kinds the seeds keep equal
    weights. Null labels and texts are left out."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(id).agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64(id)
    taken = written(
        known.where("_y = 1").orderBy(order).limit(rows).union(known.where("_y = 0").orderBy(order).limit(rows)), "labelled"
    )

    def run(batches):
        for b in batches:
            plain = [folded(x.as_py())[0] for x in b.column(text)]
            terms = [sorted({t for w in set(p.split()) for t in _terms(w)}) for p in plain]
            kind = pa.array([_copy_sign(p) for p in plain], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("_y"), kind, pa.array(terms, pa.list_(pa.string())), pa.array(plain, pa.string())],
                ["y", "kind", "terms", "plain"],
            )

    ship(docs.sparkSession)
    shown = written(
        docs.join(sized(taken), id)
        .where(F.col(text).isNotNull())
        .select("_y", text)
        .mapInArrow(run, "y int, kind bigint, terms array<string>, plain string")
        .dropDuplicates(["y", "kind"]),
        "shown",
    )
    sizes = {r["y"]: r["n"] for r in shown.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon()
    bad, good = sizes[1], sizes[0]
    odds = F.log((F.col("a") + 0.5) / (bad + 1.0)) - F.log((F.col("b") + 0.5) / (good + 1.0))
    seeds = F.col("term").isin(*(f"{w} " for w in SEEDS))
    found = (
        shown.select("y", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum(F.col("y").cast("long")).alias("a"), F.sum((1 - F.col("y")).cast("long")).alias("b"))
        .withColumn("odds", odds)
        .where(
            (seeds & (F.col("odds") > 0))
            | ((F.col("a") >= max(LEAST_ROWS, LEAST_SHARE * bad)) & (F.col("odds") >= LEAST_ODDS))
        )
        .collect()  # each is in a fiftieth of the toxic rows read
    )
    own = Lexicon(Lexicon().weights | _chosen({r["term"]: (r["a"], r["odds"]) for r in found}))

    def measure(batches):
        for b in batches:
            x = pa.array([own.density(x.as_py()) for x in b.column("plain")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("y"), x], ["y", "x"])

    points = shown.select("y", "plain").mapInArrow(measure, "y int, x double").toPandas()  # 2 * rows at most
    own.offset, own.slope = _logistic(np.log1p(points["x"].to_numpy()), points["y"].to_numpy(float))
    return own


def _terms(word: str) -> list[str]:
    return [*(word[:n] for n in STEMS if n <= len(word)), f"{word} "]


def _copy_sign(plain: str) -> int:
    words = plain.split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))), default=0)


def _chosen(terms: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of terms that begin with one another, the longest that keeps the rows of the shortest."""
    out: dict[str, float] = {}
    best = dict(terms)
    for t in sorted(terms, key=lambda t: (len(t), t)):  # the shortest first
        if any(t.startswith(p) for p in out):
            continue
        longer = [u for u in best if u.startswith(t) and best[u][0] >= SAME_SHARE * best[t][0]]
        pick = max(longer, key=lambda u: (len(u), best[u][0], u))
        out[pick] = float(best[pick][1])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Offset and slope of a logistic fit, by Newton's method; both labels weigh the same."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    a = np.column_stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - ridge * np.array([0.0, beta[1]]) * 0.01
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-9, ridge * 0.01])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def scored(docs: DataFrame, lexicon: Lexicon, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): the score of every row's text alone. Null and empty texts have no word, so the
    score of density zero; whole texts of any length count. Null ids stay. Repeated rows are scored alike,
    further columns are ignored, an empty table gives an empty result."""
    schema = T.StructType([docs.schema[id], T.StructField("score", T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        own = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(id), pa.array([own.score(x.as_py()) for x in b.column(text)], pa.float64())], schema.names
            )

    ship(docs.sparkSession)
    return docs.select(id, text).mapInArrow(run, schema)
