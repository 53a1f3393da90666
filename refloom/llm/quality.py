"""Quality rules: counts that junk betrays itself by, and a likelihood ratio of hashed n-grams.

Every word and every pair of neighbouring words of a text is hashed into one of BUCKETS buckets. Two
multinomials over the buckets are estimated: the raw one from all texts, the target one from texts
that labels trust. A text's score is the mean, over its n-grams, of the log ratio of the two; it is
compared with one threshold, which all labelled rows of both kinds fix. Everything is built from SQL
functions; the counts are aggregated before they are shuffled. Texts are shuffled only where there are too
many labels to be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import sized, words_of
from refloom.session import written

#: Words of a window that counts as repeated if it is found again.
REPEAT = 8
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Buckets of n-grams, a power of two. Their ratios, one row, are all that every task gets of the corpus.
BUCKETS = 1 << 16
#: Rejecting a trusted row is as bad as keeping so many rejected ones.
GOOD_WEIGHT = 4.0
#: Added to every bucket's count, in shares of the mean count.
SMOOTHING = 0.05


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; inside a lambda a plain column would be computed again
    for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(hashes: Column) -> Column:
    """Words inside runs of REPEAT words that occur twice or more, the first included."""

    def covered(runs: Column) -> Column:
        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gain = F.transform(p, lambda x, j: F.least(F.lit(REPEAT), x - F.coalesce(F.get(p, j - 1), x - REPEAT)))
            return F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x)

        tagged = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(_let(tagged, places), total)

    def over(h: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h))

    runs = hashes  # of 1, 2, 4, 8 words
    for step in (1, 2, 4):
        runs = _let(runs, _joined(step))
    return _let(runs, over)


def _joined(step: int) -> Callable[[Column], Column]:
    return lambda h: _neighbours(h, step, lambda a, b: F.xxhash64(a, b))


def _neighbours(h: Column, step: int, of: Callable[[Column, Column], Column]) -> Column:
    """of every element and the one that follows it by step. (Slices in a lambda over the places would
    copy the array each time.)"""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), of)


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and ``_hashes``,
    the hash of every word. Null texts have no words and fail."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("_words", words_of(F.col(text)))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": (F.length(plain) - F.length(F.regexp_replace(plain, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": _repeated_lines(plain),
                "n_repeat_words": _repeated_words(F.col("_hashes")),
            }
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
        .drop("_words")
    )


def _grams(hashes: Column) -> Column:
    """The buckets of all words and pairs of neighbouring words."""
    keep = F.lit(BUCKETS - 1).cast("long")

    def both(h: Column) -> Column:
        pairs = _neighbours(h, 1, lambda a, b: a.bitwiseXOR(F.shiftrightunsigned(b, 17)).bitwiseAND(keep).cast("int"))
        return F.concat(F.transform(h, lambda a: a.bitwiseAND(keep).cast("int")), pairs)

    return _let(hashes, both)


@dataclass
class Ratio:
    """Log ratios by bucket, and the least mean ratio of a text that stays."""

    #: One row with ``w``, the log ratios of all buckets in their order; None where nothing is trusted.
    weights: DataFrame | None
    threshold: float

    def scored(self, docs: DataFrame) -> DataFrame:
        """docs with ``score``, the mean log ratio over a text's n-grams (``_hashes``); zero if it has none. The
        ratios are a scalar subquery: read once for each query and sent to every task, neither in the plan's
        text nor joined to the rows."""
        if self.weights is None:
            return docs.withColumn("score", F.lit(0.0))

        def mean(g: Column, w: Column) -> Column:
            total = F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(w, x))
            return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total / F.size(g))

        score = _let(F.col("_ratios"), lambda w: _let(_grams(F.col("_hashes")), lambda g: mean(g, w)))
        return docs.withColumn("_ratios", self.weights.scalar()).withColumn("score", score).drop("_ratios")


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Ratio:
    """Log ratios of all trusted rows (label 1) of labels against all rows of docs, and the threshold of all labelled ones.

    Labels with a null id or label are left out; of repeated ids the smallest label counts. Without
    trusted rows every ratio is zero; without rows of both labels nothing is rejected.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(id).agg(F.min(label).cast("int").alias("_y"))
    known = written(known, "labelled")
    texts = docs.select(id, F.col(text).alias("_text"))
    hashes = F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w))  # after the join: they are longer than the text
    counts = (
        texts.join(sized(known.where("_y = 1")), id, "left")
        .select((F.col("_y") == 1).alias("good"), F.explode(_grams(hashes)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))
    )
    counts = written(counts, "buckets")  # BUCKETS rows at most
    ratio = Ratio(_log_ratios(counts), -math.inf)
    if ratio.weights is None:
        return ratio

    seen = with_base_counts(texts.join(sized(known), id), "_text")
    # failed rows are left out once they are written: a filter would be pushed below the join, and every text counted
    points = written(ratio.scored(seen).select("score", "_y", "base_failed").distinct(), "points")
    ratio.threshold = _threshold(points.where("NOT base_failed"))
    return ratio


def _log_ratios(counts: DataFrame) -> DataFrame | None:
    """One written row with log(target share / raw share) of every bucket; None without a target."""
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target:
        return None

    def share(count: str, total: int) -> Column:
        extra = SMOOTHING * total / BUCKETS
        return (F.coalesce(count, F.lit(0)) + extra) / F.lit(total + extra * BUCKETS)

    every = counts.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    ratio = F.round(F.log(share("target", target)) - F.log(share("raw", raw)), 5)
    ordered = F.array_sort(F.collect_list(F.struct("bucket", ratio.alias("w"))))  # BUCKETS numbers
    return written(every.agg(F.transform(ordered, lambda x: x["w"]).alias("w")), "ratios")


def _threshold(points: DataFrame) -> float:
    """The place between two scores with the least loss, the lowest of equals. points: distinct (score, _y). Scores are
    dealt out by ranges and counted within each; the counts of the ranges before are added (one row a range reaches
    the driver)."""
    good, bad = points.agg(F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)).first()
    if not good or not bad:
        return -math.inf
    each = points.groupBy("score").agg(F.count_if(F.col("_y") == 1).alias("good"), F.count_if(F.col("_y") == 0).alias("bad"))
    dealt = written(each.repartitionByRange("score").withColumn("_part", F.spark_partition_id()), "scores")
    sums = sorted(dealt.groupBy("_part").agg(F.sum("good"), F.sum("bad")).collect())
    before = accumulate(((g, b) for _, g, b in sums), lambda x, y: (x[0] + y[0], x[1] + y[1]), initial=(0, 0))
    shifts = [(part, *counts) for (part, *_), counts in zip(sums, before, strict=False)]
    shift = F.broadcast(points.sparkSession.createDataFrame(shifts, "_part int, _good long, _bad long"))
    below = Window.partitionBy("_part").orderBy("score")
    cut = dealt.select("_part", "score", F.sum("good").over(below).alias("good"), F.sum("bad").over(below).alias("bad")).join(shift, "_part")
    # what cutting above a score saves; rounded, so that equals are equal
    saved = F.round((F.col("bad") + F.col("_bad")) / bad - GOOD_WEIGHT * (F.col("good") + F.col("_good")) / good, 12)
    best, at = cut.agg(F.max(F.struct(saved.alias("saved"), (-F.col("score")).alias("score"))).alias("best")).select("best.*").first()
    if best <= 0:
        return -math.inf
    at = -at
    following = dealt.where(F.col("score") > at).agg(F.min("score")).first()[0]
    return (at + following) / 2


def judged(docs: DataFrame, ratio: Ratio, text: str = "text") -> DataFrame:
    """docs with the base counts, ``score`` and ``kept``: not failed, and a score of the threshold or
    more. Every row is judged by its text alone: repeated rows alike, null and blank texts fail;
    columns of these names are replaced; an empty table stays empty."""
    found = ratio.scored(with_base_counts(docs, text))
    least = F.lit(max(ratio.threshold, -1e300))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).drop("_hashes")
