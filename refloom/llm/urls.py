"""URL filters: fixed rules, and for the other URLs a tree of path templates for each host.

The paths of a host are cut into segments. A position of the tree is a host, a depth and what stands
above; numbers, long hexadecimal strings and the values of positions that have many different ones are
generalised to wildcards. Of the templates at the end of the tree those whose share of pages known as bad
can't be told from the rest of their host by a two-proportion test are merged into one branch. The purity
of a branch that is worse than its host is its share of bad labels, that of others their share of pages
known as bad; it is smoothed towards that of its host's merged branch, which is smoothed towards that of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import sized
from refloom.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path, verdict); a host's rule also holds for its subdomains.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Words of hosts, or whole words of paths, that stand for unwanted pages; with the rules, the labels to start from.
BAD_WORDS = ("adult", "casino", "pills", "bets", "spam", "track", "porn", "viagra", "warez")
#: A position with more different values than this is generalised, if they are over this share of its rows.
MOST_VALUES, MOST_SHARE = 20, 0.05
#: Levels after which the rows are written, so that plans stay small.
LEVELS = 4
#: Branches whose test statistic against the rest of their host is within it are merged.
MERGE_Z = 1.96
#: Rows that a prior counts for, and the purity of bad labels from which a branch is rejected.
PRIOR_ROWS, LEAST_PURITY = 4.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to / ? # in lower case (A-Z), and then up to ? or #; both empty for
    a null or one without ://."""
    at = F.locate("://", url)
    rest = F.when(url.isNull() | (at == 0), "").otherwise(F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule (of equals, the first) that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, _, under = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{under}")
        found = F.when(fits, rule).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    return reduce(lambda other, r: F.when(rule == r[0], r[1]).otherwise(other), rules, F.lit(None).cast("string"))


def labelled(pages: DataFrame) -> DataFrame:
    """pages (host, path, ruled) with ``bad``: 1 for a host with a bad word, else as a rule says, else 1 for
    a bad word in the path."""
    word = reduce(lambda a, b: a | b, (F.col("host").contains(w) for w in BAD_WORDS))
    inside = F.translate("path", UPPER, LOWER).rlike(f"(^|[^a-z])({'|'.join(BAD_WORDS)})([^a-z]|$)")
    ruled = F.when(F.col("ruled") == "allow", 0).when(F.col("ruled") == "block", 1)
    return pages.withColumn("bad", F.when(word, 1).otherwise(F.coalesce(ruled, F.when(inside, 1))))


def _segments(path: Column) -> Column:
    """All segments; numbers and long hexadecimal strings are wildcards."""

    def plain(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\d+(?=$|\.)", "{n}")
        return F.when(x.rlike(r"^[0-9a-fA-F-]{16,}$"), "{h}").otherwise(x)

    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), plain)


def with_templates(pages: DataFrame) -> DataFrame:
    """pages (host, path) with ``template``: level by level to the end of the path, a value stays if its
    position has few values, else it becomes ``*``. A position of few rows has few values all the way down,
    so there the rest stays as it is. Positions are counted before they are shuffled; the page isn't
    shuffled unless the positions are too many to send around."""
    out = pages.withColumn("_segments", _segments(F.col("path"))).withColumn("template", F.lit(""))
    level = 0
    while True:
        value = F.get("_segments", F.lit(0))
        here = out.where(value.isNotNull()).groupBy("host", "template", value.alias("_value")).agg(F.count("*").alias("n"))
        many = (
            here.groupBy("host", "template")
            .agg(F.count("*").alias("values"), F.sum("n").alias("rows"))
            .where(F.col("rows") > MOST_VALUES)
            .select("host", "template", ((F.col("values") > MOST_VALUES) & (F.col("values") > MOST_SHARE * F.col("rows"))).alias("_wide"))
        )
        many = written(many, "positions")
        if not many.limit(1).count():
            break
        step = F.concat("template", F.lit("/"), F.when(F.col("_wide"), "*").otherwise(value))
        rest = F.concat("template", F.lit("/"), F.array_join("_segments", "/"))
        none = F.array().cast("array<string>")
        out = out.join(sized(many), ["host", "template"], "left").withColumns(
            {
                "template": F.when(value.isNull(), F.col("template")).when(F.col("_wide").isNull(), rest).otherwise(step),
                "_segments": F.when(F.col("_wide").isNull(), none).otherwise(F.slice("_segments", 2, F.greatest(F.size("_segments"), F.lit(1)))),
            }
        ).drop("_wide")
        level += 1
        if level % LEVELS == 0:
            out = written(out, "levels")
    rest = F.concat("template", F.lit("/"), F.array_join("_segments", "/"))
    return out.withColumn("template", F.when(F.size("_segments") > 0, rest).otherwise(F.col("template"))).drop("_segments")


def branch_purity(pages: DataFrame) -> DataFrame:
    """(host, template, branch, purity) from pages (host, template, bad): the branch that a template was
    merged into ("" is that of all that are like their host), and its smoothed share of bad labels."""
    leaf = pages.groupBy("host", "template").agg(
        F.count("*").alias("pages"), F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("b")
    )
    leaf = written(leaf, "leaves")
    every = leaf.agg(F.sum("pages").alias("n"), F.sum("b").alias("b")).first()
    prior = (float(every["b"] or 0) + 1.0) / (float(every["n"] or 0) + 2.0)
    # sums are written and sent around, or dealt anew, so that a host of many templates can be split
    hosts = written(leaf.groupBy("host").agg(F.sum("pages").alias("hn"), F.sum("b").alias("hb")), "hosts")
    both = leaf.join(sized(hosts), "host")
    rest_n, rest_b = F.col("hn") - F.col("pages"), F.col("hb") - F.col("b")
    pooled = F.try_divide("hb", "hn")
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "pages") + F.try_divide(F.lit(1), rest_n)))
    worse = F.try_divide("b", "pages") - F.try_divide(rest_b, rest_n)
    # null where there is no rest, or all pages are the same: nothing to tell apart
    apart = F.coalesce(F.try_divide(F.abs(worse), spread), F.lit(0.0)) > MERGE_Z
    own = both.withColumn("branch", F.when(apart, F.col("template")).otherwise(""))
    # a root page's template is "" too, and is a branch of its own when it is told apart
    own = own.withColumn("apart", apart).withColumn("weight", F.when(apart & (worse > 0), F.col("n")).otherwise(F.col("pages")))
    merged = own.groupBy("host", "branch", "apart").agg(F.sum("weight").alias("n"), F.sum("b").alias("b"))
    host_share = (F.coalesce("lb", F.lit(0)) + PRIOR_ROWS * prior) / (F.coalesce("ln", F.lit(0)) + PRIOR_ROWS)
    purity = (F.col("b") + PRIOR_ROWS * host_share) / (F.col("n") + PRIOR_ROWS)
    merged = written(merged, "merged")
    like = merged.where("NOT apart").select("host", F.col("n").alias("ln"), F.col("b").alias("lb"))
    merged = merged.join(sized(like), "host", "left").select("host", "branch", "apart", purity.alias("purity"))
    merged = sized(written(merged, "purities"))
    return own.select("host", "template", "branch", "apart").join(merged, ["host", "branch", "apart"]).drop("apart")


def judged_urls(pages: DataFrame, id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row.

    Null urls and those without :// have an empty host and path, are never ruled, and form a host of
    their own. Repeated rows are judged alike (each counts), further columns are ignored, an empty
    table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    plain = pages.select(F.col(id).alias("_id"), host.alias("host"), path.alias("path"))
    ruled = plain.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("ruled", verdict_of(F.col("rule"), rules))
    rows = written(with_templates(labelled(ruled)), "urls")
    branches = written(branch_purity(rows), "branches")
    found = rows.join(sized(branches), ["host", "template"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= LEAST_PURITY, "block").otherwise("allow"))
    return found.select(F.col("_id").alias(id), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
