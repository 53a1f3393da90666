"""Near duplicates by the share of word shingles, for the stage of the pipeline.

Two texts whose shingle sets have a similarity (Jaccard) of 0.8 differ in up to 14 of 64 fingerprint bits;
blocks that such pairs are sure to share would be four bits wide and match everything. So beside the links
that SimHash gives, texts with a common band of least shingle hashes are compared by their whole sets.
A band of ROWS hashes is shared by a pair of similarity s with probability s**ROWS: of pairs at 0.8 a
share of 4.3e-5 shares none of BANDS.

What meets in a crowded band is compared without its pairs being told, and without loss. The members of such
bands form groups; each has a reference, the set R of the shingles that most of its members have. A set x is
R without ``missing`` shingles and with others, together its difference D. With f(x) = t / (1 + t) |x| + missing,
sets x and y have a similarity of t exactly if their differences share f(x) + f(y) - |R| shingles. So

* where that is zero or less, they match whatever they share. Both then match the member with the least f, too,
  and one comparison of each member with that one connects all such pairs;
* elsewhere they share shingles of their differences, and so a rare one among the first of them (prefix
  filter). Differences of near copies are small and mostly their own, so few meet there; what the comparisons
  have connected already isn't compared again.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import BROADCAST_BYTES, parts, sized, with_row_key, without
from refloom.llm.components import connected_components
from refloom.llm.simhash import near_duplicate_classes
from refloom.session import ship, written

BANDS, ROWS = 14, 3
LEAST = 0.8
#: Texts of a band that are compared pair by pair. Members of larger bands are compared by their groups.
MOST_PAIRED = 32
#: Ratio of the bounds of the classes of f in which partners are looked for; finer ones give fewer candidates and
#: more keys.
STEP = 1.08
_KEYS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles (A-Z in lower case), sorted; of fewer words one."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r)) for r in runs), np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """One key for each band; texts without a word have none."""
    if not len(own):
        return []
    least = np.empty(BANDS * ROWS, np.uint64)
    for i, k in enumerate(_KEYS):
        x = own * k
        least[i] = (x ^ (x >> np.uint64(32))).min()
    return [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, len(least), ROWS)]


def _signs(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(_rk, whole, bands): a hash of the whole shingle set, and the keys."""

    def run(batches):
        for b in parts(batches):
            own = [shingles(x.as_py(), width) for x in b.column(text)]
            whole = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in own], pa.int64())
            keys = pa.array(list(map(bands, own)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("_rk"), whole, keys], ["_rk", "whole", "bands"])

    ship(docs.sparkSession)
    return docs.select("_rk", text).mapInArrow(run, "_rk binary, whole bigint, bands array<bigint>")


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(_rk, crowded, own): the whole shingle sets."""

    def run(batches):
        for b in parts(batches):
            own = pa.array([shingles(x.as_py(), width).view(np.int64) for x in b.column(text)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("_rk"), b.column("crowded"), own], ["_rk", "crowded", "own"])

    ship(docs.sparkSession)
    return docs.select("_rk", "crowded", text).mapInArrow(run, "_rk binary, crowded boolean, own array<bigint>")


def _met(keyed: DataFrame) -> DataFrame:
    """(band, key, _rk, n) of the members of bands of two or more. Both sides are written, so that the join
    deals them anew and a band of many can be split."""
    keyed = written(keyed, "keyed")
    crowd = written(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    return written(keyed.join(crowd, ["band", "key"]), "met")


def _paired(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    few = met.where(F.col("n") <= MOST_PAIRED).select("band", "key", "_rk")
    pairs = few.withColumnRenamed("_rk", "u").join(few.withColumnRenamed("_rk", "v"), ["band", "key"]).where("u > v")
    return written(_alike(pairs.select("u", "v").distinct(), sets, least), "alike")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough; sizes decide first."""
    size = F.size("own")
    a, b = (sets.select(F.col("_rk").alias(c), F.col("own").alias(f"{c}_own"), size.alias(f"{c}_n")) for c in ("u", "v"))
    both = pairs.join(a, "u").join(b, "v").where(F.least("u_n", "v_n") >= least * F.greatest("u_n", "v_n"))
    both = both.withColumn("common", F.size(F.array_intersect("u_own", "v_own")))
    return both.where(F.col("common") >= least * (F.col("u_n") + F.col("v_n") - F.col("common"))).select("u", "v")


def _groups(met: DataFrame) -> DataFrame:
    """(hub, _rk): the members of crowded bands by group. A band's group is named by its member that meets most
    others, so bands of the same texts share one."""
    rank = written(met.groupBy("_rk").agg(F.sum("n").alias("rank")), "ranks")
    many = written(met.where(F.col("n") > MOST_PAIRED).select("band", "key", "_rk").join(rank, "_rk"), "crowded")
    hubs = written(many.groupBy("band", "key").agg(F.max(F.struct("rank", "_rk"))["_rk"].alias("hub")), "hubs")
    return written(many.join(sized(hubs), ["band", "key"]).select("hub", "_rk").distinct(), "groups")


def _apart(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(hub, token, inside, n) of the shingles by which members (hub, _rk, own) differ from the set of their hub (hubs:
    hub, whole): whether the hub has it, and how many members differ by it. What all have alike is never listed."""

    def marked(shingles: Column, inside: bool) -> Column:
        return F.transform(shingles, lambda x: F.struct(x.alias("token"), F.lit(inside).alias("inside")))

    lost, gained = F.array_except("whole", "own"), F.array_except("own", "whole")
    told = members.join(_few(hubs, "whole"), "hub").select("hub", "_rk", F.concat(marked(lost, True), marked(gained, False)).alias("apart"))
    # dealt by member, as a file may hold many of one group
    listed = told.repartition("hub", "_rk").select("hub", F.inline("apart"))
    return listed.groupBy("hub", "token", "inside").agg(F.count("*").alias("n"))


def _differences(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(hub, _rk, f, size, total, shared): of every member of a group f, the size of the group's reference and of its
    own difference, and those shingles of it that another member's difference has as well, the rarest first.
    How many members have a shingle is counted by their differences from the hub, a member itself."""
    own = written(groups.join(sets.select("_rk", "own"), "_rk"), "members")
    hubs = groups.select("hub").distinct().join(sets.select(F.col("_rk").alias("hub"), F.col("own").alias("whole")), "hub")
    hubs = written(hubs, "hub-sets")
    members = written(groups.groupBy("hub").agg(F.count("*").alias("members")), "counts")
    n = F.when(F.col("inside"), F.col("members") - F.col("n")).otherwise(F.col("n"))
    # what one member has alone is in no reference, as groups have more than MOST_PAIRED, and shared with none
    each = written(_apart(own, hubs).join(sized(members), "hub").withColumn("n", n).where("n > 1 OR inside"), "tokens")
    most = 2 * F.col("n") > F.col("members")
    turned = each.where(F.col("inside") != most).groupBy("hub").agg(
        F.collect_list(F.when(F.col("inside"), F.col("token"))).alias("less"), F.collect_list(F.when(~F.col("inside"), F.col("token"))).alias("more")
    )
    none = F.array().cast("array<bigint>")
    whole = F.concat(F.array_except("whole", F.coalesce("less", none)), F.coalesce("more", none))
    reference = written(hubs.join(turned, "hub", "left").select("hub", whole.alias("reference")), "references")
    told = own.join(_few(reference, "reference"), "hub")
    whole = F.col("reference")
    missing, extra = F.array_except(whole, F.col("own")), F.array_except(F.col("own"), whole)
    told = told.withColumns({"missing": missing, "extra": extra})
    f = least / (1 + least) * F.size("own") + F.size("missing")
    told = told.select("hub", "_rk", f.alias("f"), F.size(whole).alias("size"), F.concat("missing", "extra").alias("difference"))
    told = written(told, "differences")
    rare = each.select("hub", "token", F.when(most, F.col("members") - F.col("n")).otherwise(F.col("n")).alias("n")).where("n > 1")
    # dealt by member, as a file may hold many of one group
    dealt = told.repartition("hub", "_rk")
    listed = dealt.select("hub", "_rk", F.explode("difference").alias("token")).join(written(rare, "shared-tokens"), ["hub", "token"])
    order = F.array_sort(F.collect_list(F.struct("n", "token")))
    listed = listed.groupBy("hub", "_rk").agg(F.transform(order, lambda x: x["token"]).alias("shared"))
    found = told.select("hub", "_rk", "f", "size", F.size("difference").alias("total"))
    return written(found.join(written(listed, "listed"), ["hub", "_rk"], "left"), "prefixes")


def _few(side: DataFrame, shingles: str) -> DataFrame:
    """A side with lists of shingles, with a broadcast hint if it is small."""
    n = side.agg(F.sum(F.size(shingles))).first()[0] or 0
    return F.broadcast(side) if 8 * n <= BROADCAST_BYTES else side


def _entries(rows: DataFrame, least: float) -> DataFrame:
    """(hub, token, low, high, role, at, _rk, label, f, size, total, n): the shingles by which a member meets partners of
    each class of f, its own class and theirs in order, with their place in its difference; role 0 for the partner
    of the lower class, 1 for that of the higher one, both for partners of its own."""
    whole = ["hub", "_rk", "label", "f", "size", "total", "n"]
    names = ["token", "low", "high", "role", "at", *whole]
    share = least / (1 + least)

    def place(f: float) -> int:
        return math.floor(math.log(max(f, 1.0)) / math.log(STEP) + 1e-9)

    def run(batches):
        for b in parts(batches):
            at, out = [], []
            columns = (b.column(c).to_pylist() for c in ("f", "size", "total", "n", "shared", "least_f", "most_f"))
            for i, (f, size, total, n, shared, least_f, most_f) in enumerate(zip(*columns, strict=True)):
                if not shared:
                    continue
                mine, alone = place(f), total - len(shared)
                # a partner has least * n shingles or more, and no more of them in common than there are
                for c in range(max(place(share * least * n), place(least_f)), min(place(size + total - f), place(most_f)) + 1):
                    need = max(1, math.ceil(f + (STEP**c if c else 0.0) - size - 1e-6))
                    tokens = shared[: max(0, total - need + 1 - alone)]
                    for role in (0, 1) if c == mine else (int(c < mine),):
                        at += [i] * len(tokens)
                        out += [(t, min(c, mine), max(c, mine), role, alone + p) for p, t in enumerate(tokens)]
            kinds = [pa.int64(), *[pa.int32()] * 4]
            own = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*own, *(b.column(c).take(places) for c in whole)], names)

    ship(rows.sparkSession)
    schema = "token bigint, low int, high int, role int, at int, hub binary, _rk binary, label binary, f double, size int, total int, n int"
    return rows.select(*whole, "shared", "least_f", "most_f").mapInArrow(run, schema)


def _ranges(rows: DataFrame) -> DataFrame:
    """(hub, main, and ranges of f) of the groups that aren't connected as a whole: main is the label that most members
    have; theirs are partners among the rest, those of the rest anywhere."""
    each = rows.groupBy("hub", "label").agg(F.count("*").alias("c"), F.min("f").alias("lo"), F.max("f").alias("hi"))
    each = written(each, "label-ranges")
    main = written(each.groupBy("hub").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("labels")), "main-labels")
    both = each.join(sized(main.where("labels > 1").drop("labels")), "hub")
    other = F.col("label") != F.col("main")
    found = both.groupBy("hub").agg(
        F.any_value("main").alias("main"),
        F.min(F.when(other, F.col("lo"))).alias("rest_lo"),
        F.max(F.when(other, F.col("hi"))).alias("rest_hi"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    return written(found, "ranges")


def _across(prefixes: DataFrame, sets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(u, v) between members of a group that aren't connected yet (labels: node, root). Where most of those that meet
    are connected, only the others look for partners among them. A pair meets at the shingles that are early enough
    in both differences for as many to follow as the two need."""
    sizes = sets.select("_rk", F.size("own").alias("n"))
    rows = prefixes.join(sizes, "_rk").join(labels.select(F.col("node").alias("_rk"), "root"), "_rk", "left")
    rows = written(rows.withColumn("label", F.coalesce("root", "_rk")).drop("root"), "labelled")
    in_main = F.col("label") == F.col("main")
    bounds = {"least_f": F.when(in_main, F.col("rest_lo")).otherwise(F.col("lo")), "most_f": F.when(in_main, F.col("rest_hi")).otherwise(F.col("hi"))}
    rows = written(_entries(rows.join(sized(_ranges(rows)), "hub").withColumns(bounds), least), "entries")
    key = ["hub", "token", "low", "high"]
    by_label = rows.groupBy(*key, "label").agg(F.count("*").alias("n"))
    heads = by_label.groupBy(*key).agg(F.max_by("label", "n").alias("head"), F.count("*").alias("labels")).where("labels > 1")
    met = written(rows.join(written(heads.drop("labels"), "heads"), key), "meeting")
    met = met.withColumn("in_head", F.col("label") == F.col("head"))
    fields = ["label", "in_head", "f", "at", "total", "n"]
    a = met.where("role = 0").select(*key, "size", F.col("_rk").alias("u"), *(F.col(c).alias(f"u_{c}") for c in fields))
    b = met.where("role = 1").select(*key, F.col("_rk").alias("v"), *(F.col(c).alias(f"v_{c}") for c in fields))
    need = F.greatest(F.lit(1), F.ceil(F.col("u_f") + F.col("v_f") - F.col("size") - 1e-6))
    early = (F.col("u_at") <= F.col("u_total") - need) & (F.col("v_at") <= F.col("v_total") - need)
    apart = (F.col("u_label") != F.col("v_label")) & early & (F.least("u_n", "v_n") >= least * F.greatest("u_n", "v_n"))
    outside = a.where("NOT u_in_head").join(b, key).where(apart).select("u", "v")
    inside = a.where("u_in_head").join(b.where("NOT v_in_head"), key).where(apart).select("u", "v")
    return written(_alike(_ordered(outside.union(inside)), sets, least), "across")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def similar_links(docs: DataFrame, text: str = "text", width: int = 5, least: float = LEAST) -> DataFrame:
    """(u, v): links between row keys (docs has _rk, binary and unique) whose texts' shingle sets have a similarity of
    at least ``least``. Equal sets are linked to one of them, which alone is compared further. In crowded
    bands not every such pair is told, but those that chains of pairs connect are connected."""
    signs = written(_signs(docs, text, width), "signs")
    kinds = written(signs.groupBy("whole").agg(F.min("_rk").alias("v"), F.count("*").alias("n")).where("n > 1"), "kinds")
    same = signs.join(kinds.select("whole", "v"), "whole").where("_rk != v").select(F.col("_rk").alias("u"), "v")
    links = [written(same, "equal")]
    keys = F.posexplode("bands").alias("band", "key")
    met = _met(signs.join(links[0].select(F.col("u").alias("_rk")), "_rk", "left_anti").select("_rk", keys))
    seen = written(met.groupBy("_rk").agg(F.max(F.col("n") > MOST_PAIRED).alias("crowded")), "compared")
    own = docs.join(sized(seen.select("_rk")), "_rk", "left_semi").join(seen, "_rk")
    sets = written(_sets(own, text, width), "sets")
    links.append(_paired(met, sets, least))
    crowded = sets.where("crowded")
    if crowded.limit(1).count():
        prefixes = _differences(_groups(met), crowded, least)
        centre = written(prefixes.groupBy("hub").agg(F.min_by("_rk", F.struct("f", "_rk")).alias("centre")), "centres")
        stars = prefixes.select("hub", "_rk").join(sized(centre), "hub").where("_rk != centre").select(F.col("_rk").alias("u"), F.col("centre").alias("v"))
        links.append(written(_alike(_ordered(stars), crowded, least), "stars"))
        labels = written(connected_components(links[-1]), "labels")
        links.append(_across(prefixes, crowded, labels, least))
    return reduce(DataFrame.union, links).distinct()


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, least: float = LEAST) -> DataFrame:
    """The rows of docs that stay: of each class of texts linked by SimHash (two or fewer differing bits)
    or by a similarity of ``least`` the one with the smallest id (ids before nulls, equal ids by the hash of
    the row), of equal rows one. Texts without a word are one class."""
    found = near_duplicate_classes(docs, id, text, width)
    classes = written(found.select(F.col(id).alias("id"), "_rk", "root").dropDuplicates(["_rk"]), "classes")
    first = written(classes.groupBy("root").agg(F.min("_rk").alias("v")), "roots")
    by_hash = classes.join(first, "root").where("_rk != v").select(F.col("_rk").alias("u"), "v")
    own = with_row_key(docs.select(id, text), id, text).select("_rk", text)
    repeated = found.groupBy("_rk").count().where("count > 1").limit(1).count()
    if repeated:
        own = own.dropDuplicates(["_rk"])
    edges = by_hash.union(similar_links(own, text, width, least))
    roots = written(connected_components(edges), "similar-roots")
    named = classes.join(roots, classes["_rk"] == roots["node"]).select("id", "_rk", roots["root"].alias("name"))
    named = written(named, "named")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("_rk").alias("c"))
    best = written(named.groupBy("name").agg(F.min(rank)["c"].alias("best")), "best")
    losers = written(named.join(best, "name").where("_rk != best").select("_rk"), "losers")
    return without(docs, losers, id, text, once=repeated > 0)
