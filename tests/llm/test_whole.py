"""Rows that bounds inside the operators once left out."""

import random
import string
from collections import Counter

from pyspark.sql import functions as F

from refloom.llm import common, components, decontam, quality, secrets, similar, simhash, substrings, toxicity, urls, warc
from tests.llm import brute


def test_header_of_any_length(spark, tmp_path):
    urls = ["http://h/a", "data:x," + "u" * 100_000, "http://h/b", "http://h/" + "v" * (warc.MOST_HEADER - 270), "http://h/c", None]
    pages = [(i, u, f"<p>{i}") for i, u in enumerate(urls)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(rows, f"{tmp_path}/warc")
    found = warc.read_archives(spark, f"{tmp_path}/warc").select("key", "uri", "payload").collect()
    assert sorted((int(k), u, bytes(b).decode()) for k, u, b in found) == pages


def masked(text):
    out = text
    for a, b, _ in reversed(secrets.spans(text)):
        out = out[:a] + "*" * (b - a) + out[b:]
    return out


def test_keys_of_any_alphabet_and_length():
    rng, letters = random.Random(7), string.ascii_letters
    draw = lambda own, n: "".join(rng.choices(own, k=n))
    for own, sizes in ((letters, (20, 40, 300)), ("0123456789ABCDEF", (32, 192, 512, 5000)), (string.digits, (20, 400)), (letters + "0123456789+/", (20, 70_000))):
        for n in sizes:
            keys = [draw(own, n) for _ in range(50 if n < 1000 else 2)]
            hit = [k not in masked(f"the access key {k} was sent") and "*" * n in masked(f"the access key {k} was sent") for k in keys]
            assert sum(hit) >= 0.96 * len(hit), (own, n)
    for word in ("internationalization", "Donaudampfschifffahrtsgesellschaft", "incomprehensibilities", "please_enter_the_secret_here", "-" * 70, "_" * 20):
        assert masked(f"the secret {word} is") == f"the secret {word} is"


def test_keys_of_several_lines():
    rng = random.Random(8)
    lines = ["".join(rng.choices(string.ascii_letters + "0123456789+/", k=64)) for _ in range(20)]
    body = "\n".join([*lines, "Ab3="])
    pem = f"x\n-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----\nplain words"
    out = masked(pem)
    assert out.endswith("-----END RSA PRIVATE KEY-----\nplain words") and not any(x in out for x in [*lines, "Ab3="])
    out = masked("signing key:\n" + "\n".join(lines) + "\nplain words")
    assert out.endswith("\nplain words") and not any(x in out for x in lines)


def prefixes(lengths, tails=()):
    """Texts that are the first words of one, some with a word of their own at the end."""
    words = [f"w{i}" for i in range(1000)]
    return [" ".join(words[:n]) for n in lengths] + [" ".join([*words[:n], f"own{i}"]) for i, n in enumerate(tails)]


def test_members_of_a_simhash_class_are_compared(spark):
    texts = prefixes([705, *range(870, 1001)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = similar.without_near_duplicates(docs).select("doc_id").collect()
    assert [r[0] for r in kept] == [0]


def test_chains_in_crowded_bands(spark):
    # in each group of copies one text connects them with another that is a little too short for them
    group = prefixes([990, 795], [1000] * 60)
    texts = [t.replace("w", f"g{g}x") for g in range(8) for t in group]
    docs = spark.createDataFrame([(i.to_bytes(4), t) for i, t in enumerate(texts)], "_rk binary, text string")
    links = [(int.from_bytes(r.u), int.from_bytes(r.v)) for r in similar.similar_links(docs).collect()]
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    alike = [(u, v) for u in range(len(texts)) for v in range(u) if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])]

    def roots(edges):
        root = list(range(len(texts)))
        for _ in texts:
            before = list(root)
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
            if root == before:
                return root

    assert roots(links) == roots(alike) == [u - u % len(group) for u in range(len(texts))]
    assert {(max(x), min(x)) for x in links} <= set(alike)


def test_templates_of_one_host_differ(spark):
    paths = [f"fr/a/{i}" for i in range(30)] + [f"shop/{'casino' if i < 18 else 'fine'}-{chr(97 + i)}/x" for i in range(26)]
    paths += [f"blog/{i}" for i in range(30)] + ["a/b/c/d/e/f/g"]
    pages = spark.createDataFrame([(i, f"http://h.com/{p}") for i, p in enumerate(paths)], "page_id long, url string")
    found = {r["path"]: (r["template"], r["verdict"]) for r in urls.judged_urls(pages).collect()}
    assert found["/shop/fine-z/x"] == ("/shop/*/x", "block")
    assert found["/blog/7"] == ("/blog/{n}", "allow")
    assert found["/a/b/c/d/e/f/g"] == ("/a/b/c/d/e/f/g", "allow")


def test_one_response_for_each_payload(spark, tmp_path):
    # repeated ids with other payloads, repeated rows, rows without an id; several blocks to a file
    rows = [(1, "a"), (1, "bbbb"), (2, "a"), (3, "c"), (3, "c"), (3, "c"), (4, "c"), (None, "c"), (None, "n"), (5, ""), (6, None), (5, "")]
    pages = spark.createDataFrame([(i, f"http://h/{n}", h) for n, (i, h) in enumerate(rows)], "page_id long, url string, html string")
    warc.write_archives(pages.repartition(3), f"{tmp_path}/warc")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        found = warc.with_referred(warc.read_archives(spark, f"{tmp_path}/warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    told = sorted((r.key or "", r.payload_bytes, r.type, r.refers_to or "") for r in found)
    assert told == sorted(
        [("1", 1, "response", ""), ("1", 4, "response", ""), ("2", 1, "revisit", "<urn:page:1>"), ("", 1, "response", ""), ("6", 0, "revisit", "<urn:page:5>")]
        + [("3", 1, "response", ""), *[("3", 1, "revisit", "<urn:page:3>")] * 2, ("4", 1, "revisit", "<urn:page:3>"), ("", 1, "revisit", "<urn:page:3>")]
        + [("5", 0, "response", ""), ("5", 0, "revisit", "<urn:page:5>")]
    )


def test_hits_inside_phrases():
    rng = random.Random(9)
    own = toxicity.Lexicon(weights={"clown ": 2.0, "tras": 1.0, "garbage ": 3.0, "idiot ": 1.5})
    words = ["clown", "fish", "circus", "trash", "can", "take", "out", "the", "garbage", "truck", "idiot", "proof", "by", "dostoevsky", "tr4sh", "clownish"]
    for _ in range(200):
        text = " ".join(rng.choices(words, k=rng.randrange(40)))
        plain, n = toxicity.folded(text)
        hits = [(a, a + len(w) + 1, x) for a in range(len(plain)) for w, x in own.weights.items() if plain.startswith(f" {w}", a)]
        safe = [(a, a + len(p) + 2) for a in range(len(plain)) for p in own.exceptions if plain.startswith(f" {p} ", a)]
        total = sum(x for a, b, x in hits if not any(p <= a and b <= q for p, q in safe))
        assert abs(own.density(text) - (1e4 * total / n if n else 0.0)) < 1e-6
    own.density("trash can idiot " * 200_000)  # in proportion to the length


def test_spans_of_random_texts():
    rng = random.Random(10)
    parts = ["secret key", "token: ", "abc", "\n", " ", "AKIA" + "Q" * 17, "0f" * 20, "9fK2mQ7xVb3ZtR8wLp5YnC4d", "password=", "-----BEGIN PRIVATE KEY-----\n", "-----END PRIVATE KEY-----", "words and", "x" * 30, "zT9/" * 6 + "Qw==", "é", ":"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(25)))
        assert secrets.spans(text) == brute.secret_spans(text, secrets), text


def test_ways_beyond_the_bounds(spark, sf_dir, monkeypatch):
    """What is done for many rows gives what is done for few."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def results():
        hits = decontam.contamination(docs, items, sent_grams=sent).select("doc_id", "n_hit", "items")
        classes = simhash.near_duplicate_classes(docs, most_in_block=block).select("doc_id", "component")
        kept = similar.without_near_duplicates(docs).select("doc_id")
        spans = substrings.repeat_digests(docs)
        return [sorted(map(str, x.collect())) for x in (hits, classes, kept, spans)]

    sent, block = decontam.SENT_GRAMS, simhash.MOST_IN_BLOCK
    usual = results()
    sent, block = 0, 1
    monkeypatch.setattr(similar, "MOST_PAIRED", 2)
    monkeypatch.setattr(common.sized, "__defaults__", (0, 0))
    monkeypatch.setattr(components, "SENT_EDGES", 0)
    for module in (decontam, substrings):
        monkeypatch.setattr(module, "REMEMBERED", 10)
    assert results() == usual


def test_passing_tables_go(spark):
    from refloom.session import hadoop_path, passing, shared_dir, written

    def listed():
        fs, at = hadoop_path(spark, shared_dir(spark))
        return {x.getPath().getName() for x in fs.listStatus(at)}

    before = listed() if written(spark.range(1), "before") else set()
    with passing(spark):
        assert written(spark.range(3), "inside").count() == 3 and listed() > before
    assert listed() == before


def test_quality_is_fitted_on_all_labels(spark):
    """The last of 5,400 rejected rows, in the order of their ids' hashes, are unlike all others."""
    ids = [r["id"] for r in spark.range(1, 5401).orderBy(F.xxhash64("id"), "id").collect()]
    good, bad = ([f"{c}{i}" for i in range(40)] for c in "gb")
    low, middle, high = " ".join(bad), " ".join(good[:30] + bad[:10]), " ".join(good)
    docs = [(i, low if n < 5000 else middle, 0) for n, i in enumerate(ids)] + [(i, high, 1) for i in range(6000, 6400)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    ratio = quality.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    kept = {r["text"] for r in quality.judged(rows, ratio).where("kept").select("text").collect()}
    expected = {t for (_, t, _), (_, _, k, _) in zip(docs, brute.quality([d[:2] for d in docs], [d[::2] for d in docs]), strict=True) if k}
    assert kept == expected == {high}


def test_threshold_of_many_scores(spark):
    rng = random.Random(5)
    points = [(round(rng.gauss(y, 1), 3), y) for y in (0, 1) for _ in range(3000)]
    found = quality._threshold(spark.createDataFrame(points, "score double, _y int").distinct().repartition(7))
    points = sorted(set(points))
    good, bad = sum(y for _, y in points), sum(1 - y for _, y in points)
    best, saved, at = 0, 0, None  # whole numbers, so that equals are equal
    for (x, y), (following, _) in zip(points, points[1:], strict=False):
        saved += -4 * bad if y else good
        if following > x and saved > best:
            best, at = saved, (x + following) / 2
    assert found == at
    assert quality._threshold(spark.createDataFrame([(1.0, 1)], "score double, _y int")) == float("-inf")
    assert quality._threshold(spark.createDataFrame([(1.0, 0), (0.5, 1)], "score double, _y int")) == float("-inf")


def test_differences_of_a_group_from_its_hub(spark):
    """The reference is what most members have, whichever of them is the hub; only differences are listed."""
    rng = random.Random(6)
    common = [rng.getrandbits(62) for _ in range(300)]
    texts = [set(common) - set(rng.sample(common, 10)) | {*rng.sample(range(20), 5), 1000 + i} for i in range(60)]
    keys = [i.to_bytes(2) for i in range(60)]
    sets = spark.createDataFrame([(bytearray(k), sorted(x)) for k, x in zip(keys, texts, strict=True)], "_rk binary, own array<bigint>")
    groups = spark.createDataFrame([(bytearray(keys[7]), bytearray(k)) for k in keys], "hub binary, _rk binary")
    hubs = sets.where(F.col("_rk") == F.lit(keys[7])).select(F.col("_rk").alias("hub"), F.col("own").alias("whole"))
    listed = similar._apart(groups.join(sets, "_rk"), hubs).agg(F.sum("n")).first()[0]
    assert listed == sum(len(x ^ texts[7]) for x in texts) < sum(map(len, texts)) / 4
    count = Counter(t for x in texts for t in x)
    reference = {t for t, n in count.items() if 2 * n > 60}
    rare = Counter(t for x in texts for t in x ^ reference)
    found = {bytes(r["_rk"]): r for r in similar._differences(groups, sets, 0.8).collect()}
    assert len(found) == 60
    for k, x in zip(keys, texts, strict=True):
        r, apart = found[k], x ^ reference
        assert (r["size"], r["total"]) == (len(reference), len(apart))
        assert abs(r["f"] - (0.8 / 1.8 * len(x) + len(reference - x))) < 1e-9
        assert r["shared"] == sorted((t for t in apart if rare[t] > 1), key=lambda t: (rare[t], t))
