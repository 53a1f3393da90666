"""WARC archives: written as Spark tables of records, read back by tasks that each see a part of a file.

Writing: each row becomes a record; rows of equal payloads refer to the one with the smallest key by
revisit records. A record ends with two line breaks, which is what the text writer puts after each row,
so every task writes a whole archive to any file system that Spark knows.

Reading: the text reader cuts the files at the magic of a record, in parallel, wherever it stands; a
payload may hold it as well. Every piece is a candidate record: its header gives the offset of its
successor. Within a part of a file, candidates that follow one another without a gap form a run. Runs are
linked by their successors, and pointer jumping from the start of each file finds those that can be
reached; a payload's records can't. Payloads that were cut are put together again.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.llm.common import sized
from refloom.session import scratch, ship, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes are always written out.
LEAST_SHARED = 0
#: The first bytes of a piece that are sent to look for a header; the whole piece if it doesn't end in them.
MOST_HEADER = 1 << 16
MOST_ROUNDS = 64
RECORD = "file string, at bigint, id string, type string, uri string, date string, key string, payload binary, payload_digest string, refers_to string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing


def with_payload_digests(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, uri, payload, size, digest) with null payloads empty."""
    schema = f"key {pages.schema[key].dataType.simpleString()}, uri string, payload binary, size bigint, digest string"

    def run(batches):
        for b in batches:
            bodies = [x.as_py() or b"" for x in b.column("payload")]
            columns = [
                b.column("key"),
                b.column("uri"),
                pa.array(bodies, pa.binary()),
                pa.array(map(len, bodies), pa.int64()),
                pa.array(map(digest, bodies), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "uri", "payload", "size", "digest"])

    ship(pages.sparkSession)
    return pages.select(F.col(key).alias("key"), F.col("uri"), F.col(payload).cast("binary").alias("payload")).mapInArrow(run, schema)


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_shared: int = LEAST_SHARED,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """One record per row. Of rows with equal payloads of at least least_shared bytes one with the smallest
    key is a response, the others revisit it (of several rows with that key, any one); rows without any
    key in their group are responses. Null urls leave out the target, null payloads are empty, line breaks
    in urls are escaped, urls and payloads may have any length. Repeated rows are records of their own,
    further columns are ignored, an empty table gives archives without a record."""
    uri = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("uri")
    rows = with_payload_digests(pages.select(F.col(key), uri, F.col(payload)), key, payload)
    by_key = rows.where(F.col("size") >= least_shared).groupBy("digest", "key").agg(F.count("*").alias("n"))
    first = by_key.groupBy("digest").agg(
        F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("f"), F.sum("n").alias("n")
    )
    first = written(first.where("n > 1 AND f IS NOT NULL").select("digest", F.col("f.key").alias("first"), (F.col("f.n") > 1).alias("tied")), "firsts")
    found = rows.join(sized(first), "digest", "left")
    shared = F.col("first").isNotNull() & (F.col("size") >= least_shared)
    leads = shared & F.col("key").eqNullSafe(F.col("first"))
    if first.where("tied").limit(1).count():
        found = _one_leads(found, F.coalesce(leads & F.col("tied"), F.lit(False)))
        leads = leads & F.coalesce(F.col("place") == F.col("lead"), F.lit(True))
    revisit = shared & ~leads
    body = F.col("payload").cast("string")  # the bytes as they are
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, body))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    head = [
        F.lit(MAGIC),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        line("WARC-Record-ID", record_id(F.col("key"))),
        line("WARC-Page-Key", F.col("key").cast("string")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                record_id(F.col("first")),
                F.lit("\r\n"),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    ]
    found.select(F.concat(*head, block).alias("value")).write.option("lineSep", END).text(path)


def _one_leads(found: DataFrame, tied: Column) -> DataFrame:
    """found with place and lead: of the rows that share their digest and its smallest key, the one with place
    = lead is to be the response. They are written with their places, so that all see the same one."""
    heads = written(found.where(tied).withColumn("place", F.monotonically_increasing_id()), "heads")
    lead = written(heads.groupBy("digest").agg(F.min("place").alias("lead")), "leads")
    none = F.lit(None).cast("long")
    rest = found.where(~tied).withColumns({"place": none, "lead": none})
    return rest.unionByName(heads.join(sized(lead), "digest"))


# ---- reading


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between magics; of each block the rows come in file order."""
    found = spark.read.option("lineSep", MAGIC).text(path)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for x in head.split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _length(value: bytes) -> int | None:
    """Bytes from the end of the magic to the next record, by the header; null without a valid one."""
    end = value.find(END.encode())
    if end < 0:
        return None
    size = _fields(value[:end]).get("content-length", "")
    return end + 4 + int(size) + len(END) if size.isascii() and size.isdigit() and len(size) < 16 else None


class _Offsets:
    """Running offsets within each block, as its rows come by."""

    def __init__(self):
        self.at, self.now = None, 0

    def __call__(self, file: str, block: int, size: int) -> int:
        if self.at != (file, block):
            self.at, self.now = (file, block), 0
        found = self.now
        self.now += size + len(MAGIC)
        return found


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, next): of each piece the offset of the magic before it (negative for what
    precedes the first magic of a file) and of the successor by its header, null if it has none. The
    text isn't shuffled."""

    def run(batches):
        where = _Offsets()
        for b in batches:
            files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
            out = []
            for f, k, n, v in zip(files, blocks, b.column("n").to_pylist(), b.column("head"), strict=True):
                out.append((f, k, where(f, k, n), n, _length(v.as_py())))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, types)), ["file", "block", "rel", "n", "length"])

    ship(spark)
    first = F.substring("value", 1, MOST_HEADER)
    head = F.when(F.contains(first, F.lit(END.encode())), first).otherwise(F.col("value")).alias("head")
    head = _pieces(spark, path).select("file", "block", F.octet_length("value").alias("n"), head)
    found = written(head.mapInArrow(run, "file string, block bigint, rel bigint, n bigint, length bigint"), "candidates")
    base = written(_bases(found), "blocks")
    at = F.col("base") + F.col("rel") - len(MAGIC)
    return found.join(sized(base), ["file", "block"]).select(
        "file", "block", "base", at.alias("at"), (at + len(MAGIC) + F.col("length")).alias("next")
    )


def _bases(found: DataFrame) -> DataFrame:
    """(file, block, base): the offset of each block's first piece, from the sizes of those before."""
    total = found.groupBy("file", "block").agg(F.sum(F.col("n") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def reachable(found: DataFrame) -> DataFrame:
    """(file, at, owner): every candidate with the record that it belongs to: itself if the chain from the
    start of its file reaches it, else the last reachable one before it (null if there is none)."""
    real = found.where("at >= 0")
    inside = Window.partitionBy("file", "block").orderBy("at")
    linked = real.withColumn("follows", F.coalesce(F.lag("next").over(inside) == F.col("at"), F.lit(False)))
    linked = written(linked.withColumn("gap", F.coalesce(F.lead("at").over(inside) != F.col("next"), F.lit(True))), "links")
    # where a link over a gap lands, a run begins
    entries = linked.where("gap AND next IS NOT NULL").select("file", F.col("next").alias("at")).distinct()
    entered = linked.join(entries.withColumn("entered", F.lit(True)), ["file", "at"], "left")
    begins = ~F.col("follows") | F.coalesce("entered", F.lit(False))
    runs = written(entered.withColumn("run", F.sum(begins.cast("int")).over(inside)), "runs")
    links = runs.groupBy("file", "block", "run").agg(F.min("at").alias("start"), F.max_by("next", "at").alias("exit"))
    links = written(links, "run-links")
    kept = _jumped(links.select("file", "start", "exit"))
    alive = links.join(kept, ["file", "start"], "left_semi").select("file", "block", "run", F.lit(True).alias("alive"))
    marked = runs.join(alive, ["file", "block", "run"], "left").withColumn("own", F.when(F.col("alive"), F.col("at")))
    # the last reachable record of the block so far, else that of the blocks before
    so_far = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.groupBy("file", "block").agg(F.max("own").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "block", F.max("last").over(before).alias("carried"))
    return marked.join(carried, ["file", "block"]).select(
        "file", "at", F.coalesce(F.max("own").over(so_far), "carried").alias("owner")
    )


def _jumped(links: DataFrame) -> DataFrame:
    """(file, start) of the runs that pointer jumping from offset 0 reaches: in every round the reached
    ones step over their pointers, and the pointers double."""
    reached = links.where("start = 0").select("file", "start")
    jump = links.join(links.select("file", F.col("start").alias("exit")), ["file", "exit"], "left_semi")
    jump = jump.select("file", "start", "exit").where("exit > start")
    count = reached.count()
    for _ in range(MOST_ROUNDS):
        step = reached.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
        reached = written(reached.union(step).distinct(), "reached")
        now = reached.count()
        if now == count:
            return reached
        count = now
        twice = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("far"))
        jump = written(jump.join(twice, ["file", "exit"]).select("file", "start", F.col("far").alias("exit")), "jumps")
    raise RuntimeError(f"chains of more than 2^{MOST_ROUNDS} runs")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed archives: file, at (offset), id, type, uri, date, key, payload (without
    the HTTP header), payload_digest (computed; a revisit's from its header), refers_to.

    Bytes that no chain from a file's start reaches are left out. An empty folder gives no rows.
    """
    found = written(candidates(spark, path), "offsets")
    owners = written(reachable(found), "owners")
    base = written(found.select("file", "block", "base").distinct(), "bases")
    # pieces that are no record, and records that they were cut from; few, unless payloads are full of magics
    odd = owners.where("owner IS NULL OR owner != at")
    odd = written(
        odd.select("file", "at", "owner").union(
            odd.where("owner IS NOT NULL").select("file", F.col("owner").alias("at"), "owner").distinct()
        ),
        "cut",
    )

    def place(batches):
        where = _Offsets()
        for b in batches:
            files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
            sizes = [len(x.as_py()) for x in b.column("value")]
            rel = [where(f, k, n) for f, k, n in zip(files, blocks, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("block"), pa.array(rel, pa.int64()), b.column("value")], ["file", "block", "rel", "value"]
            )

    ship(spark)
    placed = _pieces(spark, path).mapInArrow(place, "file string, block bigint, rel bigint, value binary")
    placed = placed.join(sized(base), ["file", "block"])
    placed = placed.select("file", (F.col("base") + F.col("rel") - len(MAGIC)).alias("at"), "value").where("at >= 0")
    told = placed.join(sized(odd.withColumn("cut", F.lit(True))), ["file", "at"], "left")
    told = told.withColumn("cut", F.coalesce("cut", F.lit(False)))
    whole = told.where("NOT cut").select("file", "at", "value")
    if odd.limit(1).count():
        parts = told.where("cut AND owner IS NOT NULL").groupBy("file", F.col("owner")).agg(
            F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts")
        )
        # a payload that was cut at its magics is one row when it is whole, so its parts fit in one too
        again = F.expr(f"aggregate(parts, cast(null as binary), (a, x) -> coalesce(a || cast('{MAGIC[:-2]}\\r\\n' as binary) || x.value, x.value))")
        whole = whole.union(parts.select("file", F.col("owner").alias("at"), again.alias("value")))
    return whole.mapInArrow(_parsed, RECORD)


def _parsed(batches):
    names = [x.split()[0] for x in RECORD.split(", ")]
    for b in batches:
        rows = []
        for f, at, v in zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("value"), strict=True):
            value = v.as_py()
            end = value.find(END.encode())
            head = _fields(value[:end])
            block = value[end + 4 : end + 4 + int(head["content-length"])]
            body = block
            if head.get("content-type", "").startswith("application/http"):
                body = block.partition(END.encode())[2]
            kind = head.get("warc-type")
            own = head.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else digest(body)
            rows.append(
                (f, at, head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"))
                + (head.get("warc-page-key"), body, own, head.get("warc-refers-to"))
            )
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        types = [pa.binary() if n == "payload" else pa.int64() if n == "at" else pa.string() for n in names]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, types)), names)


def with_referred(records: DataFrame) -> DataFrame:
    """(id, type, key, payload_digest, refers_to, payload_bytes) of records: payload_bytes is the payload's size,
    of a revisit that of the record with the id and digest that it refers to (null if that one is missing).
    Repeated ids don't mix, repeated records are returned as often as they occur, none give none."""
    small = written(
        records.select("id", "type", "key", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("own")),
        "sizes",
    )
    by = ["id", "payload_digest"]
    asked = small.where("type = 'revisit'").select(F.col("refers_to").alias("id"), "payload_digest").distinct()
    sizes = small.where("type != 'revisit'").join(asked, by, "left_semi").groupBy(*by).agg(F.max("own").alias("far"))
    sizes = written(sizes, "referred").withColumnRenamed("id", "refers_to")
    found = small.join(sized(sizes), ["refers_to", "payload_digest"], "left")
    return found.withColumn("payload_bytes", F.when(F.col("type") == "revisit", F.col("far")).otherwise(F.col("own")))


def archive_folder(spark: SparkSession) -> str:
    """A new path in the shared folder for archives."""
    return scratch(spark, "warc")
