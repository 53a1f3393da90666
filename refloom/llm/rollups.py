"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is summed by group and committed as one folder, whose name is that of the batch; the
folder appears by a rename, so a batch is there as a whole or not at all, and a batch that was committed
before isn't counted again. Totals are the sums over all batches. Compaction writes their sum, and then
one note that names the sum and the batches in it; the note appears by a rename too. From then on the sum
counts in their place, whether or not their folders have been removed yet.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.bpe import Vocabulary, encoded
from refloom.llm.common import words_of
from refloom.session import hadoop_path

GROUP = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint"

#: Tokenizer versions that SQL can count.
COUNTERS = {
    "space-1": lambda text: F.size(words_of(text)),
    "letter-2": lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+")),
}


def counted(docs: DataFrame, *versions: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, source, lang, version, tokens): every row by each of the versions (of COUNTERS). Narrow rows, so
    what is joined or shuffled later has no text. Null and empty texts have no token, whole texts count;
    null ids, sources and languages stay; repeated rows count each; further columns are ignored; an empty
    table gives no rows."""
    each = (F.struct(F.lit(v).alias("version"), COUNTERS[v](F.col(text)).cast("long").alias("tokens")) for v in versions)
    return docs.select(F.col(id).alias("id"), "source", "lang", F.inline(F.array(*each)))


def counted_by(docs: DataFrame, vocabulary: Vocabulary, version: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Like counted, by the tokens of a vocabulary; version is its name in the totals."""
    own = docs.select(F.col(id).alias("id"), "source", "lang", F.col(text).alias("text"))
    found = encoded(own, vocabulary, keep_ids=False)
    return found.select("id", "source", "lang", F.lit(version).alias("version"), F.col("n_tokens").alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add counted rows; none for no rows, repeated rows each."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take counted rows away again."""
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from the counts of the same rows before and after: their old counts leave, their new ones
    come, whatever group they are in."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals in a folder of any file system that Spark knows; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self, folder: str) -> list[str]:
        fs, at = hadoop_path(self.spark, f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _note(self) -> dict:
        """The last compaction: its sum's folder, and the batches in it."""
        names = self._listed("notes")
        if not names:
            return {"sum": None, "batches": []}
        fs, at = hadoop_path(self.spark, f"{self.path}/notes/{names[-1]}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def committed(self, batch: str) -> bool:
        name = quote(batch, safe="")
        return name in self._listed("batches") or name in self._note()["batches"]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add signed changes (GROUP, docs, tokens) under the name of a batch; false, and nothing done, if it
        was committed before. Null groups are groups of their own; null tokens count as none; no rows are
        a batch as well."""
        if self.committed(batch):
            return False
        summed = changes.groupBy(*GROUP).agg(
            F.sum("docs").cast("long").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")
        )
        draft = f"drafts/{uuid.uuid4().hex}"
        summed.write.parquet(f"{self.path}/{draft}")
        return self._place(draft, f"batches/{quote(batch, safe='')}")

    def _place(self, draft: str, goal: str) -> bool:
        """The commit: a draft appears under its name, unless that is taken."""
        fs, at = hadoop_path(self.spark, f"{self.path}/{draft}")
        _, to = hadoop_path(self.spark, f"{self.path}/{goal}")
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(at, to):
            fs.delete(at, True)
            return False
        return True

    def folders(self) -> list[str]:
        """What counts now: the last sum, and the batches that aren't in it."""
        note = self._note()
        gone = set(note["batches"])
        found = [f"batches/{b}" for b in self._listed("batches") if b not in gone]
        return [f"{self.path}/{x}" for x in ([note["sum"]] if note["sum"] else []) + found]

    def totals(self) -> DataFrame:
        """(GROUP, docs, tokens) over all batches; groups that came to nothing stay out."""
        found = self.folders()
        every = self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)
        return every.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(
            "docs != 0 OR tokens != 0"
        )

    def compact(self) -> None:
        """Replace all batches by their sum. A crash before the note appears leaves everything as it was; after
        it, only folders that no longer count, which the next compaction removes."""
        note, batches = self._note(), self._listed("batches")
        fresh = [b for b in batches if b not in set(note["batches"])]
        if fresh:
            place = f"sums/{uuid.uuid4().hex}"
            self.totals().write.parquet(f"{self.path}/{place}")
            draft = f"drafts/{uuid.uuid4().hex}"
            fs, at = hadoop_path(self.spark, f"{self.path}/{draft}")
            stream = fs.create(at, False)
            stream.write(json.dumps({"sum": place, "batches": note["batches"] + fresh}).encode())
            stream.close()
            number = len(self._listed("notes"))
            if not self._place(draft, f"notes/{number:012d}"):
                raise RuntimeError(f"another writer compacted {self.path}")
        kept = self._note()
        for name in self._listed("batches"):
            if name in set(kept["batches"]):
                self._drop(f"batches/{name}")
        for name in self._listed("sums"):
            if f"sums/{name}" != kept["sum"]:
                self._drop(f"sums/{name}")

    def _drop(self, name: str) -> None:
        fs, at = hadoop_path(self.spark, f"{self.path}/{name}")
        fs.delete(at, True)
