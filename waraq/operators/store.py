"""An index that grows by batches: mergeable tables, tombstones, compaction.

Under the store's folder a generation holds one folder per batch, and a batch is there once its marker is. So a batch
that was cut off is not seen, one that is written again replaces itself, and neither is counted twice. Compaction writes
the next generation beside the one in use and then marks it; readers take the newest that is marked. It keeps the
numbers of the batches that it took in, so that one of them that comes again is known.

One writer at a time is assumed, as with any log; readers need no care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.operators.index import index_pages, live_uploads, merge_counts, page_tokens, surface_counts

_TABLES = {
    "pages": "doc_id string, seq long, page int, text string, norm_text string",
    "forms": "norm string, surface string, cnt long, first_seq struct<seq:long,page:int,pos:int>",
    "deletions": "doc_id string, seq long",
    "taken": "batch long",
}
_MARKER = "_COMPLETE"


def current_pages(pages: DataFrame, deletions: DataFrame) -> DataFrame:
    """Of each document the pages of its latest upload, if that came after its last deletion."""
    live = live_uploads(pages, deletions)
    latest = live.groupBy("doc_id").agg(F.max("seq").alias("seq"))
    return live.join(latest, ["doc_id", "seq"], "left_semi")


class IndexStore:
    """The index under ``folder``. Batches have numbers of the caller's choice (a stream's batch number, say)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # folders and markers

    def _numbers(self, folder: str, head: str) -> list[int]:
        """The numbers of a folder's marked parts."""
        if not self._fs.exists(self._path(folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))]
        found = [int(n.removeprefix(head)) for n in names if n.startswith(head)]
        return sorted(n for n in found if self._fs.exists(self._path(f"{folder}/{head}{n}/{_MARKER}")))

    def _mark(self, folder: str) -> None:
        self._fs.create(self._path(f"{folder}/{_MARKER}"), True).close()

    def generation(self) -> int:
        return max(self._numbers(self.folder, "gen="), default=0)

    def batches(self) -> list[int]:
        """The batches of the current generation that were not compacted yet."""
        return self._numbers(f"{self.folder}/gen={self.generation()}", "batch=")

    def _read(self, name: str) -> DataFrame:
        gen = f"{self.folder}/gen={self.generation()}"
        parts = [f"{gen}/batch={b}/{name}" for b in self.batches()]
        if self._fs.exists(self._path(f"{gen}/base/{name}")):
            parts.append(f"{gen}/base/{name}")
        there = [p for p in parts if self._fs.exists(self._path(p))]
        return self.spark.read.schema(_TABLES[name]).parquet(*there) if there else self.spark.createDataFrame([], _TABLES[name])

    # writing

    def append(self, batch: int, pages: DataFrame, deletions: DataFrame | None = None) -> bool:
        """Add a batch: ``pages`` (doc_id, seq, page, text) and ``deletions`` (doc_id, seq). Returns whether it was new to
        what compaction took in; a batch that is there but not compacted is written again in its place.

        The work is that of the batch: nothing that is there is read or written.
        """
        if self._read("taken").filter(F.col("batch") == batch).count():
            return False
        folder = f"{self.folder}/gen={self.generation()}/batch={batch}"
        self._fs.delete(self._path(folder), True)
        index_pages(pages).write.parquet(f"{folder}/pages")
        written = self.spark.read.schema(_TABLES["pages"]).parquet(f"{folder}/pages")  # so the batch is computed once
        surface_counts(page_tokens(written)).write.parquet(f"{folder}/forms")
        if deletions is not None:
            deletions.select("doc_id", F.col("seq").cast("long").alias("seq")).write.parquet(f"{folder}/deletions")
        self._mark(folder)
        return True

    def compact(self) -> None:
        """Write what the batches add up to as the base of the next generation: current pages, counts by written form, and
        the last deletion of each document, which holds for uploads that come late."""
        gen, batches = self.generation(), self.batches()
        base = f"{self.folder}/gen={gen + 1}/base"
        self._fs.delete(self._path(f"{self.folder}/gen={gen + 1}"), True)
        self.pages().write.parquet(f"{base}/pages")
        self.forms().write.parquet(f"{base}/forms")
        self._read("deletions").groupBy("doc_id").agg(F.max("seq").alias("seq")).write.parquet(f"{base}/deletions")
        self._read("taken").unionByName(self.spark.createDataFrame([(b,) for b in batches], _TABLES["taken"])).coalesce(1).write.parquet(f"{base}/taken")
        self._mark(f"{self.folder}/gen={gen + 1}")

    def remove_old(self) -> None:
        """Delete the generations before the current one, once no reader is at them."""
        for gen in range(self.generation()):
            self._fs.delete(self._path(f"{self.folder}/gen={gen}"), True)

    # reading

    def pages(self) -> DataFrame:
        """doc_id, seq, page, text, norm_text of all current documents."""
        return current_pages(self._read("pages"), self._read("deletions"))

    def forms(self) -> DataFrame:
        """norm, surface, cnt, first_seq over all uploads: deletions leave the words, and a repeated upload counts again."""
        return merge_counts(self._read("forms"))
