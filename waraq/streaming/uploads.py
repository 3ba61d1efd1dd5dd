"""The state of every document as a stream of uploads and deletions goes by.

State is kept by document in Spark's state store: the latest upload, the last deletion, and how often it was uploaded. All
of these are aggregates that partitions put together before they exchange rows, so a document that a large share of
the events name is no hot key, and each restart goes on from the checkpoint.

Every micro-batch gives the documents that it changed, as they now stand, in a folder named by the batch's number. A
batch that is tried again after a failure replaces its folder with the same rows, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "doc_id string, seq long, filename string, deleted_seq long, uploads long"


def document_state(events: DataFrame) -> DataFrame:
    """doc_id, seq, filename, deleted_seq, uploads of each document. ``events`` has doc_id, seq, deleted and filename, and may stream.

    seq and filename are those of the latest upload, null before there is one. Order of arrival does not matter, only seq.
    Null ids are one document. Events that repeat in the input count each.
    """
    upload = ~F.col("deleted")
    latest = F.max(F.when(upload, F.struct("seq", "filename"))).alias("latest")
    state = events.groupBy("doc_id").agg(latest, F.max(F.when(F.col("deleted"), F.col("seq"))).alias("deleted_seq"), F.count_if(upload).alias("uploads"))
    return state.select("doc_id", "latest.seq", "latest.filename", "deleted_seq", "uploads")


def write_changes(changes: DataFrame, batch: int, folder: str) -> None:
    changes.write.mode("overwrite").parquet(f"{folder}/documents/batch={batch}")


def follow(events: DataFrame, folder: str, checkpoint: str, sink: Callable[[DataFrame, int, str], None] = write_changes) -> StreamingQuery:
    """Start the stream over ``events``; takes what is there in micro-batches, then ends."""
    changes = document_state(events).writeStream.outputMode("update")
    return changes.foreachBatch(lambda df, batch: sink(df, batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, seq, filename, uploads, live of every document, from the last batch that changed it."""
    rows = spark.read.schema(CHANGES + ", batch long").parquet(f"{folder}/documents")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("seq", "filename", "deleted_seq", "uploads"), "batch").alias("s"))
    live = F.col("s.seq").isNotNull() & (F.col("s.deleted_seq").isNull() | (F.col("s.seq") > F.col("s.deleted_seq")))
    return last.select("doc_id", "s.seq", "s.filename", "s.uploads", live.alias("live"))
