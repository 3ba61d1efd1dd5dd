"""Structured Streaming ingest: pages of uploads flow into the page index and mergeable word counts.

Uploads are not deduplicated: a repeated upload counts its words again, as in batch. Every micro-batch writes its own
folder, named by its number, so a batch that is tried again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waraq.operators.index import index_pages, merge_counts, page_tokens, surface_counts


def write_batch(pages: DataFrame, batch: int, folder: str) -> None:
    """One micro-batch: indexed pages, and the counts of its words."""
    path = f"{folder}/page_index/batch={batch}"
    index_pages(pages).write.mode("overwrite").parquet(path)
    index = pages.sparkSession.read.parquet(path)  # so the batch itself is computed once
    surface_counts(page_tokens(index)).write.mode("overwrite").parquet(f"{folder}/vocab_forms/batch={batch}")


def ingest(pages: DataFrame, folder: str, checkpoint: str, sink: Callable[[DataFrame, int, str], None] = write_batch) -> StreamingQuery:
    """Start the stream over ``pages`` (doc_id, seq, page, text, streaming); takes what is there, then ends."""
    return pages.writeStream.foreachBatch(lambda df, batch: sink(df, batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_counts(spark: SparkSession, folder: str) -> DataFrame:
    """norm, surface, cnt, first_seq over all micro-batches: the deltas added up."""
    return merge_counts(spark.read.parquet(f"{folder}/vocab_forms").drop("batch"))


def upload_rate(uploads: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Uploads and bytes per window of the upload time; late rows are taken up to ``lateness``."""
    timed = uploads.withWatermark("uploaded_at", lateness)
    return timed.groupBy(F.window("uploaded_at", window).alias("w")).agg(F.count(F.lit(1)).alias("uploads"), F.sum(F.octet_length("content")).alias("bytes")).select(F.col("w.start").alias("start"), "uploads", "bytes")
