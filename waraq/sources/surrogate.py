"""Adapters that give the driver's Latin-script tables the shape of uploaded Arabic documents.

A fixed letter-for-letter map turns text into surrogate Arabic; it is the same expression in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.runtime import spread, table

LATIN = "etaoinshrdlcumwfgypbvkjxqzéèêçäöüßóñíáú"
ARABIC = "امللعانوسهربدتفحكقيجخطشزغضىةأإآئؤثذءظصة"


def surrogate(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, ARABIC)


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, page, raw_text: each line of a document as a page."""
    lines = F.posexplode(F.split(surrogate(F.coalesce(F.col("text"), F.lit(""))), "\n", -1)).alias("page", "raw_text")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("seq"), lines)
    return rows.select(F.col("seq").cast("string").alias("doc_id"), "seq", (F.col("page") + 1).alias("page"), "raw_text")


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, page, raw_text: each turn of a conversation as a page."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("conv_id").alias("seq"), (F.col("turn") + 1).cast("int").alias("page"), surrogate(F.col("text")).alias("raw_text"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, doc_id, filename, content, uploaded_at: each document as an upload; files are named by source, so names repeat."""
    rows = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return rows.select(F.col("doc_id").alias("seq"), F.md5(content).alias("doc_id"), F.concat("source", F.lit(".PDF")).alias("filename"), content.alias("content"), when.alias("uploaded_at"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: words 2 to 5 of each benchmark item."""
    picked = F.array_join(F.slice(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "), 2, 4), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), surrogate(picked).alias("query"))
