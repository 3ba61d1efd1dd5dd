"""Listing of documents, badges and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.functions.rules import BADGES, OTHER_BADGE, VERSION


def badge(filename: Column) -> Column:
    """A label by a word in the lower-cased file name; the first word that is there decides."""
    name = F.lower(filename)
    out = F.lit(OTHER_BADGE)
    for word, label in reversed(BADGES):
        out = F.when(F.contains(name, F.lit(word)), label).otherwise(out)
    return out


def page_label(kind: Column) -> Column:
    return F.when(kind == "native", "أصلي").otherwise("OCR")


def list_documents(docs: DataFrame) -> DataFrame:
    """doc_id, filename, nb_pages, indexed (ISO text, empty if unknown), badge."""
    indexed = F.coalesce(F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    return docs.select("doc_id", "filename", "nb_pages", indexed.alias("indexed"), badge(F.col("filename")).alias("badge"))


def day(indexed: Column) -> Column:
    return F.substring(indexed, 1, 10)


def page_html(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def health(documents: DataFrame) -> DataFrame:
    """status, version, documents: one row, given by an engine that can read its documents."""
    return documents.agg(F.count(F.lit(1)).alias("documents")).select(F.lit("ok").alias("status"), F.lit(VERSION).alias("version"), "documents")
