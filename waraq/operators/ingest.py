"""From uploaded files to pages: identity, page kinds, summaries, the text cache, OCR fallback, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.functions.correction import Corrections, correct_text
from waraq.functions.rules import DEFAULT_MODEL, PAGE_HEADING, CORRECTIONS, VISION_MODELS
from waraq.functions.text import is_native, strip


def document_id(content: Column) -> Column:
    """A document is its content: the MD5 of its bytes."""
    return F.md5(content)


def is_pdf(filename: Column) -> Column:
    return F.endswith(F.lower(filename), F.lit(".pdf"))


def file_name(path: Column) -> Column:
    """The last part of a path: uploads never leave the store's folder."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row with the greatest seq of each key: the current file of a name, or the current name of a document.

    An aggregate, so every partition hands on one row a key, however many uploads the key has.
    """
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "seq").alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


def classify(pages: DataFrame, corrections: Corrections = CORRECTIONS) -> DataFrame:
    """``pages`` with type (native or scan, by the raw text) and text (stripped, then corrected)."""
    kind = F.when(is_native(F.col("raw_text")), "native").otherwise("scan")
    return pages.withColumns({"type": kind, "text": correct_text(strip(F.col("raw_text")), corrections)})


def summarize(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, nb_pages, n_native, n_scan, doc_type. ``documents`` adds those without any page, which count as scans."""
    out = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nb_pages"), F.count_if(F.col("type") == "native").alias("n_native"))
    if documents is not None:
        out = documents.select("doc_id").distinct().join(out, "doc_id", "left").fillna(0, ["nb_pages", "n_native"])
    out = out.withColumn("n_scan", F.col("nb_pages") - F.col("n_native"))
    kind = F.when(F.col("n_native") == 0, "scan").when(F.col("n_scan") == 0, "native").otherwise("mixed")
    return out.withColumn("doc_type", kind)


def overlay_cache(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """``pages`` with the cached text of a page wherever the cache has that page, whatever the text; adds from_cache."""
    cached = cache.select("doc_id", "page", F.col("text").alias("_text"), F.lit(True).alias("_there"))
    text = F.when(F.col("_there"), F.col("_text")).otherwise(F.col("text"))
    joined = pages.join(cached, ["doc_id", "page"], "left")
    return joined.withColumns({"text": text, "from_cache": F.coalesce("_there", F.lit(False))}).drop("_text", "_there")


def cache_misses(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages of the documents that the cache does not have: what is left to recognise, and then to add to the cache."""
    return pages.join(cache.select("doc_id").distinct(), "doc_id", "left_anti")


# OCR


def pick_model(available: Column, candidates: tuple[str, ...] = VISION_MODELS, fallback: str = DEFAULT_MODEL) -> Column:
    """The first candidate that is available, in the candidates' order."""
    wanted = F.array(*[F.lit(c) for c in candidates])
    return F.coalesce(F.get(F.array_intersect(wanted, available), F.lit(0)), F.lit(fallback))


def is_error(text: Column) -> Column:
    return F.startswith(text, F.lit("[ERR"))


def choose_ocr(first: Column, second: Column, corrections: Corrections = CORRECTIONS) -> Column:
    """The first recogniser's text, unless it is missing or an error; then the second's. Good text is corrected once more.

    An empty text is a success. What is missing altogether becomes empty; an error text is kept.
    """
    taken = F.when(first.isNull() | is_error(first), second).otherwise(first)
    return F.coalesce(F.when((taken != "") & ~is_error(taken), correct_text(taken, corrections)).otherwise(taken), F.lit(""))


def recognise(pages: DataFrame, first, second, corrections: Corrections = CORRECTIONS) -> DataFrame:
    """Fill the text of scan pages from their images. ``first`` and ``second`` take a pandas Series of image bytes and
    return one of texts; None or a text that starts with [ERR is a failure. The second sees only the first's failures.

    Native pages pass through. Pages are spread evenly first, as recognition costs far more than the exchange.
    """
    scans = pages.filter(F.col("type") == "scan")
    spread = scans.repartition(F.col("doc_id"), F.col("page"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one = _guarded(first, batch["image"])
            failed = one.isna() | one.fillna("").str.startswith("[ERR")
            two = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if failed.any():
                two[failed] = _guarded(second, batch["image"][failed])
            yield batch.assign(_one=one, _two=two)

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    read = spread.mapInPandas(run, named + ", _one string, _two string")
    fix = lambda c: F.when(F.col(c).isNull() | is_error(F.col(c)), F.col(c)).otherwise(correct_text(strip(F.col(c)), corrections))
    done = read.withColumns({"_one": fix("_one"), "_two": fix("_two")}).withColumn("text", choose_ocr(F.col("_one"), F.col("_two"), corrections)).select(*pages.columns)
    return pages.filter(~F.col("type").eqNullSafe("scan")).unionByName(done)


def _guarded(recogniser, images: pd.Series) -> pd.Series:
    """The recogniser's texts; an exception of its own becomes an error text for each page of the batch."""
    try:
        return pd.Series(list(recogniser(images)), index=images.index, dtype=object)
    except Exception as error:  # an external engine may fail in any way; the text says so and stays searchable
        return pd.Series([f"[ERR {type(error).__name__}: {error}]"] * len(images), index=images.index, dtype=object)


# Exports


def export_text(pages: DataFrame, order: str = "page") -> DataFrame:
    """doc_id, text: the pages under headings, by ``order`` (page number, or the place in the upload)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "page", F.coalesce("text", F.lit("")).alias("text"))))
    parts = F.transform(entries, lambda p: F.concat(F.format_string(PAGE_HEADING, p["page"]), p["text"]))
    return pages.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def plain_base64(content: Column) -> Column:
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def upload_response(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, response: the JSON answer to an upload, with its pages and their previews in base64."""
    page = F.struct(F.col("page").alias("num"), "type", "text", F.coalesce(plain_base64(F.col("preview")), F.lit("")).alias("preview_b64"))
    listed = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.bool_and("from_cache").alias("from_cache"))
    whole = summarize(pages).join(listed, "doc_id").join(docs.select("doc_id", "filename"), "doc_id")
    return whole.select("doc_id", F.to_json(F.struct("doc_id", "filename", "nb_pages", "n_native", "n_scan", "doc_type", "from_cache", "pages")).alias("response"))
