"""Pages of uploaded files, read by ranges of pages, so that one huge file is work for many tasks.

Files are listed and measured first (one small row each). Every file is then cut into ranges of pages, the ranges are dealt
over tasks, and a task opens its file anew and gives the pages of its range one by one. Neither a file's content nor its
images pass through an exchange, and a task holds a few pages at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import IO, Protocol
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.operators.ingest import document_id, file_name, is_pdf

PAGES_PER_RANGE, PAGES_PER_BATCH = 50, 16
#: A page with this many solid characters or fewer is a scan, for which an image is made.
LEAST_SOLID = 50


class Opener(Protocol):
    """How a file format is read. Instances are sent to tasks."""

    def count(self, file: IO[bytes]) -> int:
        """The file's pages."""

    def read(self, file: IO[bytes], first: int, last: int) -> Iterator[tuple[int, str, Callable[[], bytes | None], bytes | None]]:
        """Number, raw text, a maker of the grey image, and preview of the pages ``first`` to ``last``, from 1."""


class Fitz:
    """PDF by PyMuPDF: the grey image at ``image_scale`` and the colour preview at ``preview_scale``, as PNG."""

    def __init__(self, preview_scale: float = 0.6, image_scale: float = 2.5):
        self.preview_scale, self.image_scale = preview_scale, image_scale

    def _open(self, file: IO[bytes]):
        import fitz

        return fitz.open(stream=file.read(), filetype="pdf")

    def count(self, file: IO[bytes]) -> int:
        with self._open(file) as doc:
            return doc.page_count

    def read(self, file: IO[bytes], first: int, last: int) -> Iterator[tuple[int, str, Callable[[], bytes | None], bytes | None]]:
        import fitz

        def picture(page, scale: float, colours) -> bytes:
            return page.get_pixmap(matrix=fitz.Matrix(scale, scale), colorspace=colours, alpha=False).tobytes("png")

        with self._open(file) as doc:
            for number in range(first, last + 1):
                page = doc[number - 1]
                yield number, page.get_text(), lambda page=page: picture(page, self.image_scale, fitz.csGRAY), picture(page, self.preview_scale, fitz.csRGB)


def open_path(path: str) -> IO[bytes]:
    """A file of any store that Arrow reads (local, HDFS, S3, GCS), by its URI."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:  # Spark writes file:/a b, which is no URI
        return fs.LocalFileSystem().open_input_file("/" + unquote(rest if rest else path).lstrip("/"))
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _counts(opener: Opener):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = []
            for path in batch["path"]:
                try:
                    with open_path(path) as file:
                        pages.append(opener.count(file))
                except Exception:  # a broken file has no pages, and is told by that
                    pages.append(0)
            yield batch.assign(pages=pages)

    return run


PAGE_COLUMNS = ["doc_id", "seq", "page", "raw_text", "image", "preview"]


def page_rows(doc_id: str, seq: int, pages: Iterator[tuple[int, str, Callable[[], bytes | None], bytes | None]]) -> Iterator[tuple]:
    """Rows of ``PAGE_COLUMNS`` of what an opener reads; the image is made only for scans."""
    for number, raw, image, preview in pages:
        scan = len("".join(raw.split())) <= LEAST_SOLID
        yield doc_id, seq, number, raw, image() if scan else None, preview


def _pages(opener: Opener):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with open_path(row.path) as file:
                    rows = page_rows(row.doc_id, row.seq, opener.read(file, int(row.first), int(row.last)))
                    while held := list(itertools.islice(rows, PAGES_PER_BATCH)):
                        yield pd.DataFrame(held, columns=PAGE_COLUMNS)

    return run


def uploaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, filename, uploaded_at of the PDF files under a folder: contents are hashed where they are read. Empty
    files are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    rows = files.select(document_id(F.col("content")).alias("doc_id"), "path", F.url_decode(file_name(F.col("path"))).alias("filename"), F.col("modificationTime").alias("uploaded_at"))
    return rows.filter(is_pdf(F.col("filename")))


def page_ranges(files: DataFrame, opener: Opener, size: int = PAGES_PER_RANGE) -> DataFrame:
    """``files`` (path and more) with pages, first and last: one row per range of ``size`` pages. Files that cannot be read have none."""
    counted = files.mapInPandas(_counts(opener), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", pages int")
    starts = F.explode(F.sequence(F.lit(1), F.col("pages"), F.lit(size))).alias("first")
    return counted.filter("pages > 0").select("*", starts).withColumn("last", F.least(F.col("first") + size - 1, "pages"))


def read_pages(files: DataFrame, opener: Opener | None = None, size: int = PAGES_PER_RANGE, tasks: int | None = None) -> DataFrame:
    """doc_id, seq, page, raw_text, image, preview: one row per page. ``files``: doc_id, seq, path.

    Ranges are dealt over ``tasks`` tasks (as many as the session's shuffle has, where not given), whatever file they are
    of. The image is made only for pages of ``LEAST_SOLID`` solid characters or fewer. Broken files have no rows. Empty table: no rows.
    """
    opener = opener or Fitz()
    ranges = page_ranges(files.select("doc_id", "seq", "path"), opener, size)
    dealt = ranges.repartition(tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "first")
    kind = files.schema["seq"].dataType.simpleString()
    return dealt.mapInPandas(_pages(opener), f"doc_id string, seq {kind}, page int, raw_text string, image binary, preview binary")
