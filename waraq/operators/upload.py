"""The upload pipeline: identity, pages, kinds, cache or recognition, cache write, index and answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.functions.correction import Corrections
from waraq.functions.rules import CORRECTIONS
from waraq.operators import ingest
from waraq.operators.index import index_pages
from waraq.runtime import materialize
from waraq.sources.tables import append_cache


def upload(uploads: DataFrame, cache: DataFrame | None, explode: Callable[[DataFrame], DataFrame], first, second, cache_path: str, corrections: Corrections = CORRECTIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take ``uploads`` (seq, doc_id, filename, content) in: (pages, page index, responses).

    ``explode`` turns uploads into pages (doc_id, seq, page, raw_text, image, preview). Documents that the cache has take its
    texts; the scan pages of all others are recognised by ``first``, then ``second`` (see :func:`ingest.recognise`), and are added to the
    cache at ``cache_path``. Of uploads of one document in a batch the latest counts for the answer, and each for the
    index, as repeated uploads count their words again. Documents without pages have no answer. Empty table: nothing.
    """
    pages = materialize(ingest.classify(explode(uploads), corrections), "uploaded-pages")
    if cache is None:
        known = pages.withColumn("from_cache", F.lit(False)).limit(0)
        left = pages
    else:
        known = ingest.overlay_cache(pages.join(cache.select("doc_id").distinct(), "doc_id", "left_semi"), cache)
        left = ingest.cache_misses(pages, cache)
    read = ingest.recognise(left, first, second, corrections).withColumn("from_cache", F.lit(False))
    done = materialize(known.unionByName(read), "recognised-pages")
    latest = ingest.latest(uploads.select("doc_id", "seq", "filename"), "doc_id")
    current = done.join(latest.select("doc_id", "seq"), ["doc_id", "seq"], "left_semi")
    append_cache(current, cache, cache_path)
    return done, index_pages(done), ingest.upload_response(current, latest)
