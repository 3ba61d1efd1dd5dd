"""The index: searchable pages, tokens, vocabulary and the list of documents.

The vocabulary is an aggregate over the log of all uploads and never shrinks; documents are the latest state. So a
repeated upload counts its words again, and a deletion leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.functions.text import normalize, strip, tokens

SHORTEST_PAGE, SHORTEST_WORD = 5, 2
#: Above any page number, shifted by 31 bits, plus position: pages up to 250 million, positions up to 2 thousand million.
_PLACES = 600_000_000_000_000_000


def index_pages(pages: DataFrame) -> DataFrame:
    """doc_id, seq, page, text, norm_text of the pages whose stripped text has ``SHORTEST_PAGE`` characters or more."""
    text = F.coalesce("text", F.lit(""))
    return pages.filter(F.length(strip(text)) >= SHORTEST_PAGE).select("doc_id", "seq", "page", text.alias("text"), normalize(text).alias("norm_text"))


def page_tokens(pages: DataFrame) -> DataFrame:
    """seq, doc_id, page, pos, surface, norm of every Arabic token whose normal form has two letters or more.

    ``pages`` are indexed pages of the upload log. pos counts all tokens of a page from 0.
    """
    spread = pages.select("seq", "doc_id", "page", F.posexplode(tokens(F.col("text"))).alias("pos", "surface"))
    return spread.withColumn("norm", normalize(F.col("surface"))).filter(F.length("norm") >= SHORTEST_WORD)


def surface_counts(tokens_: DataFrame) -> DataFrame:
    """norm, surface, cnt, first_seq: how often each written form of a word occurs, and where first.

    The place is one number while it is aggregated (a struct would make Spark sort all tokens before it adds them up).
    """
    inside = F.shiftleft(F.col("page").cast("long"), 31) + F.col("pos")
    place = F.col("seq").cast("decimal(19,0)") * F.lit(_PLACES).cast("decimal(18,0)") + inside.cast("decimal(19,0)")
    counted = tokens_.groupBy("norm", "surface").agg(F.count(F.lit(1)).alias("cnt"), F.min(place.cast("decimal(38,0)")).alias("place"))
    rest = F.expr(f"cast(place % {_PLACES} as bigint)")
    first = F.struct(F.expr(f"place div {_PLACES}").cast("long").alias("seq"), F.shiftright(rest, 31).cast("int").alias("page"), rest.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"))
    return counted.select("norm", "surface", "cnt", first.alias("first_seq"))


def merge_counts(*forms: DataFrame) -> DataFrame:
    """Counts of several logs as those of all of them: sums add up and the first place is the smallest."""
    every = forms[0]
    for more in forms[1:]:
        every = every.unionByName(more)
    return every.groupBy("norm", "surface").agg(F.sum("cnt").alias("cnt"), F.min("first_seq").alias("first_seq"))


def vocabulary(forms: DataFrame) -> DataFrame:
    """norm, n, best_form, first_seq. The best form is the most frequent; of equals the one that came first."""
    return forms.groupBy("norm").agg(F.sum("cnt").alias("n"), F.min_by("surface", F.struct(-F.col("cnt"), "first_seq")).alias("best_form"), F.min("first_seq").alias("first_seq"))


def vocabulary_view(forms: DataFrame) -> DataFrame:
    """norm, entry: the nested form of the vocabulary, with a map of written forms and the total."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "cnt"))))
    return forms.groupBy("norm").agg(F.struct(pairs.alias("f"), F.sum("cnt").alias("n")).alias("entry"))


def document_table(uploads: DataFrame, summary: DataFrame) -> DataFrame:
    """doc_id, filename, nb_pages, indexed_at, first_seq: the latest name and time, and the first upload's place."""
    last = F.max_by(F.struct("filename", "uploaded_at"), "seq").alias("last")
    state = uploads.groupBy("doc_id").agg(last, F.min("seq").alias("first_seq"))
    joined = state.join(summary.select("doc_id", "nb_pages"), "doc_id", "left")
    return joined.select("doc_id", "last.filename", F.coalesce("nb_pages", F.lit(0).cast("long")).alias("nb_pages"), F.col("last.uploaded_at").alias("indexed_at"), "first_seq")


def live_uploads(uploads: DataFrame, deletions: DataFrame) -> DataFrame:
    """Uploads after the last deletion of their document. ``deletions``: doc_id, seq. Unknown ids delete nothing."""
    gone = deletions.groupBy("doc_id").agg(F.max("seq").alias("_gone"))
    return uploads.join(gone, "doc_id", "left").filter("_gone is null or seq > _gone").drop("_gone")


def remove_documents(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """``rows`` without those of the removed documents."""
    return rows.join(removed.select("doc_id").distinct(), "doc_id", "left_anti")


def stats(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: docs, words, pages."""
    words = vocab.agg(F.count(F.lit(1)).alias("words"))
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("nb_pages"), F.lit(0)).cast("long").alias("pages")).crossJoin(words).select("docs", "words", "pages")


def page_maps(index: DataFrame) -> DataFrame:
    """doc_id, p, pn: texts and normal texts of a document's pages by page number."""
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page").cast("string").alias("k"), F.col(c).alias("v")))))
    return index.groupBy("doc_id").agg(pairs("text").alias("p"), pairs("norm_text").alias("pn"))


