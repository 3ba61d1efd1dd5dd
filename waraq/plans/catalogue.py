"""The registered queries over the driver's tables, through the surrogate adapters, and their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.functions import correction
from waraq.functions.distance import weighted_distance
from waraq.functions.rules import CORRECTIONS
from waraq.functions.text import highlight, is_native, normalize, strip, tokens
from waraq.operators import catalog, index, ingest, search, upload
from waraq.operators.fuzzy import closest_words, fuzzy_index
from waraq.operators.postings import Postings, write_postings
from waraq.operators.ranking import rank_all
from waraq.operators.store import IndexStore
from waraq.operators.suggestions import suggest, suggestion_table
from waraq.plans import oracle
from waraq.runtime import materialize, shared_dir, spread, table
from waraq.sources import surrogate
from waraq.sources.tables import corrections_table
from waraq.streaming import ingest as stream
from waraq.streaming import uploads

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Shared steps


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = surrogate.line_pages(spark, sf_dir)
    kind = F.when(is_native(F.col("raw_text")), "native").otherwise("scan")
    return raw.withColumns({"type": kind, "text": strip(F.col("raw_text"))})


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_pages(_pages(spark, sf_dir))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.surface_counts(index.page_tokens(_index(spark, sf_dir)))


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vocabulary(_forms(spark, sf_dir))


_postings_of: dict[tuple[str, str], str] = {}
_lookups_of: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def _postings(spark: SparkSession, sf_dir: str) -> Postings:
    """The stored pages and postings of a folder of tables. They are written when they are first asked for, as an engine keeps
    them beside its index; later searches of the session read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _postings_of:
        folder = f"{shared_dir(spark)}/waraq/search-{uuid.uuid4().hex}"
        write_postings(_index(spark, sf_dir), folder)
        _postings_of[key] = folder
    return Postings(spark, _postings_of[key])


def _lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, fuzzy index, suggestions), stored alike."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lookups_of:
        vocab = materialize(_vocab(spark, sf_dir), "vocab")
        _lookups_of[key] = vocab, materialize(fuzzy_index(vocab), "fuzzy"), materialize(suggestion_table(vocab), "suggestions")
    return _lookups_of[key]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` as one upload of its own."""
    rows = surrogate.uploads(spark, sf_dir).withColumn("doc_id", F.col("seq").cast("string"))
    return index.document_table(rows, ingest.summarize(_pages(spark, sf_dir)))


def _corrections(spark: SparkSession) -> DataFrame:
    return corrections_table(spark, CORRECTIONS)


def _misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the query log with the second letter of each first word left out, and two dictionary words."""
    log = surrogate.query_log(spark, sf_dir)
    return log.select("query_id", F.concat(F.substring("query", 1, 1), F.substring("query", F.lit(3), F.length("query"))).alias("query")).unionByName(
        spark.createDataFrame([(-1, "القاعضي " + "abc"), (-2, " رمق  مالحظات ")], "query_id long, query string")
    )


# Text functions


@query(oracle.NORMALIZE_TEXT)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize(surrogate.surrogate(F.col("text"))).alias("norm_text"))


@query(oracle.STRIP_TEXT)
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.line_pages(spark, sf_dir).select("doc_id", "page", strip(F.col("raw_text")).alias("text"))


@query(oracle.TOKENIZE)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.page_tokens(_index(spark, sf_dir)).select("doc_id", "page", F.col("pos").alias("pos"), "surface", "norm")


@query(oracle.EDIT_DISTANCE_PAIRS)
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the words of the query log, each with each of the same first letter."""
    words = search.query_words(surrogate.query_log(spark, sf_dir)).select("nw").distinct()
    other = words.select(F.col("nw").alias("other"))
    pairs = words.join(other, F.substring("nw", 1, 1) == F.substring("other", 1, 1))
    return pairs.select(F.col("nw").alias("a"), F.col("other").alias("b"), weighted_distance(F.col("nw"), F.col("other")).alias("dist"))


@query(oracle.HIGHLIGHT)
def highlight_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with the words of its own query marked."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), surrogate.surrogate(F.col("text")).alias("text"))
    joined = items.join(surrogate.query_log(spark, sf_dir), "query_id")
    return joined.select("query_id", highlight(F.col("text"), F.col("query")).alias("marked"))


# Ingest


@query(oracle.PAGE_CLASSIFY)
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page", "type")


@query(oracle.DOC_SUMMARY)
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summarize(_pages(spark, sf_dir)).select("doc_id", "nb_pages", "n_native", "n_scan", "doc_type")


@query(oracle.SCAN_PAGES)
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What OCR would be given: the scan pages of each document that has any, and their number."""
    return _pages(spark, sf_dir).filter("type = 'scan'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"))


@query(oracle.MD5_IDENTITY)
def md5_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surrogate.uploads(spark, sf_dir)
    return rows.groupBy(ingest.document_id(F.col("content")).alias("doc_id")).agg(F.count(F.lit(1)).alias("uploads"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(oracle.LATEST_UPLOAD)
def latest_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that a name downloads now: the last one uploaded under it, whatever its suffix's case."""
    rows = surrogate.uploads(spark, sf_dir).filter(ingest.is_pdf(F.col("filename")))
    return ingest.latest(rows.select("filename", "seq", "doc_id", F.octet_length("content").cast("long").alias("bytes")), "filename")


@query(oracle.CACHE_OVERLAY)
def cache_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents; the cache has the even ones' pages of odd number, some of them with empty text."""
    pages = surrogate.turn_pages(spark, sf_dir).withColumn("text", strip(F.col("raw_text")))
    cache = pages.filter("seq % 2 = 0 and page % 2 = 1").select("doc_id", "page", F.when(F.col("page") % 3 == 0, F.lit(None).cast("string")).otherwise(F.reverse("text")).alias("text"))
    return ingest.overlay_cache(pages, cache).select("doc_id", "page", "text", "from_cache")


@query(oracle.CACHE_MISSES)
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = surrogate.turn_pages(spark, sf_dir).select("doc_id", "page")
    cache = surrogate.turn_pages(spark, sf_dir).filter("seq % 2 = 0 and page = 1").select("doc_id", "page")
    return ingest.cache_misses(pages, cache)


@query(oracle.OCR_FALLBACK)
def ocr_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice between two recognisers' texts, with a failing, a missing and an empty first one among them."""
    k = F.col("seq") % 5
    text = F.col("raw_text")
    first = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "[ERR engine: no image]").when(k == 2, "").otherwise(text)
    second = F.when(F.col("page") % 4 == 0, "[ERR model: timeout]").when(F.col("page") % 4 == 1, F.lit(None).cast("string")).otherwise(F.reverse(text))
    chosen = ingest.choose_ocr(first, second)
    rows = surrogate.turn_pages(spark, sf_dir).select("doc_id", "page", chosen.alias("text"))
    return rows.select("doc_id", "page", "text", ingest.is_error(F.col("text")).alias("is_error"))


@query(oracle.PICK_MODEL)
def pick_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vision model for each nation, as if each had a few of them."""
    some = F.array("n_name", F.when(F.col("n_nationkey") % 3 == 0, "qwen3-vl:4b").otherwise("none"), F.when(F.col("n_nationkey") % 2 == 0, "qwen2.5vl:7b").otherwise("other"))
    return table(spark, sf_dir, "nation").select("n_nationkey", ingest.pick_model(some).alias("model"))


@query(oracle.EXPORT_INDEXED)
def export_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.export_text(_index(spark, sf_dir))


@query(oracle.EXPORT_ALL)
def export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.export_text(_pages(spark, sf_dir))


@query(oracle.UPLOAD_RESPONSE)
def upload_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to uploads, read back from their JSON."""
    pages = surrogate.turn_pages(spark, sf_dir).withColumns({"type": F.when(is_native(F.col("raw_text")), "native").otherwise("scan"), "text": strip(F.col("raw_text")), "from_cache": F.lit(False)})
    pages = pages.withColumn("preview", F.when(F.col("page") % 2 == 1, F.col("raw_text").cast("binary")))
    names = pages.select("doc_id").distinct().withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    kind = "doc_id string, filename string, nb_pages long, n_scan long, doc_type string, pages array<struct<num:int,type:string,text:string,preview_b64:string>>"
    body = F.from_json("response", kind)
    rows = ingest.upload_response(pages, names).select(body.alias("r")).select("r.*").withColumn("p", F.explode("pages"))
    return rows.select("doc_id", "filename", "nb_pages", "n_scan", "doc_type", "p.num", "p.type", "p.text", "p.preview_b64")


# Index


@query(oracle.INDEX_PAGES)
def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("doc_id", "page", "text", "norm_text")


@query(oracle.SURFACE_COUNTS)
def surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).select("norm", "surface", "cnt")


@query(oracle.VOCAB_TOTALS)
def vocab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).select("norm", "n", F.col("first_seq.seq").alias("first_doc"), F.col("first_seq.page").alias("first_page"), F.col("first_seq.pos").alias("first_pos"))


@query(oracle.BEST_FORM)
def best_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).select("norm", "best_form")


@query(oracle.VOCABULARY_VIEW)
def vocabulary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every word's map of written forms, with the word's total."""
    nested = index.vocabulary_view(_forms(spark, sf_dir))
    return nested.select("norm", F.col("entry.n").alias("n"), F.explode("entry.f").alias("surface", "cnt"))


@query(oracle.PAGE_MAPS)
def page_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every document's two maps."""
    maps = index.page_maps(_index(spark, sf_dir))
    return maps.select("doc_id", "pn", F.explode("p").alias("page", "text")).select("doc_id", "page", "text", F.col("pn")[F.col("page")].alias("norm_text"))


@query(oracle.STATS)
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stats(_docs(spark, sf_dir), _vocab(spark, sf_dir))


@query(oracle.LIST_DOCUMENTS)
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue by content: a repeated text is one document under its latest name, at its first place."""
    rows = surrogate.uploads(spark, sf_dir)
    pages = rows.select("doc_id", F.explode(F.split(F.col("content").cast("string"), "\n", -1)).alias("raw_text"), "seq")
    last = pages.join(rows.groupBy("doc_id").agg(F.max("seq").alias("seq")), ["doc_id", "seq"], "left_semi").withColumn("type", F.lit("native"))
    docs = index.document_table(rows, ingest.summarize(last))
    return catalog.list_documents(docs).join(docs.select("doc_id", "first_seq"), "doc_id").withColumn("day", catalog.day(F.col("indexed"))).drop("badge")


@query(oracle.BADGE_CASE)
def badge_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges of file names made from customers' segments."""
    k = F.col("c_custkey") % 4
    name = F.concat(F.when(k == 0, "ظهير ").when(k == 1, "قرار مرسوم ").when(k == 2, "قرار ").otherwise(""), "c_name", F.lit(".PDF"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("filename")).select("c_custkey", "filename", catalog.badge(F.col("filename")).alias("badge"))


@query(oracle.PAGE_LABELS)
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir)
    return rows.select("doc_id", "page", catalog.page_label(F.col("type")).alias("label"), catalog.page_html(F.col("text")).alias("html"))


@query(oracle.DELETE_ANTIJOIN)
def delete_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without the documents that are labelled as of low quality; ids that are not there delete nothing."""
    removed = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    left = index.remove_documents(_index(spark, sf_dir), removed.unionByName(spark.createDataFrame([("no such id",)], "doc_id string")))
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


@query(oracle.DELETE_READD)
def delete_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content, each tenth upload deleted just after it: a later upload of the same text stands, at its own place."""
    rows = surrogate.uploads(spark, sf_dir)
    deletions = rows.filter("seq % 10 = 0").select("doc_id", "seq")
    live = index.live_uploads(rows, deletions)
    return live.groupBy("doc_id").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("uploads"))


def _uploaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (by content), seq, page, text of each upload."""
    rows = spread(surrogate.uploads(spark, sf_dir))
    lines = F.posexplode(F.split(surrogate.surrogate(F.col("content").cast("string")), "\n", -1)).alias("page", "raw_text")
    return rows.select("doc_id", "seq", lines).select("doc_id", "seq", (F.col("page") + 1).alias("page"), strip(F.col("raw_text")).alias("text"))


_grown: dict[tuple[str, str], str] = {}


def _grown_store(spark: SparkSession, sf_dir: str) -> IndexStore:
    """The index of the documents' uploads by four batches, each tenth deleted just after it, with a compaction after the second; batches
    that come again, before it and after it, change nothing. Built when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _grown:
        store = IndexStore(spark, f"{shared_dir(spark)}/waraq/index-{uuid.uuid4().hex}")
        for batch in (0, 1, 1, 2, 0, 3, 3):
            part = F.col("seq") % 4 == batch
            deletions = surrogate.uploads(spark, sf_dir).filter(part & (F.col("seq") % 10 == 0)).select("doc_id", "seq")
            store.append(batch, _uploaded_pages(spark, sf_dir).filter(part), deletions)
            if batch == 1 and store.generation() == 0 and len(store.batches()) == 2:
                store.compact()
        _grown[key] = store.folder
    return IndexStore(spark, _grown[key])


@query(oracle.GROWN_PAGES)
def grown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of current documents, after batches, deletions and a compaction."""
    return _grown_store(spark, sf_dir).pages().select("doc_id", "seq", "page", "text", "norm_text")


@query(oracle.GROWN_VOCABULARY)
def grown_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the same: that of all uploads, as if counted at once."""
    return index.vocabulary(_grown_store(spark, sf_dir).forms()).select("norm", "n", "best_form")


@query(oracle.DOCUMENT_STREAM)
def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every document by a stream of uploads, each tenth followed by its deletion."""
    folder = f"{shared_dir(spark)}/waraq/stream-{uuid.uuid4().hex}"
    files = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/documents.parquet*")
    one = lambda seq, deleted: F.struct(seq.alias("seq"), deleted.alias("deleted"))
    seq = F.col("doc_id") * 2
    both = F.when(F.col("doc_id") % 10 == 0, F.array(one(seq, F.lit(False)), one(seq + 1, F.lit(True)))).otherwise(F.array(one(seq, F.lit(False))))
    events = files.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("doc_id"), F.concat("source", F.lit(".PDF")).alias("filename"), F.explode(both).alias("e")).select("doc_id", "filename", "e.seq", "e.deleted")
    uploads.follow(events, folder, f"{folder}/checkpoint").awaitTermination()
    return uploads.documents(spark, folder)


#: Divides the pages of a made file.
_PAGE_END = "\x1e"


def _first_engine(images):
    """Fails on images of some sizes, in two ways."""
    return [[None, "[ERR first]", bytes(i).decode()][len(i) % 3] for i in images]


def _second_engine(images):
    return [None if len(i) % 2 else "ب " + bytes(i).decode() for i in images]


@query(oracle.UPLOAD_PIPELINE)
def upload_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files, a page a turn, from upload to answer: each fourth is in the cache, in part; the scans of all
    others go through two engines that fail now and then. Every page of the answers, read back."""
    turns = surrogate.turn_pages(spark, sf_dir).withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "raw_text"))), lambda p: p["raw_text"])
    files = turns.groupBy("doc_id", "seq").agg(F.array_join(listed, _PAGE_END).cast("binary").alias("content")).withColumn("filename", F.concat("doc_id", F.lit(".pdf")))

    def explode(rows: DataFrame) -> DataFrame:
        pages = rows.select("doc_id", "seq", F.posexplode(F.split(F.col("content").cast("string"), _PAGE_END, -1)).alias("at", "raw_text"))
        return pages.select("doc_id", "seq", (F.col("at") + 1).alias("page"), "raw_text", F.col("raw_text").cast("binary").alias("image"), F.lit(None).cast("binary").alias("preview"))

    cache = turns.filter("seq % 4 = 0 and page % 2 = 1").select("doc_id", "page", F.lit("scan").alias("type"), F.concat(F.lit("cached "), F.col("page").cast("string")).alias("text"))
    _, _, answers = upload.upload(files, cache, explode, _first_engine, _second_engine, f"{shared_dir(spark)}/waraq/cache-{uuid.uuid4().hex}")
    kind = "doc_id string, filename string, nb_pages long, n_scan long, doc_type string, from_cache boolean, pages array<struct<num:int,type:string,text:string>>"
    rows = answers.select(F.from_json("response", kind).alias("r")).select("r.*").withColumn("p", F.explode("pages"))
    return rows.select("doc_id", "filename", "nb_pages", "n_scan", "doc_type", "from_cache", "p.num", "p.type", "p.text")


@query(oracle.HEALTH)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and version, told by what answers for the documents."""
    return catalog.health(table(spark, sf_dir, "documents"))


# Search


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = surrogate.query_log(spark, sf_dir).select("query_id", strip(F.col("query")).alias("effective"))
    return search.matches(asked, _postings(spark, sf_dir))


@query(oracle.PHRASE_SEARCH)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frequent phrase over all pages: matching pages per document, with the excerpt of the first."""
    asked = spark.createDataFrame([(1, "لح موا")], "query_id long, effective string")
    found = search.results(search.matches(asked, _postings(spark, sf_dir)), _docs(spark, sf_dir))
    return found.select("doc_id", "filename", "nb_pages", "n_matches", F.col("matches")[0]["page"].alias("first_page"), F.col("matches")[0]["line"].alias("first_line"))


@query(oracle.BATCH_SEARCH)
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query of the log over all pages."""
    return _found(spark, sf_dir).select("query_id", "doc_id", "page", "line")


@query(oracle.BATCH_SEARCH)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over postings in which every gram of more than a tenth of all counts as common and is dealt over parts."""
    asked = surrogate.query_log(spark, sf_dir).select("query_id", strip(F.col("query")).alias("effective"))
    folder = f"{shared_dir(spark)}/waraq/search-{uuid.uuid4().hex}"
    write_postings(_index(spark, sf_dir), folder, hot_share=100_000)
    return search.matches(asked, Postings(spark, folder)).select("query_id", "doc_id", "page", "line")


@query(oracle.EXCERPT_WINDOW)
def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries over whole documents as single pages that span a line end, so the excerpt is a window around the hit."""
    pages = _texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("seq"), F.lit(1).alias("page"), surrogate.surrogate(F.col("text")).alias("text"))
    asked = spark.createDataFrame([(1, ".\nوا"), (2, "م\nم")], "query_id long, effective string")
    folder = f"{shared_dir(spark)}/waraq/search-{uuid.uuid4().hex}"
    write_postings(index.index_pages(pages), folder)
    return search.matches(asked, Postings(spark, folder)).select("query_id", "doc_id", "line")


@query(oracle.RANKED_DOCS)
def ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of three frequent phrases."""
    asked = spark.createDataFrame([(1, "لح موا"), (2, "انع"), (3, "ةا")], "query_id long, effective string")
    found = search.results(search.matches(asked, _postings(spark, sf_dir)), _docs(spark, sf_dir))
    return search.top_results(found, 20).select("query_id", "rank", "doc_id", "n_matches")


@query(oracle.RANKED_ALL)
def ranked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result of three frequent phrases with its place in the answer."""
    asked = spark.createDataFrame([(1, "لح موا"), (2, "انع"), (3, "ةا")], "query_id long, effective string")
    found = search.results(search.matches(asked, _postings(spark, sf_dir)), _docs(spark, sf_dir)).drop("matches")
    return rank_all(found).select("query_id", "rank", "doc_id", "filename", "n_matches")


@query(oracle.SEARCH_CARDS)
def search_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six lines of each result, with the query's words marked."""
    asked = surrogate.query_log(spark, sf_dir).select("query_id", strip(F.col("query")).alias("effective"))
    found = search.results(search.matches(asked, _postings(spark, sf_dir)), _docs(spark, sf_dir))
    return search.cards(found, asked)


@query(oracle.VOCAB_MEMBERSHIP)
def vocab_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.query_words(_misspelt(spark, sf_dir))
    known = _vocab(spark, sf_dir).select(F.col("norm").alias("nw"), F.lit(True).alias("known"))
    return asked.join(known, "nw", "left").select("query_id", "pos", "word", "arabic", F.coalesce("known", F.lit(False)).alias("known"))


@query(oracle.DICT_LOOKUP)
def dict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dictionary makes of each word of the vocabulary and of the misspelt queries; null where it has none."""
    words = _lookups(spark, sf_dir)[0].select(F.col("norm").alias("nw")).unionByName(search.query_words(_misspelt(spark, sf_dir)).select("nw")).distinct()
    return words.join(F.broadcast(search.first_corrections(_corrections(spark))), "nw", "left")


@query(oracle.FUZZY_CLOSEST)
def fuzzy_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's nearest word to each misspelt word that it does not have."""
    asked = search.query_words(_misspelt(spark, sf_dir)).filter("arabic").select("nw").distinct()
    vocab, near, _ = _lookups(spark, sf_dir)
    return closest_words(asked.join(vocab.select(F.col("norm").alias("nw")), "nw", "left_anti"), near)


@query(oracle.CORRECT_QUERY)
def correct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, near, _ = _lookups(spark, sf_dir)
    return search.correct_queries(_misspelt(spark, sf_dir), vocab, _corrections(spark), near)


@query(oracle.SUGGEST_PREFIX)
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = search.query_words(surrogate.query_log(spark, sf_dir)).filter("arabic").select(F.substring("word", 1, 3).alias("prefix"))
    vocab, _, best = _lookups(spark, sf_dir)
    return suggest(prefixes, best, vocab)


@query(oracle.LIVE_SUGGEST)
def live_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions while the first four letters of a query are typed; six are shown."""
    typed = surrogate.query_log(spark, sf_dir).select("query_id", F.substring("query", 1, 4).alias("query")).filter(F.length("query") >= 2)
    vocab, _, best = _lookups(spark, sf_dir)
    rows = search.query_suggestions(typed, vocab, best)
    return rows.select("query_id", F.array_join(F.slice("suggestions", 1, 6), "|").alias("shown"))


@query(oracle.SEARCH_ENVELOPE)
def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search for each misspelt query: correction, suggestions and the number of results."""
    store, (vocab, near, best) = _postings(spark, sf_dir), _lookups(spark, sf_dir)
    heads, _ = search.search(_misspelt(spark, sf_dir), store, _docs(spark, sf_dir), vocab, _corrections(spark), near, best)
    return heads.select("query_id", "query_orig", "query_eff", "correction", F.array_join("suggestions", "|").alias("suggestions"), "total")


@query(oracle.SEARCH_ANSWER)
def search_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole answer to each misspelt query as one JSON object, but for the time it took."""
    store, (vocab, near, best) = _postings(spark, sf_dir), _lookups(spark, sf_dir)
    return search.answers(*search.search(_misspelt(spark, sf_dir), store, _docs(spark, sf_dir), vocab, _corrections(spark), near, best))


@query(oracle.RESULT_JSON)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON objects, read back."""
    rows = search.result_json(search.results(_found(spark, sf_dir), _docs(spark, sf_dir)))
    body = F.from_json("result", "doc_id string, filename string, nb_pages long, matches array<struct<page:int,line:string>>")
    flat = rows.select("query_id", body.alias("r")).select("query_id", "r.doc_id", "r.filename", "r.nb_pages", F.explode("r.matches").alias("m"))
    return flat.select("query_id", "doc_id", "filename", "nb_pages", "m.page", "m.line")


# Correction cascade


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _corrected(step: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).select("doc_id", correction.STEPS[step](surrogate.surrogate(F.col("text"))).alias("text"))

    run.__name__ = f"correct_step_{step}"
    return run


@query(oracle.CORRECT_DICT)
def correct_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select("doc_id", correction.corrected_with(surrogate.surrogate(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.text", F.array_join("c.applied", "|").alias("applied"))


for _step in correction.STEPS:
    query(oracle.CORRECT_STEPS.get(_step))(_corrected(_step))


@query(oracle.CORRECT_TEXT)
def correct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", correction.correct_text(strip(surrogate.surrogate(F.col("text")))).alias("text"))


# Streaming


@query(oracle.SURFACE_COUNTS)
def stream_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word counts again, by a stream over the documents' files."""
    folder = f"{shared_dir(spark)}/waraq/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    lines = F.posexplode(F.split(surrogate.surrogate(F.coalesce(F.col("text"), F.lit(""))), "\n", -1)).alias("page", "raw_text")
    pages = files.select(F.col("doc_id").alias("seq"), lines).select(F.col("seq").cast("string").alias("doc_id"), "seq", (F.col("page") + 1).alias("page"), strip(F.col("raw_text")).alias("text"))
    stream.ingest(pages, folder, f"{folder}/checkpoint").awaitTermination()
    return stream.ingested_counts(spark, folder).select("norm", "surface", "cnt")
