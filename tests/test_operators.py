"""Ingest, index, catalogue and search operators on small literal tables."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from waraq import schemas
from waraq.functions import distance
from waraq.operators import catalog, fuzzy, index, ingest, postings, search, suggestions
from waraq.sources import tables
from waraq.streaming import ingest as stream

PAGES = [
    ("d1", 1, 1, "كتاب كتاب القانون"),
    ("d1", 1, 2, "كتابة القانون\nسطر كتابه"),
    ("d1", 1, 3, "abc"),
    ("d2", 2, 1, "كتابه كتابه المحكمة القانون"),
    ("d3", 3, 1, None),
    ("d3", 3, 2, "     "),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.createDataFrame(PAGES, "doc_id string, seq long, page int, text string")
    return rows.withColumn("type", F.when(F.length("text") > 16, "native").otherwise("scan"))


@pytest.fixture(scope="module")
def idx(pages):
    return index.index_pages(pages)


@pytest.fixture(scope="module")
def forms(idx):
    return index.surface_counts(index.page_tokens(idx))


@pytest.fixture(scope="module")
def vocab(forms):
    return index.vocabulary(forms)


@pytest.fixture(scope="module")
def docs(spark, pages):
    log = spark.createDataFrame([(1, "d1", "a.pdf"), (2, "d2", "قرار.pdf"), (3, "d3", "c.pdf")], "seq long, doc_id string, filename string")
    return index.document_table(log.withColumn("uploaded_at", F.lit(None).cast("timestamp")), ingest.summarize(pages))


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "query_id long, query string")


def test_short_pages_are_not_indexed_but_counted(idx, docs):
    assert sorted((r.doc_id, r.page) for r in idx.collect()) == [("d1", 1), ("d1", 2), ("d2", 1)]
    assert {r.doc_id: r.nb_pages for r in docs.collect()} == {"d1": 3, "d2": 1, "d3": 2}


def test_vocabulary_and_ties(vocab, forms):
    got = {r.norm: (r.n, r.best_form) for r in vocab.collect()}
    assert got["كتابه"] == (4, "كتابه") and got["كتاب"] == (2, "كتاب") and got["القانون"] == (3, "القانون")
    assert forms.agg(F.sum("cnt")).first()[0] == sum(n for n, _ in got.values())
    tied = index.vocabulary(forms.filter("norm = 'كتابه'").withColumn("cnt", F.lit(1)))
    assert tied.first().best_form == "كتابة"  # the form that came first


def test_repeated_upload_counts_again_and_delete_leaves_words(spark, pages, vocab, docs, idx):
    again = index.page_tokens(index.index_pages(pages.unionByName(pages.withColumn("seq", F.col("seq") + 10))))
    twice = {r.norm: r.n for r in index.vocabulary(index.surface_counts(again)).collect()}
    assert twice == {r.norm: 2 * r.n for r in vocab.collect()}
    assert index.merge_counts(*[index.surface_counts(index.page_tokens(idx))] * 2).agg(F.sum("cnt")).first()[0] == sum(twice.values())
    every = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("unknown",)], "doc_id string")
    assert index.stats(index.remove_documents(docs, every), vocab).first().asDict() == {"docs": 0, "words": vocab.count(), "pages": 0}


def test_stats_of_nothing(docs, vocab):
    assert index.stats(docs.limit(0), vocab.limit(0)).first().asDict() == {"docs": 0, "words": 0, "pages": 0}


def test_deletion_and_new_upload(spark):
    uploads = spark.createDataFrame([(1, "a"), (2, "b"), (5, "a")], "seq long, doc_id string")
    gone = spark.createDataFrame([("a", 3), ("b", 4), ("zzz", 9)], "doc_id string, seq long")
    assert [(r.seq, r.doc_id) for r in index.live_uploads(uploads, gone).collect()] == [(5, "a")]


@pytest.mark.parametrize("native, scan, kind", [(0, 0, "scan"), (0, 2, "scan"), (2, 0, "native"), (1, 1, "mixed")])
def test_document_kind(spark, native, scan, kind):
    rows = spark.createDataFrame([("d", "native")] * native + [("d", "scan")] * scan, "doc_id string, type string")
    got = ingest.summarize(rows, spark.createDataFrame([("d",)], "doc_id string")).first()
    assert (got.nb_pages, got.n_native, got.n_scan, got.doc_type) == (native + scan, native, scan, kind)


def test_classify_corrects_the_text_and_judges_the_raw(spark):
    raw = spark.createDataFrame([("d", 1, 1, "  محكمـة " + " " * 80)], "doc_id string, seq long, page int, raw_text string")
    got = ingest.classify(raw).first()
    assert (got.type, got.text) == ("scan", "محكمة")


def test_cache_overlay_by_presence(spark):
    pages = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c")], "doc_id string, page int, text string")
    cache = spark.createDataFrame([("d", 1, "A"), ("d", 2, None), ("x", 3, "C")], "doc_id string, page int, text string")
    got = {r.page: (r.text, r.from_cache) for r in ingest.overlay_cache(pages, cache).collect()}
    assert got == {1: ("A", True), 2: (None, True), 3: ("c", False)}
    assert ingest.cache_misses(pages, cache).count() == 0


def test_ocr_fallback(spark):
    rows = [("none", None, "b"), ("error", "[ERR x", "b"), ("empty", "", "b"), ("good", "a", "b"), ("both", None, "[ERR y"), ("nothing", None, None)]
    frame = spark.createDataFrame(rows, "k string, a string, b string")
    got = {r.k: r.t for r in frame.select("k", ingest.choose_ocr(F.col("a"), F.col("b"), ()).alias("t")).collect()}
    assert got == {"none": "b", "error": "b", "empty": "", "good": "a", "both": "[ERR y", "nothing": ""}


def test_recognise_scans_only(spark):
    pages = spark.createDataFrame([("d", 1, "native", "text", b"n"), ("d", 2, "scan", "", b"one"), ("d", 3, "scan", "", b"bad"), ("d", 4, "scan", "", b"worse")], "doc_id string, page int, type string, text string, image binary")

    def first(images):
        return [None if bytes(i) == b"bad" else "[ERR first" if bytes(i) == b"worse" else bytes(i).decode() for i in images]

    def second(images):
        if any(bytes(i) == b"worse" for i in images):
            raise RuntimeError("no engine")
        return ["second"] * len(images)

    got = {r.page: r.text for r in ingest.recognise(pages, first, second, ()).collect()}
    assert got[1] == "text" and got[2] == "one" and got[3] in ("second", "[ERR RuntimeError: no engine]") and got[4].startswith("[ERR RuntimeError")


def test_pick_model(spark):
    have = lambda *m: spark.range(1).select(ingest.pick_model(F.array(*[F.lit(x) for x in m]).cast("array<string>")).alias("m")).first().m
    assert have("qwen3-vl:4b", "qwen2.5vl:7b") == "qwen2.5vl:7b" and have("other") == "qwen2.5vl:3b" and have() == "qwen2.5vl:3b"


def test_exports(spark):
    pages = spark.createDataFrame([("d", 2, "B"), ("d", 1, "A"), ("d", 10, None)], "doc_id string, page int, text string")
    assert ingest.export_text(pages).first().text == "=== صفحة 1 ===\nA\n\n=== صفحة 2 ===\nB\n\n=== صفحة 10 ===\n"


def test_base64_has_no_line_ends(spark):
    import base64

    body = bytes(range(256)) * 3
    assert spark.createDataFrame([(body,)], "b binary").select(ingest.plain_base64(F.col("b")).alias("x")).first().x == base64.b64encode(body).decode()


def test_latest_and_names(spark):
    rows = spark.createDataFrame([("a.pdf", 1, "x"), ("a.pdf", 3, "y"), ("b.txt", 2, "z")], "filename string, seq long, doc_id string")
    assert [(r.filename, r.doc_id) for r in ingest.latest(rows.filter(ingest.is_pdf(F.col("filename"))), "filename").collect()] == [("a.pdf", "y")]
    assert spark.createDataFrame([("../up/x.pdf",)], "p string").select(ingest.file_name(F.col("p")).alias("n")).first().n == "x.pdf"


def test_correct_query(spark, vocab):
    corrections = tables.corrections_table(spark, [("القاعضي", "القاضي"), ("القاعضى", "second")])
    queries = asked(spark, "كتابة القانون", "القاعضي كتابة", "القانو", "abc zzz", " ", "ششششششش كتاب")
    got = {r.query_id: (r.correction, r.effective) for r in search.correct_queries(queries, vocab, corrections).collect()}
    assert got[1] == (None, "كتابة القانون")  # known words alone change nothing
    assert got[2] == ("القاضي كتابه", "القاضي كتابه")  # but take their best form where another is corrected
    assert got[3] == ("القانون", "القانون")
    assert got[4] == (None, "abc zzz") and got[5] == (None, "") and got[6] == (None, "ششششششش كتاب")


def test_suggest(spark, vocab):
    prefixes = spark.createDataFrame([("كت",), ("ك",), ("الق",), ("ال",)], "prefix string")
    table = suggestions.suggestion_table(vocab)
    got = sorted((r.prefix, r.rank, r.suggestion) for r in suggestions.suggest(prefixes, table, vocab).collect())
    assert got == [("ال", 1, "القانون"), ("الق", 1, "القانون"), ("كت", 1, "كتابه"), ("كت", 2, "كتاب")]
    assert suggestions.suggest(prefixes, table, vocab, 1).count() == 3


def test_suggestions_of_parts_merge(spark):
    """Tables of parts of a vocabulary, put together, are that of the whole; prefixes longer than are kept are found too."""
    long_ = "ب" * 40
    rows = [(w, 2 + k % 5, w, (k, 1, 0)) for k, w in enumerate(["كت", "كتاب", "كتابه", "كاتب", "باب", long_, long_ + "ا", "ك" * 24, "ك" * 25])] + [("نادر", 1, "نادر", (99, 1, 0))]
    vocab = spark.createDataFrame(rows, "norm string, n long, best_form string, first_seq struct<seq:long,page:int,pos:int>")
    whole = suggestions.suggestion_table(vocab, 2)
    parts = [suggestions.suggestion_table(vocab.filter(F.pmod(F.xxhash64("norm"), F.lit(3)) == k), 2) for k in range(3)]
    assert sorted(map(str, suggestions.merge_suggestions(*parts, kept=2).collect())) == sorted(map(str, whole.collect()))
    asked_ = ["كت", "كتابه", "نا", long_, long_[:30], "ك" * 24, "ك" * 25, "ًً", None]
    got = {(r.prefix, r.rank): r.suggestion for r in suggestions.suggest(spark.createDataFrame([(p,) for p in asked_], "prefix string"), suggestions.suggestion_table(vocab), vocab).collect()}
    order = lambda p: [r[0] for r in sorted((r for r in rows if r[1] > 1 and r[0].startswith(p)), key=lambda r: (-r[1], r[3]))][:8]
    want = {(p, k + 1): w for p in asked_ if p for k, w in enumerate(order("" if p == "ًً" else p))}
    assert got == want


@pytest.fixture(scope="module")
def store(spark, idx, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    postings.write_postings(idx, folder)
    return postings.Postings(spark, folder)


def test_search(spark, store, docs, vocab):
    corrections = tables.corrections_table(spark, [("zz", "yy")])
    queries = asked(spark, "القانون", "كتابة القانون", " ", "كتابه", "القانو")
    heads, found = search.search(queries, store, docs, vocab, corrections)
    by_id = {r.query_id: r for r in heads.collect()}
    assert {k: r.total for k, r in by_id.items()} == {1: 2, 2: 1, 3: 0, 4: 2, 5: 2}
    assert by_id[5].correction == by_id[5].query_eff == "القانون" and by_id[5].query_orig == "القانو"
    assert by_id[4].suggestions == ["كتابه"] and by_id[3].suggestions == []
    order = [(r.query_id, r.doc_id, r.n_matches) for r in search.ranked(found).collect() if r.query_id in (1, 4)]
    assert order == [(1, "d1", 2), (1, "d2", 1), (4, "d1", 1), (4, "d2", 1)]
    lines = {(r.query_id, r.doc_id): [(m.page, m.line) for m in r.matches] for r in found.collect()}
    assert lines[1, "d1"] == [(1, "كتاب كتاب القانون"), (2, "كتابة القانون")] and lines[4, "d1"] == [(2, "كتابة القانون")]
    one = json.loads(search.result_json(found.filter("query_id = 2")).first().result)
    assert one == {"doc_id": "d1", "filename": "a.pdf", "nb_pages": 3, "matches": [{"page": 2, "line": "كتابة القانون"}]}


def test_empty_normal_form_matches_every_page(spark, idx, store):
    queries = spark.createDataFrame([(1, "ً")], "query_id long, effective string")
    assert search.matches(queries, store).count() == idx.count()


@pytest.mark.parametrize("hot_share", [1000, 10_000_000])
def test_postings_find_what_a_scan_finds(spark, tmp_path, hot_share):
    """Phrases of every length, against each page in turn; with the large share nearly every gram is dealt over parts."""
    texts = ["القانون والكتاب", "كتابه القانون\nسطر", "اب", "ا", "", "اااااااا", "x😀y😀z", "بببب ا بببب", "كتابه القانون\nسطر"]
    pages = [(f"d{k % 4}", k % 4, k, t, t) for k, t in enumerate(texts * 6)] + [("d9", 9, 1, None, None)]
    frame = spark.createDataFrame(pages, "doc_id string, seq long, page int, text string, norm_text string").withColumn("Bucket", F.lit("clash"))
    postings.write_postings(frame, str(tmp_path), hot_share)
    phrases = ["القانون", "ب ا", "اب", "ا", "كتابه القانون", "ون\nسط", "zzz", " ", "ً", "القانون ", "😀", "y😀", "😀y😀", "ااا", "الق zzz", None, ""]
    queries = spark.createDataFrame(list(enumerate(phrases)), "query_id long, effective string")
    got = sorted((r.query_id, r.doc_id, r.page) for r in postings.matches(queries, postings.Postings(spark, str(tmp_path))).collect())
    folded = lambda p: "" if p == "ً" else p.replace("ه", "ه")
    want = sorted((q, d, n) for q, p in enumerate(phrases) if p and p.strip() for d, _, n, _, t in pages if t is not None and folded(p) in t)
    assert got == want and len(want) > 100


def test_search_reads_only_buckets_it_needs(spark, tmp_path):
    pages = [(f"d{k}", k, 1, f"نص رقم {k} كلمة", f"نص رقم {k} كلمه") for k in range(500)]
    postings.write_postings(spark.createDataFrame(pages, "doc_id string, seq long, page int, text string, norm_text string"), str(tmp_path))
    found = postings.matches(spark.createDataFrame([(1, "رقم 321")], "query_id long, effective string"), postings.Postings(spark, str(tmp_path)))
    assert [r.doc_id for r in found.collect()] == ["d321"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruningexpression") >= 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_fuzzy_index_loses_no_pair(spark):
    """Against all pairs: words of every length, within two folded edits or not."""
    rng = random.Random(4)
    words = {"".join(rng.choice("ابتثجحخسش") for _ in range(rng.randint(2, 14))) for _ in range(150)}
    for w in list(words):
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "ا", "ز"])
            words.add("".join(x))
    words = sorted(w for w in words if len(w) >= 2)
    asked_, known = words[::2], words[1::2]
    vocab = spark.createDataFrame([(w, w, k) for k, w in enumerate(known)], "norm string, best_form string, first_seq long")
    nw = spark.createDataFrame([(w,) for w in [*asked_, None, "", "ا"]], "nw string")
    got = {(r.nw, r.norm) for r in fuzzy.candidates(nw, fuzzy.fuzzy_index(vocab)).collect()}
    near = nw.crossJoin(vocab).filter((F.abs(F.length("nw") - F.length("norm")) <= 2) & (F.levenshtein(distance.letter_classes(F.col("nw")), distance.letter_classes(F.col("norm"))) <= 2))
    want = {(r.nw, r.norm) for r in near.collect()}
    assert got == want and len(want) > 300


def test_badges(spark):
    names = spark.createDataFrame([("قرار ظهير.pdf",), ("مرسوم",), ("قرار",), ("x",)], "f string")
    assert [r.b for r in names.select(catalog.badge(F.col("f")).alias("b")).collect()] == ["ظهير شريف", "مرسوم بقانون", "قرار وزاري", "وثيقة"]
    assert catalog.health(names).first().asDict() == {"status": "ok", "version": "1.0.0", "documents": 4}


def test_files_in_and_out(spark, tmp_path, idx):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"one\ftwo")
    (tmp_path / "in/b.txt").write_bytes(b"no")
    uploads = tables.read_uploads(spark, f"file://{tmp_path}/in").withColumn("seq", F.lit(1).cast("long"))

    class FormFeeds:
        def count(self, file):
            return file.read().count(b"\f") + 1

        def read(self, file, first, last):
            for k, t in enumerate(file.read().decode().split("\f")[first - 1 : last], first):
                yield k, t, lambda: None, b"p"

    pages = tables.explode_pages(uploads, FormFeeds())
    assert sorted((r.page, r.raw_text, r.image) for r in pages.collect()) == [(1, "one", None), (2, "two", None)]
    assert uploads.first().filename == "a.PDF"

    tables.write_index(idx, f"file://{tmp_path}/index", "doc_id")
    assert sorted(r.page for r in tables.read_key(spark, f"file://{tmp_path}/index", "doc_id", "d1").collect()) == [1, 2]

    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/h1.json").write_text(json.dumps({"pages": [{"num": 1, "type": "scan", "text": "نص"}], "doc_type": "scan", "nb_pages": 1, "n_native": 0, "n_scan": 1}), "utf-8")
    (tmp_path / "cache/h2.json").write_text("{broken", "utf-8")
    assert [tuple(r) for r in tables.read_cache_files(spark, f"file://{tmp_path}/cache").collect()] == [("h1", 1, "scan", "نص")]

    whole = {"v": {"كتاب": {"f": {"كتاب": 2}, "n": 2}}, "d": {"h": {"fn": "a.pdf", "np": 1, "dt": "2025", "p": {"1": "كتاب"}, "pn": {"1": "كتاب"}}}}
    (tmp_path / "index.json").write_text(json.dumps(whole, ensure_ascii=False), "utf-8")
    forms, pages = tables.read_index_file(spark, f"file://{tmp_path}/index.json")
    assert [tuple(r) for r in forms.collect()] == [("كتاب", "كتاب", 2)] and [tuple(r) for r in pages.collect()] == [("h", 1, "كتاب", "كتاب")]

    (tmp_path / "fix.jsonl").write_text('["a", "b"]\n["c", "d"]\n["a", "e"]\n', "utf-8")
    assert tables.read_corrections(spark, f"file://{tmp_path}/fix.jsonl") == (("a", "e"), ("c", "d"))


def test_stream_equals_batch(spark, tmp_path, pages, forms):
    source = f"file://{tmp_path}/pages"
    pages.filter("seq = 1").coalesce(1).write.mode("append").parquet(source)
    pages.filter("seq > 1").coalesce(1).write.mode("append").parquet(source)
    flow = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.ingest(flow, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    got = stream.ingested_counts(spark, f"file://{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, forms.select(*got.columns).collect()))


def test_schemas_fit(idx, forms, vocab):
    shape = lambda df, s: {(f.name, f.dataType.simpleString()) for f in df.schema} == {(f.name, f.dataType.simpleString()) for f in s}
    assert shape(idx, schemas.PAGE_INDEX) and shape(forms, schemas.VOCAB_FORMS) and shape(vocab, schemas.VOCAB)


def test_upload_pipeline(spark, tmp_path):
    """From files to answers: one document from the cache, one recognised, one repeated; a file that is no PDF is left out."""
    import json

    from waraq.operators import upload as uploading
    from waraq.sources import tables

    at = datetime.datetime(2024, 1, 1)
    native = "A page whose text is long enough to count as native, not as a scan."
    files = [(1, "x/one.PDF", native.encode(), at), (2, "two.pdf", b"|", at), (3, "notes.txt", b"no", at), (4, "again.pdf", b"|", at), (5, "known.pdf", b"short", at)]
    added = tables.append_uploads(spark.createDataFrame(files, "seq long, filename string, content binary, uploaded_at timestamp"), f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.columns == ["seq", "doc_id", "filename", "content", "uploaded_at"] and added.count() == 4
    ids = {r.filename: r.doc_id for r in log.collect()}
    assert set(ids) == {"one.PDF", "two.pdf", "again.pdf", "known.pdf"} and ids["two.pdf"] == ids["again.pdf"]
    found = {r.filename: (r.found, r.content and bytes(r.content)) for r in tables.file_content(log, spark.createDataFrame([("known.pdf",), ("gone.pdf",)], "filename string")).collect()}
    assert found == {"known.pdf": (True, b"short"), "gone.pdf": (False, None)}

    class Parts:
        def count(self, file):
            return file.read().count(b"|") + 1

        def read(self, file, first, last):
            for k, t in enumerate(file.read().decode().split("|")[first - 1 : last], first):
                yield k, t, t.encode, b""

    cache = spark.createDataFrame([(ids["known.pdf"], 1, "scan", "text from the cache")], "doc_id string, page int, type string, text string")
    first = lambda images: [None if not bytes(i) else "read " + bytes(i).decode() for i in images]
    second = lambda images: ["second engine"] * len(images)
    pages, index, answers = uploading.upload(log, cache, lambda u: tables.explode_pages(u, Parts(), 1), first, second, f"{tmp_path}/cache", ())
    texts = {(r.doc_id, r.seq, r.page): (r.type, r.text, r.from_cache) for r in pages.collect()}
    assert texts[ids["one.PDF"], 1, 1] == ("native", native, False)
    assert texts[ids["known.pdf"], 5, 1] == ("scan", "text from the cache", True)
    assert all(texts[ids["two.pdf"], seq, page] == ("scan", "second engine", False) for seq in (2, 4) for page in (1, 2)) and len(texts) == 6
    assert index.count() == 6
    got = {r.doc_id: json.loads(r.response) for r in answers.collect()}
    assert {r["filename"] for r in got.values()} == {"one.PDF", "again.pdf", "known.pdf"}
    assert (got[ids["two.pdf"]]["nb_pages"], got[ids["known.pdf"]]["from_cache"], got[ids["one.PDF"]]["doc_type"]) == (2, True, "native")
    cached = spark.read.parquet(f"{tmp_path}/cache").collect()
    assert {r.doc_id for r in cached} == {ids["one.PDF"], ids["two.pdf"]} and len(cached) == 3


def test_engines_have_an_outcome_for_every_image(monkeypatch):
    """Not installed, failing on one image, and working; what a vision model is asked."""
    import pickle
    import sys
    import types

    from waraq.operators import engines

    monkeypatch.setitem(sys.modules, "pytesseract", None)
    assert engines.LocalOcr()([b"a", None]) == [None, None]

    def read(image, lang, config):
        assert (lang, config) == ("ara+fra", "--psm 6 --oem 3")
        if image == b"bad":
            raise OSError("no image")
        return " text of " + image.decode()

    fake = types.SimpleNamespace(image_to_string=read, pytesseract=types.SimpleNamespace(tesseract_cmd=""))
    monkeypatch.setitem(sys.modules, "pytesseract", fake)
    monkeypatch.setitem(sys.modules, "PIL", types.SimpleNamespace(Image=types.SimpleNamespace(open=lambda file: file.read())))
    assert engines.LocalOcr(command="/bin/ocr")([b"one", b"bad", b""]) == [" text of one", "[ERR Tesseract: no image]", " text of "]
    assert fake.pytesseract.tesseract_cmd == "/bin/ocr"
    asked_, opened = [], []

    class Client:
        def generate(self, **call):
            asked_.append(call)
            if call["images"] == ["Yg=="]:
                raise TimeoutError("too slow")
            return {"response": None if call["images"] == [""] else "seen"}

    model = engines.VisionModel(lambda: opened.append(1) or Client(), "m")
    assert model([b"a", b"b", None]) == ["seen", "[ERR Vision: too slow]", ""] and opened == [1]
    assert asked_[0]["images"] == ["YQ=="] and asked_[0]["model"] == "m" and asked_[0]["stream"] is False and "النص" in asked_[0]["prompt"]
    assert asked_[0]["options"].items() >= {"num_ctx": 512, "num_predict": 800, "temperature": 0}.items() and asked_[0]["options"]["num_thread"] >= 2
    assert pickle.loads(pickle.dumps(engines.VisionModel(dict, "m")))._client is None
    lost = engines.VisionModel(lambda: 1 / 0)
    assert lost([b"a"])[0].startswith("[ERR Vision: ")


def test_upload_rate(spark):
    from waraq.streaming.ingest import upload_rate

    rows = [(datetime.datetime(2024, 1, 1, h, 5), b"abc" * n) for h, n in ((1, 1), (1, 2), (3, 1))]
    got = {(r.start.hour, r.uploads, r.bytes) for r in upload_rate(spark.createDataFrame(rows, "uploaded_at timestamp, content binary")).collect()}
    assert got == {(1, 2, 9), (3, 1, 3)}


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from waraq.runtime import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", applicationId="a")))
