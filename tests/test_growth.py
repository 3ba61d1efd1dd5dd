"""Tables that grow: the index by batches, document state by a stream, pages by ranges, whole rankings, observed runs."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from waraq.operators import index, observed, ranking, search
from waraq.operators.postings import Postings, write_postings
from waraq.operators.store import IndexStore
from waraq.sources import page_ranges
from waraq.streaming import uploads

PAGES = "doc_id string, seq long, page int, text string"


def some_uploads(n=40, docs=9):
    rng = random.Random(3)
    words = ["القانون", "كتاب", "كتابه", "كتابة", "محكمة", "المحكمه", "حكم"]
    content = {f"d{k}": [" ".join(rng.choices(words, k=6)) for _ in range(rng.randint(1, 3))] for k in range(docs)}
    rows = []
    for seq in range(n):
        doc = f"d{rng.randrange(docs)}"
        rows.append([(doc, seq, page + 1, text) for page, text in enumerate(content[doc])])
    deletions = [(rows[seq][0][0], seq) for seq in range(0, n, 7)] + [("never there", 3)]
    return rows, deletions


def test_index_by_batches_is_the_index_at_once(spark, tmp_path):
    rows, deletions = some_uploads()
    every = spark.createDataFrame([p for r in rows for p in r], PAGES)
    gone = spark.createDataFrame(deletions, "doc_id string, seq long")
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.pages().count() == store.forms().count() == 0
    state = lambda s: (sorted(map(str, s.pages().collect())), sorted(map(str, index.vocabulary(s.forms()).collect())))
    for batch in range(5):
        part = F.col("seq") % 5 == batch
        assert store.append(batch, every.filter(part), gone.filter(part))
        if batch in (1, 3):
            before = state(store)
            store.compact()
            assert store.batches() == [] and state(store) == before
            store.remove_old()
    assert not store.append(1, every, gone)  # taken in long ago
    assert store.append(4, every.filter("seq % 5 = 4"), gone.filter("seq % 5 = 4"))  # written again in its place
    last_gone = {}
    for doc, seq in deletions:
        last_gone[doc] = max(seq, last_gone.get(doc, -1))
    latest = {r[0][0]: k for k, r in enumerate(rows) if k > last_gone.get(r[0][0], -1)}
    want = sorted((d, s, p) for r in rows for d, s, p, _ in r if latest.get(d) == s)
    assert sorted((r.doc_id, r.seq, r.page) for r in store.pages().collect()) == want and want
    at_once = index.vocabulary(index.surface_counts(index.page_tokens(index.index_pages(every))))
    assert state(store)[1] == sorted(map(str, at_once.collect()))
    store.compact()
    assert (store.generation(), state(store)[1]) == (3, sorted(map(str, at_once.collect())))


def test_a_batch_that_was_cut_off_is_not_seen(spark, tmp_path):
    rows, _ = some_uploads(4)
    every = spark.createDataFrame([p for r in rows for p in r], PAGES)
    store = IndexStore(spark, str(tmp_path))
    store.append(0, every.filter("seq < 2"))
    before = sorted(map(str, store.forms().collect()))
    broken = every.filter("seq >= 2").withColumn("text", F.when(F.col("seq") == 3, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.append(1, broken)
    assert store.batches() == [0] and sorted(map(str, store.forms().collect())) == before
    store.append(1, every.filter("seq >= 2"))
    assert store.batches() == [0, 1]


def test_document_stream_through_failures(spark, tmp_path):
    """A sink that dies after it has written, and one that dies before: the stream goes on, and nothing counts twice."""
    rng, events = random.Random(5), []
    for seq in range(120):
        events.append((f"d{rng.randrange(12)}", seq, rng.random() < 0.3, f"f{seq}.pdf"))
    kind = "doc_id string, seq long, deleted boolean, filename string"
    shuffled = rng.sample(events, len(events))
    for k in range(6):
        spark.createDataFrame(shuffled[20 * k : 20 * k + 20], kind).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    deaths = {1: "after", 3: "before"}

    def sink(changes, batch, folder):
        death = deaths.pop(batch, None)
        if death == "before":
            raise RuntimeError("killed")
        uploads.write_changes(changes, batch, folder)
        if death:
            raise RuntimeError("killed")

    for _ in range(3):
        try:
            uploads.follow(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", sink).awaitTermination()
        except Exception as error:
            assert "killed" in str(error)
    assert not deaths
    want = []
    for doc in {e[0] for e in events}:
        ups = [e for e in events if e[0] == doc and not e[2]]
        gone = max((e[1] for e in events if e[0] == doc and e[2]), default=-1)
        last = max(ups, key=lambda e: e[1], default=None)
        want.append((doc, last and last[1], last and last[3], len(ups), bool(last) and last[1] > gone))
    got = [tuple(r) for r in uploads.documents(spark, f"{tmp_path}/out").select("doc_id", "seq", "filename", "uploads", "live").collect()]
    assert sorted(got) == sorted(want) and 0 < sum(w[4] for w in want) < len(want)


def test_pages_by_ranges(spark, tmp_path):
    """One huge file is work for many tasks; only pages with 50 solid characters or fewer have an image."""

    class Lines:
        """A made format: pages are lines, and a page whose text starts with ! cannot be drawn."""

        def count(self, file):
            body = file.read()
            if body.startswith(b"broken"):
                raise ValueError("not this format")
            return len(body.splitlines())

        def read(self, file, first, last):
            for number, line in itertools.islice(enumerate(file.read().decode().splitlines(), 1), first - 1, last):
                yield number, line, lambda line=line: b"image of " + line.encode(), None

    lines = [f"{k} " + "x" * (k % 100) for k in range(1, 1001)]
    (tmp_path / "huge file.PDF").write_text("\n".join(lines))
    (tmp_path / "one.pdf").write_text("a b")
    (tmp_path / "none.pdf").write_text("")  # empty files are not listed
    (tmp_path / "bad.pdf").write_text("broken")
    (tmp_path / "other.txt").write_text("no")
    files = page_ranges.uploaded_files(spark, str(tmp_path)).withColumn("seq", F.lit(1))
    assert {r.filename for r in files.collect()} == {"huge file.PDF", "one.pdf", "bad.pdf"}
    ranges = page_ranges.page_ranges(files, Lines(), 50).collect()
    assert sorted((r.first, r.last) for r in ranges if "huge" in r.path) == [(k, k + 49) for k in range(1, 1001, 50)] and len(ranges) == 21
    pages = page_ranges.read_pages(files, Lines(), 50, tasks=8).withColumn("task", F.spark_partition_id())
    names = {r.doc_id: r.filename for r in files.collect()}
    got = pages.collect()
    assert len({r.task for r in got if names[r.doc_id] == "huge file.PDF"}) > 3
    assert sorted((r.page, r.raw_text) for r in got if names[r.doc_id] == "huge file.PDF") == list(enumerate(lines, 1))
    for r in got:
        solid = len(r.raw_text.replace(" ", ""))
        assert (r.image is None) == (solid > 50) and r.preview is None
    assert any(len(r.raw_text.replace(" ", "")) == 50 for r in got) and any(len(r.raw_text.replace(" ", "")) == 51 for r in got)
    assert page_ranges.read_pages(files.limit(0), Lines()).count() == 0


def test_whole_ranking(spark):
    rng = random.Random(8)
    rows = [(q, f"d{k}", rng.randint(1, 4), rng.randrange(3), "x") for q in (1, 2, 3) for k in range(300 if q == 2 else 20)]
    found = spark.createDataFrame(rows, "query_id long, doc_id string, n_matches long, first_seq long, rank string").withColumnRenamed("rank", "_part_")
    ranked = ranking.rank_all(found.repartition(7))
    order = lambda q: [r[1] for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[3], r[1]))]
    got = {(r.query_id, r["rank"]): r.doc_id for r in ranked.collect()}
    assert got == {(q, k + 1): d for q in (1, 2, 3) for k, d in enumerate(order(q))}
    assert [r.doc_id for r in ranking.page_after(ranked, 2, 40, 10).collect()] == order(2)[40:50]
    shown, last = [], None
    while page := ranking.page_after_key(found, 2, last, 70).collect():
        shown += [r.doc_id for r in page]
        last = (page[-1].n_matches, page[-1].first_seq, page[-1].doc_id)
    assert shown == order(2)
    assert ranking.rank_all(found.limit(0)).count() == 0


def test_search_tells_its_time_and_counts(spark, tmp_path):
    pages = spark.createDataFrame([("d1", 1, 1, "القانون الاول", "القانون الاول"), ("d2", 2, 1, "القانون الثاني", "القانون الثاني")], "doc_id string, seq long, page int, text string, norm_text string")
    write_postings(pages, str(tmp_path))
    docs = spark.createDataFrame([("d1", "a.pdf", 1, 1), ("d2", "b.pdf", 1, 2)], "doc_id string, filename string, nb_pages long, first_seq long")
    vocab = spark.createDataFrame([("القانون", 2, "القانون", (1, 1, 0))], "norm string, n long, best_form string, first_seq struct<seq:long,page:int,pos:int>")
    corrections = spark.createDataFrame([(0, "zz", "yy")], "ord int, wrong string, right string")
    queries = spark.createDataFrame([(1, "القانون"), (2, "abc"), (3, " ")], "query_id long, query string")
    answers = search.answers(*search.search(queries, Postings(spark, str(tmp_path)), docs, vocab, corrections))
    ticks = iter([5.0, 5.25678])
    run = observed.answer_search(answers)
    assert run.counts == {"queries": 3, "answered": 1, "results": 2} and run.elapsed_ms > 0 and round(run.elapsed_ms, 1) == run.elapsed_ms
    assert {r.query_id: json.loads(r.answer)["total"] for r in run.result} == {1: 2, 2: 0, 3: 0}
    told = observed.measure(queries, lambda df: df.write.format("noop").mode("overwrite").save(), lambda: next(ticks), longest=F.max(F.length("query")))
    assert told.elapsed_ms == 256.8 and told.counts == {"longest": 7} and told.result is None
