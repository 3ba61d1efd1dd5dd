"""Quality, toxicity and language: held-out accuracy on whole tables, brute-force parts, odd rows."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waraq.llm import language_id, quality, toxicity
from waraq.llm.queries import QUERIES

ODD = [(1, None, "en"), (2, "", "fr"), (3, " \n ", None), (4, "12 34 %%", "de"), (None, "the thing and that", "en"), (6, "und der die " * 9000, None), (7, "la los para", "es"), (7, "la los para", "es")]


def odd_docs(spark, rows=ODD):
    docs = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]))
    for name in ("score", "held_out", "predicted", "lang_pred", "y", "toxic_score", "quality", "toxic", "n"):
        docs = docs.withColumn(name, docs["doc_id"])
    return docs


def odd_labels(spark, rows=((2, 1, 0), (4, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def held_out(doc_id, modulus, at):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == at


def scored(spark, sf, name, label):
    got = QUERIES[name](spark, sf).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs and all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    return [(r, truth[r.doc_id]) for r in got if truth.get(r.doc_id) is not None]


def test_quality_held_out(spark, sf):
    rows = scored(spark, sf, "op3_quality", "quality")
    assert all(r.predicted == int(r.score >= 0.3) for r, _ in rows)
    tested = [(r.score, y) for r, y in rows if r.held_out]
    good, bad = [s for s, y in tested if y], [s for s, y in tested if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == bool(y) for s, y in tested]) > 0.93


def test_quality_gradients_and_attention():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel(hidden=5, gate=4)
    base = np.array([0, 3, 4, 9])
    x, y = rng.normal(0, 1, (9, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    out = model.forward(x, base)
    assert np.allclose(np.add.reduceat(out["a"], base[:-1]), 1)
    loss = lambda: -np.mean(np.log(np.where(y > 0, model.forward(x, base)["y"], 1 - model.forward(x, base)["y"])))
    grads = model.gradients(x, base, y)
    for name, p in model.p.items():
        flat = p.reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - grads[name].reshape(-1)[i]) < 1e-5, name


def features_by_hand(words):
    """A passage's features from its words and the white space between them, counted one by one."""
    text = "".join(words).encode()
    kinds = [next((k for k, chars in enumerate(quality._GROUPS) if b < 128 and chr(b) in chars), 10 if b >= 128 else 11) for b in text]
    pairs = defaultdict(int)
    for a, b in zip(kinds, kinds[1:]):
        pairs[a * quality.CLASSES + b] += 1
    solid = [w.strip(" \n\t") for w in words]
    out = np.zeros(quality.FEATURES)
    for k, n in pairs.items():
        out[k] = np.sqrt(n / sum(pairs.values()))
    for lag in range(1, quality.LAGS + 1):
        out[quality.CLASSES**2 + lag - 1] = sum(a == b for a, b in zip(solid, solid[lag:])) / len(words)
    out[-2], out[-1] = np.log1p(len(words)) / 4, np.log1p(len(text) / len(words)) / 2
    return out


def test_quality_score_against_loops(spark, sf_small):
    """Features, attention and score of whole texts, passage by passage."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    p = model.p
    for r in docs.limit(60).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r.text or "")
        bag = [features_by_hand(words[k : k + quality.PASSAGE_WORDS]) for k in range(0, len(words), quality.PASSAGE_WORDS)] or [np.zeros(quality.FEATURES)]
        hs = [np.tanh(x @ p["W"] + p["b"]) for x in bag]
        es = [float(np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"])))) @ p["w"]) for h in hs]
        weights = np.exp(np.array(es) - max(es))
        z = sum(a * h for a, h in zip(weights / weights.sum(), hs))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))) < 1e-4, r.doc_id


def test_quality_reads_every_passage():
    x, base = quality.passage_features(pa.array(["word " * 1000, None, "", "a\nb"]))
    assert np.diff(base).tolist() == [-(-1000 // quality.PASSAGE_WORDS), 1, 1, 1] and not x[base[1]].any()


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows_are_scored(spark, score):
    got = score(odd_docs(spark), odd_labels(spark)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in ODD)
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id, 5, 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 7}) == 1
    assert score(odd_docs(spark, []), odd_labels(spark)).count() == 0
    assert len(score(odd_docs(spark), odd_labels(spark, ())).collect()) == len(ODD)


def test_toxicity_held_out(spark, sf):
    rows = scored(spark, sf, "op7_toxicity", "toxic")
    assert all(r.predicted == int(r.score >= 0.5) for r, _ in rows)
    held = [(r.predicted, y) for r, y in rows if r.held_out]
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.04  # few rows: at ten times the size 0.92 and 0.002


def test_subsequence_kernel_is_the_kernel():
    """Against all gapped subsequences of three characters, counted one by one."""

    def brute(word):
        marked, out = "^" + word, defaultdict(float)
        for i in range(len(marked)):
            for j in range(i + 1, len(marked)):
                for k in range(j + 1, min(len(marked), i + toxicity.SPAN)):
                    out[marked[i] + marked[j] + marked[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    words = ["idiot", "idxiot", "scum", "a", "bo"]
    owner, key, weight = toxicity.subsequences(words)
    vectors = [np.bincount(key[owner == i], weights=weight[owner == i], minlength=1 << toxicity.TABLE_BITS) for i in range(len(words))]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            p, q = brute(a), brute(b)
            assert abs(vectors[i] @ vectors[j] - sum(v * q[s] for s, v in p.items())) < 1e-6
    assert toxicity.Landmarks(words[:3]).kernel(words[:2])[1, 0] > 0.5  # an inserted character costs weight, not the match


def made_corpus(n=400):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abdefgklnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    insults = ["zonkhead", "quimbler", "vexnot"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for at in rng.sample(range(60), 4):
                words[at] = rng.choice(insults)
        rows.append((i, " ".join(words) + ".", i % 4 == 0))
    return rows


def test_disguised_insults_are_found(spark):
    rows = made_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    clean = rows[1][1]
    tests = [clean, *(clean + " " + f"{x} {y} and {z}." for x, y, z in [("zonkhead", "vexnot", "quimbler"), ("zonk-head", "quim.bler", "vexn0t"), ("zonkkhead", "quiimbler", "vexxnot"), ("z o n k h e a d", "q u i m b l e r", "v e x n o t")])]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*tests, "", " ", "word", rows[1][1][:20]])], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.unionByName(more), labels).collect()}
    assert [got[1000 + i] for i in range(len(tests) + 4)] == [0, 1, 1, 1, 1, 0, 0, 0, 0]  # without an insult no text is toxic, however short
    left = toxicity.drop_toxic(docs.withColumn("toxic_score", F.lit("kept")), labels)
    assert left.columns == ["doc_id", "text", "toxic_score"]
    assert {r.doc_id for r in left.collect()} == {i for i, _, y in rows if not y}


# language


def test_language_held_out(spark, sf):
    got = QUERIES["op10_language_id"](spark, sf).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(got) == len(truth) and all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    tested = [(r.lang_pred, truth[r.doc_id][0]) for r in got if r.held_out and truth[r.doc_id][0] is not None and any(c.isalpha() for c in truth[r.doc_id][1] or "")]
    assert np.mean([a == b for a, b in tested]) > 0.97


def test_language_odd_rows(spark):
    train = [(100 + i, t * 5, lang) for i in range(40) for t, lang in (("the and that thing is ", "en"), ("la los para ción el ", "es"), ("und der die ein nicht ", "de"))]
    got = {r.doc_id: r for r in language_id.identify(odd_docs(spark, ODD + [(k + 1000 * (lang == "es") + 2000 * (lang == "de"), t, lang) for k, t, lang in train])).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(got[i].score == 0 for i in (1, 2, 3, 4))
    assert (got[None].lang_pred, got[6].lang_pred, got[7].lang_pred) == ("en", "de", "es")
    assert language_id.identify(odd_docs(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs(spark, ODD[:3])).collect()} == {"und"}


def test_language_counts_against_sets(spark, sf_small):
    """Prediction and score from n-gram sets and dictionaries, text by text."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    names, tables, rates = language_id.learn(docs)
    letters = lambda t: re.sub(rb"[^a-z\x80-\xff]+", b" ", f" {t.lower()} ".encode())
    slots = lambda g: [int(s[0]) for s in language_id.slots_of(np.array([int.from_bytes(g, "little")], np.uint32))]
    known = {}
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in docs.limit(40).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        data = letters(r.text)
        grams = [data[k : k + 4] for k in range(len(data) - 3)]
        counts = []
        for lang in range(len(names)):
            hits = 0
            for g in grams:
                if (g, lang) not in known:
                    known[g, lang] = all(tables[lang // 8][s] >> (lang % 8) & 1 for s in slots(g))
                hits += known[g, lang]
            counts.append(max(0, (hits - len(grams) * rates[lang]) / (1 - rates[lang])))
        assert got[r.doc_id].lang_pred == names[int(np.argmax(counts))]
        assert abs(got[r.doc_id].score - (max(counts) / sum(counts) if sum(counts) else 0)) < 1e-6


def test_keep_languages(spark):
    train = [(100 + i, t * 5, lang) for i in range(40) for t, lang in (("the and that thing is ", "en"), ("la los para ción el ", "es"))]
    docs = odd_docs(spark, ODD + [(k + 1000 * (lang == "es"), t, lang) for k, t, lang in train])
    kept = language_id.keep_languages(docs, ["es"])
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [7, 7] + [1100 + i for i in range(40)]
    assert sorted(r.doc_id for r in language_id.keep_languages(docs, ["und"]).collect()) == [1, 2, 3, 4]
    nothing = odd_docs(spark, [(2, "words", None)])
    assert language_id.keep_languages(nothing, ["en"]).count() == 0 and language_id.keep_languages(nothing, ["und"]).count() == 1
    assert language_id.keep_languages(odd_docs(spark, []), ["en"]).count() == 0


def test_a_dirty_language_column_is_bounded(spark):
    rows = [(i, f"the quick brown fox number {i} jumps", "en") for i in range(60)] + [(100 + i, f"der schnelle braune fuchs {i}", "de") for i in range(40)] + [(200 + i, f"noise {i}", f"x{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, _, _ = language_id.learn(docs, max_langs=2)
    assert names == ["de", "en"]
    assert {r.lang_pred for r in language_id.identify(docs, max_langs=2).collect()} <= {"de", "en"}


def test_rare_languages_are_learned_alike(spark):
    rows = [(i, f"the and that thing is number{i} ", "en") for i in range(3000)] + [(9000 + i, f"zun quelo prati moxe {i} ", "xx") for i in range(30)]
    names, tables, _ = language_id.learn(odd_docs(spark, rows), train_docs=60)
    asked = language_id.language_counts(pa.array(["zun quelo prati"]), tables, np.zeros(2))[0][0]
    assert names == ["en", "xx"] and asked[1] > 8 > asked[0]


def test_bit_sliced_filters_answer_for_all_languages():
    rng = np.random.default_rng(2)
    grams = [rng.choice(1 << 32, 3000, replace=False).astype(np.uint32) for _ in range(11)]  # more than one table of eight
    tables, rates = language_id.build_filters(grams)
    assert len(tables) == 2
    asked = rng.choice(1 << 32, 20_000).astype(np.uint32)
    for lang, own in enumerate(grams):
        member = lambda g, lang=lang: np.all([(tables[lang // 8][s] >> np.uint8(lang % 8)) & 1 for s in language_id.slots_of(g)], axis=0)
        assert member(own).all()  # no false negatives
        assert abs(member(asked).mean() - rates[lang]) < 0.005
    counts, total = language_id.language_counts(pa.array(["the thing", None, "x"]), tables, rates)
    assert counts.shape == (3, 11) and total[1] == 0 and (counts >= 0).all()


def test_evidence_is_the_same_in_fitting_and_scoring(monkeypatch):
    """What the rule is fitted on is what it scores: for insults in many sentences, spellings and repeats."""
    fitted = {}
    made = toxicity.fit_rule
    monkeypatch.setattr(toxicity, "fit_rule", lambda evidence, y: fitted.setdefault("rule", (evidence, made(evidence, y)))[1])
    rows = made_corpus()
    long = "The plain words go on 12 -- here, zonkhead. " * 20 + "Zonkhead zonk-head ZONKHEAD z o n k h e a d! vexnot vexnot vexnot vexnot vexnot " + "no end " * 20_000
    texts = [[long, *(t for _, t, y in rows if y)], [t for _, t, y in rows if not y]]
    bags = toxicity.Documents()
    toxic, clean = ([bags.read(t) for t in part] for part in texts)
    machine = toxicity.train(toxic, clean, bags.words)
    toxicity._memo.clear()
    scored = toxicity.evidence_of(toxicity._evidence(machine, [*texts[0], *texts[1]]))
    assert np.allclose(fitted["rule"][0], scored, atol=1e-2)
    assert np.expm1(scored[0, 0]) > 20


def test_toxicity_score_by_hand(spark):
    """The document's score from the kernel with the landmarks, sentence by sentence and word by word."""
    rows = made_corpus(120)
    bags = toxicity.Documents()
    machine = toxicity.train([bags.read(t) for _, t, y in rows if y], [bags.read(t) for _, t, y in rows if not y], bags.words)
    texts = [rows[0][1], rows[1][1], "Such a zonk-head! And vexnot too. " + rows[2][1], "", "?! -- 1", "q u i m b l e r is here"]

    def value(word):
        marked, total, norm = "^" + word, 0.0, 0.0
        weights = defaultdict(float)
        for i in range(len(marked)):
            for j in range(i + 1, len(marked)):
                for k in range(j + 1, min(len(marked), i + toxicity.SPAN)):
                    weights[i, j, k] = toxicity.DECAY ** (k - i + 1)
        owner, key, weight = toxicity.subsequences([word])
        assert np.isclose(sorted(weight), sorted(weights.values())).all()
        for c, w in zip(key, weight):
            total += w * machine.table[c]
            norm += w * w
        return total / max(norm**0.5, 1e-9) + machine.bias

    want = []
    for text in texts:
        hits, best, n = 0.0, -1.0, 0
        for sentence in re.split(r"[\n.!?]+(?=\s|$)", text):
            words = sentence.split() + ["".join(m.group().split()) for m in toxicity._SPACED.finditer(sentence)]
            values = [value(w) for w in map(toxicity.fold, words) if w]
            n += len(values)
            for k in range(0, len(values), 24):
                top = max(values[k : k + 24])
                best = max(best, min(top, 1))
                hits += min(max(top, 0), 1)
        e = np.array([np.log1p(hits), best, np.log1p(n / toxicity.SHORT), 1])
        want.append(1 / (1 + np.exp(-e @ machine.rule)))
    assert np.allclose(toxicity.document_scores(machine, texts), want, atol=1e-6)
    assert want[0] > 0.5 > want[1] and want[2] > 0.5 > want[3]
