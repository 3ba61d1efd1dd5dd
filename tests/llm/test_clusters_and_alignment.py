"""Brute-force checks of centroid clustering, cross-tokenizer alignment and MinHash near copies, with odd rows."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from waraq.llm import alignment, centroids, minhash
from waraq.llm.queries import ORACLE, QUERIES

from test_copies_and_shards import ODD, odd_docs


def from_sql(name, sf_dir, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    return [dict(zip(names, row)) for row in cur.fetchall()]


def by_columns(rows):
    return sorted(tuple(sorted(r.items())) for r in rows)


# clustering


def brute_clusters(rows, k, rounds, seed=2):
    """``rows``: (vec_id, integers). cluster and squared distance of each row, and the final centroids."""
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), b"".join(int(v).to_bytes(4, "little", signed=True) for v in x), x) for i, x in rows)[:k]
    centres = [list(x) for _, _, x in first]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in rows]
        for j in range(len(centres)):
            if members := [x for (_, x), o in zip(rows, own) if o == j]:
                centres[j] = [sum(c) // len(members) for c in zip(*members)]
    return [nearest(x)[::-1] for _, x in rows], centres


def test_exponion_finds_the_nearest_and_skips_most():
    """Dense integers, so that ties and equal centroids abound, over rounds that carry the bounds on."""
    rng, scanned, all_ = np.random.default_rng(1), 0, 0
    for _ in range(120):
        n, dim, spread = int(rng.integers(1, 400)), int(rng.choice([1, 2, 8])), int(rng.choice([1, 3, 50]))
        k = min(n, int(rng.choice([1, 2, 5, 40])))
        x = rng.integers(-spread, spread + 1, (n, dim)).astype(np.int64)
        now, before, own, upper, lower = x[:k].copy(), None, np.full(n, -1), np.full(n, np.inf), np.zeros(n)
        for _ in range(6):
            own, upper, lower, seen = centroids.assign(x, own, upper, lower, centroids.Centroids(now, before))
            scanned, all_ = scanned + seen, all_ + n * k
            d = ((x[:, None, :] - now[None]) ** 2).sum(2)
            assert (own == d.argmin(1)).all()
            before, now = now, np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else now[j] for j in range(k)])
    assert scanned < 0.7 * all_


def test_large_numbers_are_exact():
    x = np.array([[centroids.LIMIT, -centroids.LIMIT, 1]], np.int64)
    assert centroids.squared(x, -x)[0, 0] == sum((2 * int(v)) ** 2 for v in x[0])
    assert centroids.squared(x // 32, -x // 32)[0, 0] == sum((int(v) // 32 - (-int(v) // 32)) ** 2 for v in x[0])


def test_clusters_of_the_whole_table(spark, sf):
    want = from_sql("op11_centroids", sf, "embeddings")
    got = [r.asDict() for r in QUERIES["op11_centroids"](spark, sf).collect()]
    assert len(got) > 100 and by_columns(got) == by_columns(want)


@pytest.mark.parametrize("clusters, rounds", [(3, 4), (40, 2), (1, 1)])
def test_clusters_by_brute_force(spark, clusters, rounds):
    rng = np.random.default_rng(clusters)
    rows = [(i, (rng.integers(-3, 4, 4) / 4).tolist(), "x") for i in range(30)]
    rows += [(4, rows[4][1], "again"), (100, rows[5][1], "equal"), (None, [0.1, 0.2, 0.3, -0.4], None)]
    odd = [(201, None, ""), (202, [], ""), (203, [1.0] * 3, ""), (204, [1.0] * 5, ""), (205, [1.0, None, 1.0, 1.0], ""), (206, [1.0, float("nan"), 1.0, 1.0], ""), (207, [1.0, float("-inf"), 1.0, 1.0], "")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster string").withColumnRenamed("cluster", "Cluster")
    got = centroids.cluster(frame, clusters=clusters, rounds=rounds, dimensions=4, scale=8).collect()
    whole = [(i, [int(np.floor(v * 8)) for v in x]) for i, x, _ in rows]
    want, centres = brute_clusters(whole, clusters, rounds)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), c, d) for (i, _), (c, d) in zip(whole, want))
    assert {r.inertia for r in got} == {sum(d for _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert centroids.cluster(none).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="squared distances"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


# alignment


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    of_char = {}  # the byte-level alphabet
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        of_char[chr(b) if b in shown else chr(256 + sum(x not in shown for x in range(b)))] = b
    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out, held = [], defaultdict(int)
    for i, text in rows:
        a = bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a, bytes_b = ([bytes(of_char[c] for c in bpe.id_to_token(t)) for t in a], [piece(t) for t in b])
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((i, 0, 0, [], []))
            continue
        groups, at_a, at_b, x, y = [], 0, 0, 0, 0
        while x < len(a):
            own = ([], [])
            while True:
                if at_a <= at_b and not (at_a == at_b and own[0]):
                    at_a += len(bytes_a[x])
                    own[0].append(a[x])
                    x += 1
                else:
                    at_b += len(bytes_b[y])
                    own[1].append(b[y])
                    y += 1
                if at_a == at_b:
                    break
            groups.append(own)
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        for pair in set(links):
            held[pair] += 1
        out.append((i, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for i, n_a, n_b, groups, links in out:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield i, n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), digest


def alignment_rows(frame):
    return sorted((tuple(r[c] for c in alignment.COLUMNS) for r in frame.collect()), key=str)


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 300, 0])
def test_alignment_of_the_whole_table(spark, sf_small, broadcast_pairs):
    """The counts of all pairs by broadcast, of some, and of none: the same rows."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert alignment_rows(alignment.align(docs, broadcast_pairs=broadcast_pairs)) == sorted(want, key=str)


def test_alignment_of_odd_rows(spark):
    texts = ["<|endoftext|> a", "<unk><s> x </s> <0x41>", "a▁b", "nul\x00 in it", "  two  spaces ", "\n\ttab\r\n", "漢字 と 🙂🙂", "é" * 400, " " * 3000 + "x", "\n" * 3000, "a" * 5000, " "]
    rows = [*ODD, *((100 + k, t, "t") for k, t in enumerate(texts)), (5, " \n\t ", "again")]
    want = sorted(brute_alignment([(i, t) for i, t, _ in rows]), key=str)
    assert alignment_rows(alignment.align(odd_docs(spark, rows))) == want
    assert alignment_rows(alignment.align(odd_docs(spark, rows), broadcast_pairs=5)) == want
    assert alignment.align(odd_docs(spark, [])).count() == 0
    assert alignment.align(odd_docs(spark, [(1, None, None), (2, "", "x")])).count() == 2


def test_links_are_expanded_for_different_ids_only():
    """One group of 40,000 equal tokens on either side has 1.6 * 10**9 links and one pair."""
    a = b = np.full(40_000, 7, np.int64)
    pairs, links = alignment.linked_pairs(a, b, np.zeros_like(a), np.zeros_like(b), 1)
    assert pairs.tolist() == [7 << 32 | 7] and links.tolist() == [40_000**2]


# MinHash


def brute_sets(rows):
    out = []
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
        out.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    return out


def brute_near(rows, percent=85):
    sets = brute_sets(rows)
    label = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            (_, a), (_, b) = sets[x], sets[y]
            if a and 100 * len(a & b) >= percent * len(a | b):
                old, new = sorted((label[x], label[y]))[::-1]
                label = [new if v == old else v for v in label]
    low = {}
    for (i, _), v in zip(sets, label):
        if i is not None:
            low[v] = min(low.get(v, i), i)
    return sorted(((i, len(s), low.get(v), i == low.get(v)) for (i, s), v in zip(sets, label)), key=str)


def near_rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_near_copies_of_the_whole_table(spark, sf):
    want = from_sql("op13_minhash", sf, "documents")
    got = [r.asDict() for r in QUERIES["op13_minhash"](spark, sf).collect()]
    assert by_columns(got) == by_columns(want) and sum(not r["kept"] for r in got) > 50


def test_near_copies_of_odd_rows(spark):
    rows = [*ODD, (20, "hapax", ""), (21, "two words", ""), (22, "Two\nWORDS", ""), (23, "a b c a b c a b c", ""), (24, "a b c a b c", "")]
    assert near_rows(minhash.near_copies(odd_docs(spark, rows))) == brute_near([(i, t) for i, t, _ in rows])
    assert minhash.near_copies(odd_docs(spark, [])).count() == 0


def test_near_copies_at_the_boundary(spark):
    """Sets whose similarity is just 0.85, just below and around it; chains; many copies of one text."""
    rng, rows = np.random.default_rng(7), []
    for k in range(150):
        n = int(rng.integers(20, 200))
        base = [f"w{k}x{j}" for j in range(n + 2)]
        at = int(rng.integers(0, n))
        changed = list(base)
        width = max(1, int(n * rng.uniform(0, 0.12)))
        changed[at : at + width] = [f"n{k}x{j}" for j in range(len(changed[at : at + width]))]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(changed)), (3 * k + 2, " ".join(changed[: int(n * 0.9)]))]
    exact = [f"e{j}" for j in range(19)]  # 17 shingles of which 17 are shared, of 20: 0.85
    rows += [(900, " ".join(exact)), (901, " ".join([*exact, "x", "y", "z"])), (902, " ".join([*exact, "x", "y", "z", "q"]))]
    rows += [(1000 + i, " ".join(exact)) for i in range(3000)]
    want = brute_near(rows[:453])
    got = {r[0]: r for r in near_rows(minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert [got[i] for i in sorted(r[0] for r in want)] == sorted(want) and got[901][2] == 900
    assert all(got[1000 + i][2:] == (900, False) for i in range(3000))


def test_sketches_fill_and_estimate():
    """Every coordinate is filled, for small sets too, and agreement is about the similarity."""
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 3, 50, 4000]
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    got = minhash.sketches(np.concatenate(sets), np.cumsum([0, *sizes]))
    filled = (got != np.uint64(0xFFFFFFFFFFFFFFFF)).sum(1)
    assert filled.tolist() == [0, *[minhash.COORDINATES] * 5]
    agreement = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 200).astype(np.uint64)
        b = np.r_[a[:170], rng.integers(0, 2**63, 30).astype(np.uint64)]
        s = minhash.sketches(np.r_[a, b], np.array([0, 200, 400]))
        agreement.append((s[0] == s[1]).mean())
    assert abs(np.mean(agreement) - 170 / 230) < 0.02 and np.std(agreement) < 0.045
