"""Brute-force checks of sharding, exact dedup, SimHash and packing, with odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waraq.llm import components, exact_dedup, packing, sharding, simhash
from waraq.llm.queries import QUERIES

ODD = [
    (1, "alpha beta gamma", "x"),
    (2, "alpha  beta\tgamma", "y"),
    (3, None, None),
    (4, "", "z"),
    (5, " \n\t ", "z"),
    (None, "alpha beta gamma", "n"),
    (7, "word " * 40_000, "long"),
    (7, "word " * 40_000, "long"),
    (8, "été   ñandú", "u"),
    (9, "Alpha BETA gamma", None),
    (10, "hapax", "<|endoftext|>"),
]


def odd_docs(spark, rows=ODD):
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()))])
    docs = spark.createDataFrame(rows, schema)
    for name in ("size", "kept", "node", "raw_hash", "block", "f0", "key", "part"):
        docs = docs.withColumn(name, docs["lang"])
    return docs


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# exact dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return groups


def test_exact_dedup_whole_table(spark, sf):
    rows = docs_of(spark, sf)
    groups = brute_groups(rows)
    text = dict(rows)
    got = QUERIES["op8_exact_dedup"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        group = groups[normal(text[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), r.doc_id == min(group))
        assert r.text_sha256 == hashlib.sha256(normal(text[r.doc_id]).encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup.exact_groups(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].keep_id == 1 and by_id[None].group_size == 3 and not by_id[None].kept
    assert by_id[2].keep_id == 1 and by_id[4].keep_id == 3 and by_id[5].keep_id == 5
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]
    kept = exact_dedup.keep_first(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9, 10]
    assert exact_dedup.exact_groups(odd_docs(spark, [])).count() == 0


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    real = exact_dedup.fingerprint_table
    monkeypatch.setattr(exact_dedup, "fingerprint_table", lambda docs, chunk: real(docs, chunk).withColumns({"fp_a": F.lit(0), "fp_b": F.lit(0)}))
    rows = [(1, "aaaa", ""), (2, "bbbb", ""), (3, "aaaa", ""), (4, "bbbb", ""), (5, "cc", "")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd_docs(spark, rows)).collect()}
    assert got == {1: (1, 2, True), 3: (1, 2, False), 2: (2, 2, True), 4: (2, 2, False), 5: (5, 1, True)}


def test_chunk_hashes_compose():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (3, 1024), (1500, 4097)):
        a, b = rng.integers(0, 256, n, np.uint8).tobytes(), rng.integers(0, 256, m, np.uint8).tobytes()
        fa, fb, both = exact_dedup.fingerprints([a, b, a + b])
        for r, (p, base) in enumerate(exact_dedup.RESIDUES):
            assert exact_dedup.combine(fa[r], fb[r], m, p, base) == both[r]
            value = 0
            for c in a + b:
                value = (value * base + c) % p
            assert value == both[r]


# simhash


def brute_print(text, words=3):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not found:
        return 0
    k = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + k]).encode(), 42) for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    low = {}
    for i, f in rows:
        low[find(f)] = min(low.get(find(f), i), i)
    return {i: low[find(f)] for i, f in rows}


def test_simhash_whole_table(spark, sf):
    rows = [(i, brute_print(t)) for i, t in docs_of(spark, sf)]
    want = brute_components(rows)
    got = QUERIES["op2_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in rows}
    assert len(got) == len(rows)


def test_simhash_odd_rows(spark):
    rows = [r for r in ODD if r[0] is not None and r[0] != 7]
    got = {r.doc_id: r for r in simhash.fingerprint_components(odd_docs(spark, rows)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{brute_print(t):016x}" for i, t, _ in rows}
    assert {i: r.component_id for i, r in got.items()} == brute_components([(i, brute_print(t)) for i, t, _ in rows])
    assert simhash.fingerprint_components(odd_docs(spark)).count() == len(ODD)
    assert simhash.fingerprint_components(odd_docs(spark, [])).count() == 0


@pytest.mark.parametrize("tile, rounds", [(8, 0), (8, 1), (8, 4), (2048, 4)])
def test_links_in_blocks_loses_none(spark, tile, rounds):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 4)
    prints = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (40, 2))})
    frame = spark.createDataFrame([(p,) for p in prints], "f0 long")
    roots = components.connected_components(simhash.links_in_blocks(simhash.exact_blocks(frame, 2), 1, 2, tile=tile, rounds=rounds))
    got = {r.node: r.root for r in roots.collect()}
    assert {p: got.get(p, p) for p in prints} == brute_components([(p, p) for p in prints])


@pytest.mark.parametrize("lanes,radius", [(1, 2), (4, 48), (1, 7)])
def test_bit_sliced_distances(lanes, radius):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, (70, lanes)).astype(np.uint64)
    b = a[rng.integers(0, 70, 90)] ^ (np.uint64(1) << rng.integers(0, 63, (90, lanes)).astype(np.uint64))
    i, j = simhash.linked_pairs(a, b, radius, simhash._allowed(np.zeros(70), np.zeros(90), False))
    want = {(x, y) for x in range(70) for y in range(90) if sum((int(p) ^ int(q)).bit_count() for p, q in zip(a[x], b[y])) <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_near_copies_found_and_others_kept(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(4000)]
    base = [list(rng.choice(words, 300)) for _ in range(6)]
    rows, i = [], 0
    for b in base:
        for copy in range(4):
            w = list(b)
            for at in rng.integers(0, 300, 3 * bool(copy)):
                w[at] = "changed"
            rows.append((i, " ".join(w), "en"))
            i += 1
    rows += [(900, None, None), (901, "", ""), (902, " ", "")]
    docs = odd_docs(spark, rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 8, 12, 16, 20, 900, 901, 902]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# sharding


@pytest.mark.parametrize("odd", [False, True])
def test_sharding_law(spark, sf, odd):
    docs = odd_docs(spark) if odd else spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sharding.shard(docs).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    sizes = defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if not odd:
        ideal, largest = sum(sizes.values()) / 8, max(w[0] for w in want)
        assert len(sizes) == 8 and all(abs(s - ideal) <= 0.004 * ideal + largest for s in sizes.values())


def test_sharding_cuts_a_large_group_of_copies(spark):
    rows = [(i, "the same text in very many rows" if i % 3 else f"text number {i}", "en") for i in range(9000)]
    got = sharding.shard(odd_docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r["size"]
    ideal = sum(sizes.values()) / 8
    assert max(abs(s - ideal) for s in sizes.values()) <= 0.01 * ideal
    assert sharding.shard(odd_docs(spark, [])).count() == 0
    more = sharding.shard(odd_docs(spark, rows), shards=3, rows_per_part=100).collect()  # thirty parts a shard
    slots = defaultdict(list)
    for r in more:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2] and all(sorted(s) == list(range(len(s))) for s in slots.values())


# packing


@pytest.mark.parametrize("odd", [False, True])
def test_packing(spark, sf_small, odd):
    from tokenizers import Tokenizer

    docs = odd_docs(spark) if odd else spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: reference.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got = packing.pack(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    total = sum(len(ids[i]) for i, _ in rows)
    assert sum(n for p in pieces.values() for _, n in p) == total
    assert sorted(sequences) == list(range(-(-total // 2048)))
    for s, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == (2048 if s < len(sequences) - 1 else total - 2048 * (len(sequences) - 1))


def test_memo_encoder_equals_plain_encoding():
    path, pattern = packing.default_vocabulary()
    encoder = packing.PieceEncoder(path, pattern)
    for text in ("", " ", "a", " a", "a  b", "a\nb c", "a \n b", "it's  the end ", "x  y", "été d'été 12 %%% $$", "tab\there now", "a b\n", "\na b", "<|endoftext|> x"):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.encoding.encode_ordinary(text), repr(text)


def test_very_long_runs_of_white_space(spark):
    """A megabyte of one kind of white space, alone, inside a text, before an added token and at the end."""
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 1_000_000
    texts = [" " * n, "\n" * n, "a" + "\t" * n + "b c", "x" + " " * n + "<|endoftext|> y" + "\n" * 3000, " \n" * 3000 + "\u3000" * 2000 + " z", "é" + "\x85\xa0" * 4000 + "1", "q" + " " * 999 + "r" + " " * 1000 + "s" + " " * 1001 + "t"]
    encoder = packing.PieceEncoder(*packing.default_vocabulary(), packing.default_added())
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_batch(texts)]
    assert got == [reference.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {i: len(x) + 1 for i, x in enumerate(got)}


def test_added_tokens_are_those_of_the_json(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [mark, f"{mark} x", f"a{mark}b", f"a  {mark}\n b", f"end. {mark}{mark} next\n{mark}\nline", f" {mark}\t", "<|endoftext |> <|endoftext|"]
    encoder = packing.PieceEncoder(*packing.default_vocabulary(), packing.default_added())
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_batch(texts)]
    assert got == [reference.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.doc_tokens for r in packing.tokenise(docs).collect()} == {i: len(x) + 1 for i, x in enumerate(got)}


def changed_copies(rng, base, n_changed):
    """A text and one with its first words replaced, and the share of their union that their shingle sets have in common."""
    other = [f"new{rng.random()}" for _ in range(n_changed)] + base[n_changed:]
    a, b = (set(simhash.shingle_hashes(" ".join(x), 5).tolist()) for x in (base, other))
    return " ".join(base), " ".join(other), len(a & b) / len(a | b)


def test_near_copies_by_exact_similarity(spark):
    """Pairs from 0.6 to 0.95, short ones too, and a passage repeated often: linked at 0.8 or more and not below."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for k in range(240):
        base = [f"w{k}x{j}" for j in range(int(rng.integers(8, 200)))]
        a, b, similarity = changed_copies(rng, base, int(len(base) * rng.uniform(0.02, 0.3)))
        rows += [(2 * k, a), (2 * k + 1, b)]
        want[2 * k + 1] = 2 * k if similarity >= 0.8 else 2 * k + 1
    passage = " ".join(f"p{j}" for j in range(30)) + " "
    rows += [(1000 + i, passage * 40 + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(2)]
    want[1001] = 1001
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == want and 20 < sum(i != c for i, c in want.items()) < 220


@pytest.mark.parametrize("tile, rounds", [(512, 4), (4, 2), (4, 0)])
def test_links_of_sets_lose_none(spark, tile, rounds):
    rng = np.random.default_rng(3)
    sets = [sorted(set(rng.choice(40, int(rng.integers(18, 22)), replace=False).tolist())) for _ in range(6)]
    sets = [sorted({*s, *rng.choice(40, int(rng.integers(0, 4))).tolist()}) for s in sets for _ in range(8)]
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len({*a} & {*b}) >= 0.8 * len({*a} | {*b}):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sets)], "block long, node long, shingles array<long>")
    roots = {r.node: r.root for r in components.connected_components(simhash.links_of_sets(rows, 0.8, tile, rounds)).collect()}
    assert [roots.get(i, i) for i in range(len(sets))] == want and 1 < len(set(want)) < len(sets)


def test_long_texts_are_hashed_in_pieces():
    rng = np.random.default_rng(5)
    data = [rng.integers(0, 256, int(n), np.uint8).tobytes() for n in (0, 1, 700, 5000, 12_345, 3, 4096)]
    assert exact_dedup.fingerprints(data, piece=1000) == exact_dedup.fingerprints(data)


def test_ids_beyond_sixteen_bits_raise(tmp_path):
    path = tmp_path / "wide.tiktoken"
    path.write_text("YQ== 0\nYg== 65536\n")
    with pytest.raises(ValueError):
        packing.PieceEncoder(str(path), ".")
