"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a short run of words and ignores the others, so a substituted word at an ignored position
does not hide a shared run. The hashes of all masked runs of the benchmark are joined with those of the documents, and
every hit is verified by counting equal words along its alignment, over the item's whole length.

The documents' hashes are first held against a Bloom filter of the benchmark's (its size is fixed, whatever the
benchmark's; where it fills up, more rows reach the join and none is lost). Only runs that pass are shuffled, with as
many words around them as the longest item has, so that every alignment is seen from its first word to its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.bloom import bloom_of, may_hold
from waraq.llm.textops import by_bytes, splitmix, utf8_of
from waraq.llm.words import word_hashes
from waraq.runtime import bound_batches, free_name, materialize

#: With these, a run of 13 words with any two of them substituted still has a hit.
MASKS = ("10110111", "1101100101", "1010010111", "1010110011")
WINDOW, MATCHES, SHORTEST = 13, 11, 5
#: Up to this many seeds are broadcast (24 bytes each); more are joined by an exchange, dealt over SALT parts.
BROADCAST_SEEDS, SALT = 1_000_000, 16


def _words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, in lower case) of all texts, and the rows' offsets."""
    data, offsets = utf8_of(pc.utf8_lower(pc.fill_null(array, "")))
    hashes, _, at = word_hashes(data, offsets)
    return hashes, at


def seed_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the kept words at each place where the mask fits."""
    n = max(0, len(words) - len(mask) + 1)
    h = np.full(n, np.uint64(salt))
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                h = (h ^ words[k : n + k]) * np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(29)
    return splitmix(h)


def _bench_rows(masks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            words, at = _words(batch.column(1))
            items, places, hashes, spans = [], [], [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = words[at[i] : at[i + 1]]
                whole = ("1" * len(own),) if SHORTEST <= len(own) < WINDOW else ()
                for mask in masks if len(own) >= WINDOW else whole:
                    h = seed_hashes(own, mask, len(mask) * 1000 + int(mask, 2))
                    items += [item] * len(h)
                    places += range(len(h))
                    hashes += h.view(np.int64).tolist()
                    spans += [len(own) if whole else 0] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(places, pa.int64()), pa.array(hashes, pa.int64()), pa.array(spans, pa.int64())], ["item", "place", "h", "whole"])

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1):
        words, at = _words(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["item", "item_id", "item_words"])


def _regions(masks: tuple[str, ...], seen: np.ndarray, context: int):
    """For each document, the stretches of words up to ``context`` words around seeds that are in the filter ``seen``."""
    full = [(m, len(m) * 1000 + int(m, 2)) for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, 4 << 20):
            words, at = _words(batch.column(2))
            places, hashes, spans = [], [], []
            for mask, salt in full:
                h = seed_hashes(words, mask, salt)
                hit = may_hold(seen, h)
                places.append(hit)
                hashes.append(h[hit])
                spans.append(np.full(len(hit), len(mask)))
            place, h, span = np.concatenate(places), np.concatenate(hashes), np.concatenate(spans)
            row = np.searchsorted(at, place, side="right") - 1
            inside = place + span <= at[row + 1]
            order = np.lexsort((place[inside], row[inside]))
            place, h, row = place[inside][order], h[inside][order], row[inside][order]
            cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] - place[:-1] > 2 * context)]) if len(place) else np.zeros(0, np.int64)
            rows, starts, bodies, all_h, all_p = [], [], [], [], []
            for a, b in zip(cuts, np.r_[cuts[1:], len(place)]):
                lo, hi = max(at[row[a]], place[a] - context), min(at[row[a] + 1], place[b - 1] + context)
                rows.append(row[a])
                starts.append(int(lo - at[row[a]]))
                bodies.append(words[lo:hi].tobytes())
                all_h.append(h[a:b].view(np.int64).tolist())
                all_p.append((place[a:b] - lo).tolist())
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(starts, pa.int64()), pa.array(bodies, pa.binary()), pa.array(all_h, pa.list_(pa.int64())), pa.array(all_p, pa.list_(pa.int64()))],
                ["doc_id", "row_hash", "start", "body", "hashes", "places"],
            )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep alignments with ``MATCHES`` equal words in some ``WINDOW`` consecutive ones (all of a shorter item's).

    first is the place of the alignment's first word that is in the document, equal the equal words of all of it."""
    for batch in batches:
        keep, first, equal, best = [], [], [], []
        for i, (start, body, item, shift) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)))):
            region, own = np.frombuffer(body, np.uint64), np.frombuffer(item, np.uint64)
            lo, hi = max(0, -shift), min(len(own), len(region) - shift)
            if hi <= lo:
                continue
            same = own[lo:hi] == region[lo + shift : hi + shift]
            width = min(WINDOW, len(own))
            if len(same) < width:
                continue
            runs = np.convolve(same, np.ones(width, np.int64), "valid")
            if runs.max() >= (MATCHES if width == WINDOW else width):
                keep.append(i)
                first.append(start + lo + shift)
                equal.append(int(same.sum()))
                best.append(int(runs.max()))
        pick = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pick) for c in range(3)), pa.array(first, pa.int64()), pa.array(equal, pa.int64()), pa.array(best, pa.int64())],
            ["doc_id", "row_hash", "item_id", "first_word", "equal_words", "best_window"],
        )


def _meet(rows: DataFrame, table: DataFrame, key: str, small: bool) -> DataFrame:
    """Inner join on ``key``, of which some value may stand in very many ``rows``: with a small table by broadcast, else
    dealt over copies of the table."""
    if small:
        return rows.join(F.broadcast(table), key)
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("part", F.pmod("region", F.lit(SALT)).cast("int")).join(copies, [key, "part"]).drop("part")


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, row_hash, item_id, first_word, equal_words, best_window: one row per verified alignment."""
    bound_batches(docs.sparkSession)
    keyed = materialize(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "benchmark")  # written, so that a row has the same key wherever it is read
    item_kind, kind = (df.schema[c].dataType.simpleString() for df, c in ((keyed, "item_id"), (docs, "doc_id")))
    items = materialize(keyed.select("item", "text", "item_id").mapInArrow(_item_words, f"item long, item_id {item_kind}, item_words binary"), "item-words")
    longest, every = (x or 0 for x in items.agg(F.max(F.octet_length("item_words")), F.sum(F.octet_length("item_words") + 32)).first())
    seeds = materialize(keyed.select("item", "text").mapInArrow(_bench_rows(MASKS), "item long, place long, h long, whole long"), "seeds")
    short = tuple("1" * r["whole"] for r in seeds.filter("whole > 0").select("whole").distinct().collect())  # at most 8 lengths
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    regions = rows.mapInArrow(_regions(MASKS + short, bloom_of(seeds, "h"), longest // 8), f"doc_id {kind}, row_hash long, start long, body binary, hashes array<long>, places array<long>")
    regions = materialize(regions.withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("region", F.col("x.hashes").alias("h"), F.col("x.places").alias("at"))
    met = _meet(hits, seeds, "h", seeds.count() <= broadcast_seeds)
    found = met.select("region", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    near = _meet(found.join(regions.select("region", "doc_id", "row_hash", "start", "body"), "region"), items, "item", every <= 24 * broadcast_seeds)
    ready = near.select("doc_id", "row_hash", "item_id", "start", "body", "item_words", "shift")
    return ready.mapInArrow(_verify, f"doc_id {kind}, row_hash long, item_id {item_kind}, first_word long, equal_words long, best_window long")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: doc_id, item_id, first_word, equal_words.

    A pair is reported if some 13 consecutive words of the item (letters and digits, case ignored) stand in the document
    with at least 11 of them equal, place by place; an item of 5 to 12 words must stand there unchanged; shorter items
    are not told from chance and never match. first_word is the item's place in the document (words before the first one
    that is in it), equal_words the equal words of that alignment over the item's whole length; of several alignments the one with the most equal words, then the first, counts.
    Null and empty texts and items: no pairs. Null ids of documents and items: reported as null. item_id keeps its type. Repeated rows: one pair. Empty tables: no rows.
    """
    best = F.max_by(F.struct("first_word", "equal_words"), F.struct("equal_words", -F.col("first_word"))).alias("b")
    return overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.first_word", "b.equal_words")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns stay.

    Null and empty texts stay. Null ids: rows go or stay by their texts. Repeated rows go or stay together, ties do not
    arise. Empty tables: nothing goes.
    """
    bad = materialize(overlaps(docs, benchmark).select(F.col("doc_id").alias("b_id"), F.col("row_hash").alias("b_hash")).distinct(), "contaminated")
    h = free_name(docs, "row_hash")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    return hashed.join(bad, hashed["doc_id"].eqNullSafe(bad["b_id"]) & (hashed[h] == bad["b_hash"]), "left_anti").drop(h)
