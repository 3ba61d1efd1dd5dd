"""Near-duplicates by fast similarity sketching.

A sketch has ``t`` coordinates, filled in rounds. In each of the first ``t`` rounds every element of the set is hashed to a
bin and a value, and a bin that is still empty takes its smallest value; round ``t + i`` throws all elements into bin i. So every
coordinate is filled after at most ``2 * t`` rounds, a set with many elements needs only a few of them, and the share of
coordinates in which two sketches agree is as concentrated around the sets' similarity as that of ``t`` independent
minimum hashes, or better. Unfilled texts of a batch go through a round together.

Bands of coordinates are the blocks in which texts meet. Within a block the lowest bits of the coordinates are compared
by bit planes, which only picks candidates: links are confirmed on the full sets of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.bloom import passing
from waraq.llm.components import connected_components, join_groups
from waraq.llm.simhash import links_in_blocks, links_of_sets
from waraq.llm.textops import by_bytes, splitmix, utf8_of
from waraq.llm.words import SOLID_BYTES, word_hashes
from waraq.runtime import bound_batches, materialize

WORDS, PERCENT = 3, 85
#: Coordinates of a sketch; the first ``BANDS * ROWS_PER_BAND`` make up the bands, the lowest bits of all the fingerprint.
COORDINATES, BANDS, ROWS_PER_BAND = 128, 24, 4
LANES = COORDINATES // 64
#: Fingerprints of candidates differ in this many bits at most; at 0.85 about 10 of 128 do, with a deviation of 3.
CANDIDATE_BITS = 32
BATCH_ROWS = 2048

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_PLACE = splitmix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one after the other, and the texts' offsets into them.

    ``data`` is the UTF-8 of all texts. A text of fewer words has one shingle of them all; one without words has none."""
    hashes, _, at = word_hashes(_LOWER[data], offsets, SOLID_BYTES)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    ends = np.cumsum(count)
    row = np.repeat(np.arange(len(n)), count)
    first = np.repeat(at[:-1], count) + np.arange(len(row)) - np.repeat(ends - count, count)
    shingle = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            there = k < n[row]
            shingle[there] += splitmix(hashes[first[there] + k] + np.uint64(k + 1)) * _PLACE[k]
    shingle = splitmix(shingle)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    return shingle, np.searchsorted(row, np.arange(len(n) + 1))


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """(sets, t) sketches of sets of 64-bit hashes; rows of empty sets are all ones."""
    sizes = np.diff(offsets)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sizes), t), empty)
    live = np.flatnonzero(sizes)
    x, row = elements, np.repeat(np.arange(len(sizes)), sizes)
    for step in range(2 * t):
        if not len(live):
            break
        h = splitmix(x ^ splitmix(np.array([step + 1], np.uint64)))
        if step < t:
            bin_ = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            bin_ = np.full(len(x), step - t)
        found = np.full((len(live), t), empty)
        np.minimum.at(found.reshape(-1), np.searchsorted(live, row) * t + bin_, splitmix(h))
        own = out[live]
        out[live] = np.where(own == empty, found, own)
        left = (out[live] == empty).any(1)
        if not left.all():
            live = live[left]
            open_ = np.zeros(len(sizes), bool)
            open_[live] = True
            stay = open_[row]
            x, row = x[stay], row[stay]
    return out


def _fold(parts: np.ndarray) -> np.ndarray:
    """One hash of each row's coordinates."""
    key = np.zeros(len(parts), np.uint64)
    for k in range(parts.shape[1]):
        key = splitmix(key ^ parts[:, k])
    return key


def _set_keys(elements: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set's elements, which together stand for the set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (7, 8):
            sums = np.r_[np.uint64(0), np.cumsum(splitmix(elements ^ splitmix(np.array([salt], np.uint64))), dtype=np.uint64)]
            out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about a megabyte of text and at most ``BATCH_ROWS`` texts."""
    for batch in by_bytes(batches, 2, 1 << 20):
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _sketch_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            elements, offsets = shingle_sets(*utf8_of(batch.column(2)), words)
            sketch = sketches(elements, offsets)
            low = np.packbits((sketch & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
            bands = [_fold(sketch[:, b * ROWS_PER_BAND : (b + 1) * ROWS_PER_BAND] + np.uint64(b)).view(np.int64) for b in range(BANDS)]
            columns = [*_set_keys(elements, offsets), np.diff(offsets), *(low[:, k].copy() for k in range(LANES)), *bands]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], _SKETCH)

    return run


_PRINTS = [f"f{k}" for k in range(LANES)]
_BAND_COLUMNS = [f"b{k}" for k in range(BANDS)]
_SKETCH = ["doc_id", "text_hash", "set_a", "set_b", "n_shingles", *_PRINTS, *_BAND_COLUMNS]


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            elements, offsets = shingle_sets(*utf8_of(batch.column(2)), words)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["block", "node", "shingles"])

    return run


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by the similarity of their sets of ``words``-word shingles.

    Two documents are linked where 100 * (shingles in common) >= ``percent`` * (shingles of either). Returns doc_id,
    n_shingles, component_id (smallest doc_id reachable, itself included), kept (whether it is that one), one row per
    row of ``docs``. A-Z count as a-z; words are runs of anything but ASCII white space.

    Texts meet in ``BANDS`` bands of ``ROWS_PER_BAND`` coordinates: at 0.85 a pair is in none with probability
    (1 - 0.85**4)**24 = 2e-8. Equal sets (by two 64-bit sums and their size) are one node, so exact copies, however many, are
    compared once. Fewer words than ``words``: one shingle. Null text, empty text or no words: no shingle, linked with nothing.
    Null ids: sort last; component_id is null only where no linked row has an id. Repeated rows: repeated in the result.
    Very long texts are compared whole. Empty table: no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    numbers = ", ".join(f"{c} long" for c in _SKETCH[1:])
    sketch = materialize(source.mapInArrow(_sketch_rows(words), f"doc_id {kind}, {numbers}"), "sketches")
    keys = ["set_a", "set_b", "n_shingles"]
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
    firsts = [F.first(c).alias(c) for c in (*_PRINTS, *_BAND_COLUMNS)]
    nodes = sketch.filter("n_shingles > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), one, *firsts)
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    size = nodes.count()
    blocks = nodes.select(F.explode(F.array(*_BAND_COLUMNS)).alias("block"), "node", *_PRINTS)
    candidates = connected_components(links_in_blocks(blocks, LANES, CANDIDATE_BITS, bound=BANDS * size, screen=True)).select("node", F.col("root").alias("block")).distinct()
    chosen = nodes.join(candidates, "node").select(F.col("one.doc_id").alias("c_id"), F.col("one.text_hash").alias("c_hash"), "node", "block")
    chosen = materialize(chosen, "candidates", rows=size)
    likely = passing(source, "text_hash", chosen, "c_hash")
    texts = likely.join(chosen, (likely["text_hash"] == chosen["c_hash"]) & likely["doc_id"].eqNullSafe(chosen["c_id"])).select("block", "node", "text")
    sets = materialize(texts.mapInArrow(_set_rows(words), "block long, node long, shingles array<long>"), "shingle-sets")
    if sets.count() != chosen.count():  # rows that repeat an id and a text
        sets = materialize(sets.dropDuplicates(["node"]), "shingle-sets")
    roots = connected_components(links_of_sets(sets, percent / 100, bound=size))
    rooted = nodes.join(roots, "node", "left").select(*keys, "rows", F.col("one.doc_id").alias("low_id"), F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted", rows=size)
    lows = materialize(rooted.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "lows", rows=size)
    total = rooted.agg(F.count(F.lit(1)), F.sum("rows")).first()
    named = materialize(join_groups(rooted, lows, ["root"], "nodes", total[0]).select(*keys, "component_id", "rows"), "named", rows=size)
    linked = join_groups(sketch.select("doc_id", *keys).filter("n_shingles > 0"), named, keys, "rows", total[1] or 0).select("doc_id", "n_shingles", "component_id")
    alone = sketch.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
