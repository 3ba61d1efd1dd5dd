"""Sharding by histogram sort.

Rows are ordered by a 62-bit key: 40 bits of the text's hash, then 22 bits of the id's hash. Equal texts are neighbours
in that order, and a group of copies of any size can still be cut between two ids. Probe boundaries are counted exactly
(bytes below each) in rounds; each round refines only the intervals that hold a splitter that has not met its
tolerance. The driver sees ``probes`` sums per open splitter, never rows. Then one exchange deals the rows out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waraq.runtime import materialize

KEY_BITS, ID_BITS = 62, 22


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 and the sort key."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - (KEY_BITS - ID_BITS)), ID_BITS)
    low = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ID_BITS)
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), (high + low).alias("key"))


def _counts_between(bounds: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_in = np.zeros(len(bounds) + 1, np.int64)
        rows_in = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(bytes_in, at, batch.column(1).to_numpy(zero_copy_only=False))
            rows_in += np.bincount(at, minlength=len(rows_in))
        full = np.flatnonzero(rows_in)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(bytes_in[full]), pa.array(rows_in[full])], ["slot", "bytes", "n"])

    return count


def _count(keyed: DataFrame, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each boundary, and in all."""
    edges = np.array(bounds, np.int64)
    sums = keyed.select("key", "size").mapInArrow(_counts_between(edges), "slot long, bytes long, n long").groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    below, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in sums.collect():
        below[r["slot"]], rows[r["slot"]] = r["bytes"], r["n"]
    return below.cumsum(), rows.cumsum()


def find_splitters(keyed: DataFrame, parts: int, tolerance: float = 0.002, probes: int = 64, grain: int = 1) -> list[int]:
    """``parts - 1`` ascending keys such that the bytes below the i-th are within ``tolerance`` of a part of i parts.

    Boundaries between texts (multiples of 2**22) are tried first, so a group of copies is cut only where no boundary
    between texts meets the tolerance. Where none at all does (rows larger than the tolerance, repeated rows), the
    nearest is taken. ``grain``: every grain-th splitter gets the tolerance, the others 25 times as much.
    """
    top = 1 << KEY_BITS
    total = int(_count(keyed, [])[0][-1])
    want = [total * i // parts for i in range(1, parts)]
    slack = [total / parts * grain * tolerance * (1 if i % grain == 0 else 25) for i in range(1, parts)]
    low, high = [0] * (parts - 1), [top] * (parts - 1)
    known: dict[int, int] = {0: 0, top: total}
    chosen: list[int | None] = [None] * (parts - 1)
    while True:
        for i, goal in enumerate(want):
            if chosen[i] is None:
                best = min((low[i], high[i]), key=lambda k: abs(known[k] - goal))
                if abs(known[best] - goal) <= slack[i] or high[i] - low[i] <= 1:
                    chosen[i] = best
        spans = {(low[i], high[i]) for i in range(parts - 1) if chosen[i] is None}
        if not spans:
            return sorted(int(c) for c in chosen)
        bounds = set()
        for lo, hi in spans:
            step = max(1, -(-(hi - lo) // (probes + 1)))
            unit = 1 << ID_BITS
            if hi // unit > -(-(lo + 1) // unit):  # a boundary between texts lies inside
                step = max(unit, step // unit * unit)
                first = (lo // unit + 1) * unit
            else:
                first = lo + step
            bounds.update(range(first, hi, step))
        order = sorted(bounds)
        below, _ = _count(keyed, order)
        known.update(zip(order, (int(b) for b in below[: len(order)])))
        for i, goal in enumerate(want):
            if chosen[i] is None:
                inside = [low[i], *order[bisect_right(order, low[i]) : bisect_left(order, high[i])], high[i]]
                at = max(k for k, b in enumerate(inside) if k == 0 or known[b] <= goal)
                at = min(at, len(inside) - 2)
                low[i], high[i] = inside[at], inside[at + 1]


def shard(docs: DataFrame, shards: int = 8, parts_per_shard: int = 8, rows_per_part: int = 2_000_000, tolerance: float = 0.002) -> DataFrame:
    """Deal ``docs`` into shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``; grown_shard is null, as it belongs to another law. ``slot`` is gapless from 0 in each shard
    and ascends with the sort key over the shard's parts. Parts exist so that no task sorts a whole shard: there are
    ``parts_per_shard``, or more where those would hold over about ``rows_per_part`` rows each.
    Null text: size 1, crc of no bytes. Null ids, ties and repeated rows: ordinary rows; rows equal in id and text
    cannot be told apart by the key and stay in one shard. Empty table: no rows. Extra columns are not read.
    """
    keyed = materialize(keyed_rows(docs), "shard-keys")
    parts_per_shard = max(parts_per_shard, -(-keyed.count() // (shards * rows_per_part)))
    parts = shards * parts_per_shard
    edges = find_splitters(keyed, parts, tolerance, grain=parts_per_shard)
    _, rows_below = _count(keyed, edges)
    first_row = [0, *(int(n) for n in rows_below)][: parts]
    base = np.array([first_row[p] - first_row[p - p % parts_per_shard] for p in range(parts)], np.int64)
    bounds = np.array(edges, np.int64)

    @F.pandas_udf("part int, offset long")
    def part_of(key):
        at = np.searchsorted(bounds, key.to_numpy(), side="right")
        return pd.DataFrame({"part": at.astype("int32"), "offset": base[at]})

    part = keyed.withColumn("at", part_of("key")).select("doc_id", "size", "text_crc32", "key", "at.part", "at.offset")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32")) - 1
    return part.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        (F.col("part") / parts_per_shard).cast("int").alias("shard"),
        (rank + F.col("offset")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
