"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a block are stored as vertical bit planes: plane b holds bit b of 64 rows per machine word. All rows of
the block are compared with all planes at once; carry-save counters, one word per 64 distances and counter bit, take up
each plane's differences. A counter that runs over marks a pair as beyond the radius, and a query row leaves the
comparison as soon as all its pairs are. Blocks only ever yield the edges of a spanning star per linked group.

Two ways to form blocks:

* ``exact_blocks``: a fingerprint is cut into radius + 2 fields; two within the radius agree in at least two of them,
  so a block for each pair of fields loses no link. Used where the radius is small (the 64-bit contract query).
* ``shingle_blocks``: for radii at which no pigeonhole prunes, rows meet in blocks keyed by bands of minimum shingle
  hashes. Used for whole-document near copies (five-word shingles, 256-bit fingerprints), where fingerprints only pick
  candidates: a link is kept if the shingle sets themselves are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.llm.bloom import passing
from waraq.llm.components import connected_components, join_groups
from waraq.llm.textops import by_bytes, splitmix, texts_of
from waraq.runtime import bound_batches, free_name, materialize

SEED = 42
TILE = 2048
#: Blocks of more than this share of all rows meet their sizes by broadcast.
HOT_SHARE = 10_000
#: Rows of a large block that meet its pivot in one part.
PART = 4096
#: Rows of a part when shingle sets are compared.
SET_TILE = 512


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, A-Z in lower case; fewer words: of the whole sequence."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.array([len(w) + 1 for w in found])) - 1
    k = min(words, len(found))
    starts = [0, *(ends[:-k] + 1).tolist()] if k < len(found) else [0]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def bit_majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is 1 if set in over half the hashes. Lane i > 0 mixes the hash i times again."""
    out = np.zeros(lanes, np.uint64)
    h = hashes
    for lane in range(lanes):
        if lane:
            h = splitmix(h)
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 255 * 64):
            bits = np.unpackbits(h[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            if whole:
                total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            total += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
        out[lane] = np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0] if len(h) else 0
    return out


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(rows, lanes) uint64 to (64 * lanes, rows / 64) uint64: plane b holds bit b of every row."""
    rows, lanes = prints.shape
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(rows, lanes * 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((64 * lanes, -(-rows // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def linked_pairs(left: np.ndarray, right: np.ndarray, radius: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right) within ``radius`` bits, where bit j of allowed[i] is set (packed words)."""
    planes = planes_of(right)
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius  # a counter that takes radius + 1 differences runs over
    active = np.flatnonzero(allowed.any(axis=1))
    beyond = ~allowed[active]
    counters = [np.full(beyond.shape, np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(width)]
    query = left[active]
    for b in range(len(planes)):
        bit = (query[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        carry = planes[b][None, :] ^ (np.uint64(0) - bit)[:, None]
        for c in counters:
            carry_on = c & carry
            c ^= carry
            carry = carry_on
        beyond |= carry
        if b % 8 == 7:
            alive = (beyond != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
            if not alive.all():
                active, query, beyond = active[alive], query[alive], beyond[alive]
                counters = [c[alive] for c in counters]
                if not len(active):
                    break
    near = np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")[:, : len(right)]
    i, j = np.nonzero(near)
    return active[i], j


def _allowed(group_left: np.ndarray, group_right: np.ndarray, upper: bool) -> np.ndarray:
    """Packed words: bit j of row i is set where both rows belong to one block (and i < j, if ``upper``)."""
    same = group_left[:, None] == group_right[None, :]
    if upper:
        same &= np.arange(len(group_left))[:, None] < np.arange(len(group_right))[None, :]
    packed = np.packbits(same, axis=1, bitorder="little")
    out = np.zeros((len(group_left), -(-len(group_right) // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _stars(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node of its group, node) that join the same nodes as the pairs do."""
    label = np.arange(len(nodes))
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _compare_sorted(lanes: int, radius: int):
    """Over rows (block columns, side, node, fp...) sorted by block: gather about a tile of whole blocks, compare, emit stars."""

    def compare(block: np.ndarray, side: np.ndarray, node: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if side.any():  # a tile off the diagonal of a large block: rows of one part against rows of the other
            lo, hi = np.flatnonzero(side != 2), np.flatnonzero(side == 2)
            i, j = linked_pairs(prints[lo], prints[hi], radius, _allowed(block[lo], block[hi], False))
            return _stars(node, lo[i], hi[j])
        i, j = linked_pairs(prints, prints, radius, _allowed(block, block, True))
        return _stars(node, i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``rows``: whole blocks, as (block, side, node, fp...) int64."""
            cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            sizes = np.diff(np.r_[cuts, len(rows)])
            group = np.repeat(np.arange(len(cuts)), sizes)
            tiled = np.repeat(np.maximum.reduceat(rows[:, 1], cuts) > 0, sizes)
            plain = np.flatnonzero(~tiled & np.repeat(sizes > 1, sizes))
            jobs = []
            at = 0
            while at < len(plain):  # whole small blocks together, about 512 rows at a time
                end = min(at + 512, len(plain))
                while end < len(plain) and group[plain[end]] == group[plain[end - 1]]:
                    end += 1
                jobs.append(plain[at:end])
                at = end
            jobs += [np.flatnonzero(group == g) for g in np.unique(group[tiled])]
            us, vs = [], []
            for pick in jobs:
                part = rows[pick]
                u, v = compare(group[pick], part[:, 1], part[:, 2], part[:, 3:].view(np.uint64))
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3 + lanes)]) if batch.num_rows else np.zeros((0, 3 + lanes), np.int64)
            held.append(rows)
            if sum(map(len, held)) >= 2 * TILE:
                rows = np.concatenate(held)
                last = np.flatnonzero(rows[:, 0] != rows[-1, 0])
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield from flush(rows[:cut])
                held = [rows[cut:]]
        rows = np.concatenate(held) if held else np.zeros((0, 3 + lanes), np.int64)
        if len(rows):
            yield from flush(rows)

    return run


def _tiles(left: DataFrame, right: DataFrame, prints: list[str], tile: int, salt: int) -> DataFrame:
    """All pairs of ``left`` with ``right`` rows of a block as blocks of their own of two parts of about ``tile`` rows.

    Both have block, node, n_left, n_right (the block's rows on either side) and the fingerprint.
    """
    parts = lambda side: F.greatest(F.lit(1), F.ceil(F.col(f"n_{side}") / tile)).cast("int")
    own = lambda side: F.pmod(F.xxhash64("node"), parts(side)).cast("int")
    others = lambda side: F.explode(F.sequence(F.lit(0), parts(side) - 1))
    made = lambda df, p, q, side: df.withColumns({"_p": p, "_q": q}).select(F.xxhash64(F.lit(salt), "block", "_p", "_q").alias("block"), F.lit(side).cast("long").alias("side"), "node", *prints)
    return made(left, own("left"), others("right"), 1).unionByName(made(right, others("left"), own("right"), 2))


def _bits_apart(prints: list[str]) -> Column:
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p.{c}"))) for c in prints), F.lit(0))


def _sets_apart(sets: list[str]) -> Column:
    """1 less the share of their union that two sets have in common; a metric, like the bits apart."""
    a, b = F.col(sets[0]), F.col(f"p.{sets[0]}")
    common = F.size(F.array_intersect(a, b))
    return 1 - common / (F.size(a) + F.size(b) - common)


def _dealt(groups: DataFrame) -> DataFrame:
    """One row of ``groups`` (block, n) for each part of its block."""
    return groups.withColumn("part", F.explode(F.sequence(F.lit(0), _parts_of("n") - 1)))


def _parts_of(size: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(size) / PART)).cast("int")


def _split_large(large: DataFrame, prints: list[str], radius: float, tile: int, rounds: int, distance=_bits_apart) -> tuple[list[DataFrame], list[DataFrame]]:
    """Blocks of more than ``tile`` rows: (edges, smaller blocks) that hold all their links. ``large``: block, n (rows of
    the block), node and the fingerprint.

    Each round takes one row of a block as its pivot. Rows within the radius of it are linked to it, so pairs among them
    need no comparison. By the triangle inequality only rows within twice the radius can be linked to those; they are
    compared in tiles. All rows beyond the radius go on to the next round. So a block of near copies costs one distance
    a row; what is left after all rounds is compared pair of parts by pair of parts.

    A block's rows meet its pivot in parts of about ``PART`` rows, each with a copy of the pivot, so no key is hot and
    nothing is broadcast, however long a pivot is.
    """
    edges, blocks = [], []
    rest = materialize(large.select("block", "n", "node", *prints), "large-blocks")
    for k in range(rounds):
        pivots = _dealt(rest.groupBy("block").agg(F.min(F.struct("node", *prints)).alias("p"), F.max("n").alias("n"))).drop("n")
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("node"), _parts_of("n")).cast("int"))
        near = dealt.join(pivots, ["block", "part"]).select("block", "part", "n", "node", *prints, F.col("p.node").alias("pivot"), distance(prints).alias("apart"))
        near = materialize(near, "pivots")
        edges.append(near.filter((F.col("apart") <= radius) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("u"), F.col("node").alias("v")))
        on_border = (F.col("apart") > radius) & (F.col("apart") <= 2 * radius)
        counts = near.groupBy("block").agg(F.count_if(F.col("apart") <= radius).alias("n_left"), F.count_if(on_border).alias("n_right"), F.count_if(F.col("apart") > radius).alias("left"), F.max("n").alias("n"))
        counts = materialize(counts.filter("left > 0"), "pivot-counts", rows=HOT_SHARE * PART)
        if counts.isEmpty():
            return edges, blocks
        known = near.drop("n").join(_dealt(counts).drop("n"), ["block", "part"])
        border = known.filter("n_right > 0")
        blocks.append(_tiles(border.filter(F.col("apart") <= radius), border.filter(on_border), prints, tile, k))
        beyond = known.filter(F.col("apart") > radius)
        blocks.append(beyond.filter(F.col("left") <= tile).select(F.xxhash64(F.lit(-1 - k), "block").alias("block"), F.lit(0).cast("long").alias("side"), "node", *prints))
        rest = materialize(beyond.filter(F.col("left") > tile).select("block", F.col("left").alias("n"), "node", *prints), "large-blocks")
        if rest.isEmpty():
            return edges, blocks
    parts = F.ceil(F.col("n") / tile).cast("int")
    split = rest.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, F.lit(0)).when(F.col("own") == low, F.lit(1)).otherwise(F.lit(2)).cast("long")
    blocks.append(split.select(F.xxhash64("block", low, high).alias("block"), side.alias("side"), "node", *prints))
    return edges, blocks


def _by_size(rows: DataFrame, tile: int, bound: int | None, screen: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(rows of blocks of 2 to ``tile`` rows, rows of larger ones or None where there is none), each with n, the block's rows.

    Blocks of more than a ``HOT_SHARE``-th of all rows are fewer than that by arithmetic; they are broadcast, so that
    their rows are exchanged with nothing. All others are exchanged by block, and none of them is hot. ``bound``: at
    least the number of rows, where known. ``screen``: most rows are alone in their block, and a filter of fixed size leaves
    them out before the exchange.
    """
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialize(sizes, "block-sizes", rows=bound and bound // 2)
    rows = passing(rows, "block", sizes, "block") if screen else rows
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (most or 0) <= tile:
        return rows.join(sizes, "block"), None
    hot_at = max(tile, total // HOT_SHARE)
    hot = F.broadcast(sizes.filter(F.col("n") > hot_at))
    others = rows.join(hot, "block", "left_anti").join(sizes.filter(F.col("n") <= hot_at), "block")
    return others.filter(F.col("n") <= tile), rows.join(hot, "block").unionByName(others.filter(F.col("n") > tile))


def links_in_blocks(rows: DataFrame, lanes: int, radius: int, tile: int = TILE, rounds: int = 4, bound: int | None = None, screen: bool = False) -> DataFrame:
    """``rows``: block long, node long, f0.. long, at most one row per block and node. Returns edges u, v, which join
    the same nodes as all links within the blocks do.

    Blocks of one row are dropped. Blocks of more than ``tile`` rows are split first (see :func:`_split_large`), so no
    task holds or compares more than two parts at once and a group of near copies of any size costs work in proportion.
    """
    prints = [f"f{k}" for k in range(lanes)]
    small, large = _by_size(rows, tile, bound, screen)
    edges, blocks = _split_large(large, prints, radius, tile, rounds) if large is not None else ([], [])
    every = small.select("block", F.lit(0).cast("long").alias("side"), "node", *prints)
    for more in blocks:
        every = every.unionByName(more)
    found = every.repartition("block").sortWithinPartitions("block").mapInArrow(_compare_sorted(lanes, radius), "u long, v long")
    for more in edges:
        found = found.unionByName(more)
    return found.distinct()


def exact_blocks(prints: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """``prints``: distinct f0. One row per pair of fields; two fingerprints within the radius share at least one block."""
    fields = radius + 2
    edges = [bits * k // fields for k in range(fields + 1)]

    def field(k: int):
        return F.shiftrightunsigned("f0", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))

    keys = F.array(*[F.xxhash64(F.lit(a * fields + b), field(a), field(b)) for a, b in combinations(range(fields), 2)])
    return prints.select(F.explode(keys).alias("block"), F.col("f0").alias("node"), "f0")


def _print_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            out = [int(bit_majority(shingle_hashes(t, words)).view(np.int64)[0]) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "f0"])

    return run


def fingerprint_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """64-bit fingerprints of whole texts and the components of fingerprints linked at ``radius`` or fewer bits.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per row of ``docs``.
    No link is lost: the blocks are exact. Null and empty texts: fingerprint zero, linked like any other. Equal
    fingerprints are one node. Null ids: a row of their own, component_id null only where no linked row has an id.
    Repeated rows: repeated in the result. Empty table: no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_print_rows(words), f"doc_id {kind}, f0 long"), "simhash")
    nodes = materialize(rows.groupBy("f0").agg(F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("rows")), "prints")
    size = nodes.count()
    edges = links_in_blocks(exact_blocks(nodes.select("f0"), radius), 1, radius, bound=(radius + 2) * (radius + 1) // 2 * size)
    roots = connected_components(edges)
    rooted = nodes.join(roots, nodes["f0"] == roots["node"], "left").select("f0", "low_id", "rows", F.coalesce("root", "f0").alias("root"))
    rooted = materialize(rooted, "rooted", rows=size)
    lows = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    lows = materialize(lows, "lows", rows=size)
    total = rooted.agg(F.count(F.lit(1)), F.sum("rows")).first()
    named = materialize(join_groups(rooted, lows, ["root"], "nodes", total[0]).select("f0", "component_id", "rows"), "named", rows=size)
    named = join_groups(rows, named, ["f0"], "rows", total[1] or 0)
    return named.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# Whole-document near copies


def _sketch_rows(words: int, lanes: int, bands: int, rows_per_band: int):
    n = bands * rows_per_band
    multipliers = splitmix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    band_of = np.repeat(np.arange(bands), rows_per_band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            prints, keys = [], []
            for t in texts_of(batch.column(2)):
                h = shingle_hashes(t, words)
                u = np.unique(h)
                prints.append(bit_majority(u, lanes).view(np.int64))
                if not len(h):
                    keys.append([])
                    continue
                low = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
                with np.errstate(over="ignore"):
                    for at in range(0, len(u), 4096):
                        x = u[at : at + 4096]
                        for k in range(n):
                            low[k] = min(low[k], ((x ^ (x >> np.uint64(29))) * multipliers[k]).min())
                key = np.zeros(bands, np.uint64)
                for k in range(n):
                    key[band_of[k]] = splitmix(key[band_of[k] : band_of[k] + 1] ^ low[k : k + 1])[0]
                keys.append(splitmix(key ^ np.arange(bands, dtype=np.uint64)).view(np.int64).tolist())
            lanes_out = np.array(prints, np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(lanes_out[:, k].copy()) for k in range(lanes)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "node", *(f"f{k}" for k in range(lanes)), "blocks"],
            )

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts_of(batch.column(2))]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], ["block", "node", "shingles"])

    return run


def linked_sets(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """A label for each set, equal where links join them; sets of side 1 are compared with those of side 2 only.

    Sets already joined are not compared again, so a group of near copies costs one pass a set.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    label, mark = np.arange(len(sets)), np.zeros(len(values), bool)
    tiled = bool(side.any())
    for i in range(len(sets)):
        if tiled and side[i] == 2:
            continue
        open_ = (label != label[i]) & ((side == 2) if tiled else (np.arange(len(sets)) > i))
        if not open_.any():
            continue
        own = at[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        common = np.add.reduceat(mark[at], starts, dtype=np.int64)
        mark[own] = False
        hits = open_ & (common / (sizes + sizes[i] - common) >= similarity)
        if hits.any():
            label[np.isin(label, label[hits])] = label[i]
    return label


def _compare_sets(similarity: float):
    """Over rows (block, side, node, shingles) sorted by block: edges that join what the links in each block do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        block = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                side, node = np.array([x[0] for x in held]), np.array([x[1] for x in held], np.int64)
                label = linked_sets([x[2] for x in held], side, similarity)
                _, first, group = np.unique(label, return_index=True, return_inverse=True)
                moved = np.flatnonzero(first[group] != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[first[group[moved]]]), pa.array(node[moved])], ["u", "v"])
            held.clear()

        for batch in batches:
            sets = batch.column(3)
            ends = np.cumsum(np.asarray(pc.list_value_length(sets), dtype=np.int64))
            flat = sets.flatten().to_numpy(zero_copy_only=False)
            start = 0
            for b, s, n, end in zip(*(batch.column(c).to_pylist() for c in range(3)), ends.tolist()):
                if b != block:
                    yield from flush()
                    block = b
                held.append((s, n, flat[start:end]))
                start = end
        yield from flush()

    return run


def links_of_sets(rows: DataFrame, similarity: float, tile: int = SET_TILE, rounds: int = 4, bound: int | None = None) -> DataFrame:
    """``rows``: block long, node long, shingles array<long>. As :func:`links_in_blocks`, by the share of their union that two sets have in common."""
    small, large = _by_size(rows, tile, bound)
    edges, blocks = _split_large(large, ["shingles"], 1 - similarity + 1e-12, tile, rounds, _sets_apart) if large is not None else ([], [])
    every = small.select("block", F.lit(0).cast("long").alias("side"), "node", "shingles")
    for more in blocks:
        every = every.unionByName(more)
    found = every.repartition("block").sortWithinPartitions("block").mapInArrow(_compare_sets(similarity), "u long, v long")
    for more in edges:
        found = found.unionByName(more)
    return found.distinct()


def near_copies(docs: DataFrame, words: int = 5, bits: int = 256, similarity: float = 0.8, candidate_bits: int = 64, bands: int = 12, rows_per_band: int = 3) -> DataFrame:
    """Groups of near copies: doc_id, node (hash of the text), component_id, one row per row of ``docs``.

    Two texts are linked where their sets of ``words``-word shingles share at least ``similarity`` of their union.
    Candidates are texts that fingerprints of ``bits`` bits join at ``candidate_bits`` bits or fewer: at 0.8 about 39
    bits differ. They meet in bands of minimum shingle hashes, in some one with probability 1 - (1 - 0.8**3)**12 =
    0.9998. All pairs of a group of candidates are held to the similarity. component_id is the smallest doc_id of the group;
    null and empty texts are in no group. Texts equal to the byte share a node, so exact copies are in one group.

    Null ids: grouped by their text like any other; component_id is null only where no linked row has an id. Ties and
    repeated rows: a row each, with the component_id of their group. Very long texts are compared whole. Empty table: no
    rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    lanes = bits // 64
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = ", ".join(f"f{k} long" for k in range(lanes))
    source = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    sketch = materialize(source.mapInArrow(_sketch_rows(words, lanes, bands, rows_per_band), f"doc_id {kind}, node long, {prints}, blocks array<long>"), "sketches")
    size = sketch.count()
    nodes = sketch.select("node", *(f"f{k}" for k in range(lanes)), "blocks").dropDuplicates(["node"])
    blocks = nodes.select(F.explode("blocks").alias("block"), "node", *(f"f{k}" for k in range(lanes)))
    candidates = connected_components(links_in_blocks(blocks, lanes, candidate_bits, bound=bands * size)).select("node", F.col("root").alias("block")).distinct()
    # of copies to the byte the text with the smallest id is compared, so no node is hot
    chosen = sketch.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("c_id")).join(candidates, "node")
    chosen = materialize(chosen.select(F.col("node").alias("c_node"), "c_id", "block"), "candidates", rows=size)
    source = passing(source, "node", chosen, "c_node")
    texts = source.join(chosen, (source["node"] == chosen["c_node"]) & source["doc_id"].eqNullSafe(chosen["c_id"])).select("block", "node", "text")
    sets = materialize(texts.mapInArrow(_set_rows(words), "block long, node long, shingles array<long>"), "shingle-sets")
    roots = connected_components(links_of_sets(sets, similarity, bound=size))
    rows = sketch.groupBy("node").agg(F.min("doc_id").alias("low_id"), F.max(F.size("blocks")).alias("n_blocks"), F.count(F.lit(1)).alias("rows"))
    root = F.when(F.col("n_blocks") == 0, F.lit(None)).otherwise(F.coalesce("root", "node"))
    rooted = materialize(rows.join(roots, "node", "left").withColumn("root", root), "rooted", rows=size)
    lows = rooted.filter("root is not null").groupBy("root").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    lows = materialize(lows, "lows", rows=size)
    total = rooted.agg(F.count(F.lit(1)), F.sum("rows")).first()
    named = join_groups(rooted.filter("root is not null"), lows, ["root"], "nodes", total[0]).select("node", "component_id", "rows")
    named = named.unionByName(rooted.filter("root is null").select("node", F.lit(None).cast(kind).alias("component_id"), "rows"))
    return join_groups(sketch.select("doc_id", "node"), materialize(named, "named", rows=size), ["node"], "rows", total[1] or 0).select("doc_id", "node", "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest doc_id. All columns stay.

    Null and empty texts stay. Rows without an id go where their group has a row with one; where it has none, all stay.
    Rows that repeat an id and a text stay or go together. Very long texts are compared whole. Empty table: no rows.
    """
    groups = near_copies(docs, **options)
    gone = materialize(groups.filter("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("g_id"), F.col("node").alias("g_node")).distinct(), "near-copies")
    h = free_name(docs, "node")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    return hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["g_id"]) & (hashed[h] == gone["g_node"]), "left_anti").drop(h)
