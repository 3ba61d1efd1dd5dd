"""Centroid clustering in whole numbers by exponion search.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to every other
one. Centroids that move widen the bounds; a vector whose bounds still part is not looked at. For the others only the
centroids inside a ball around their own are scanned: any that is nearest or second nearest lies within
``2 * upper + (distance of the own centroid to its nearest neighbour)`` of it. The sorted lists of distances between
centroids give the ball's members, in annuli whose sizes are powers of two. The radius is inclusive and the bounds are
compared strictly, so ties are seen and go to the smaller number.

Sums are kept as exact integers: after each round only vectors that changed their centroid add to the difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waraq.runtime import bound_batches, drop_materialized, materialize

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Largest absolute value of a component in whole numbers: squared distances of 64 components stay below 2**63.
LIMIT = 1 << 27
#: Up to this value products of 64 components are exact in a float64.
EXACT = 1 << 22
#: Bounds are widened by this share, which is far more than float64 loses.
SLACK = 1e-12


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK) - SLACK, 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` (int64) to those of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Centroids:
    """Centroids with the distances between them, and how far each has moved since the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        k = len(now)
        between = np.sqrt(squared(now, now).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        for a in range(k):  # the centroid itself comes first in its list, also before equal ones
            at = int(np.flatnonzero(self.order[a] == a)[0])
            self.order[a, : at + 1] = np.r_[a, self.order[a, :at]]
        self.near = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else _up(np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)))
        self.moved = moved
        first, second = (np.sort(moved)[::-1][:2]) if k > 1 else (moved[0], 0.0)
        self.others_moved = np.where(moved == first, second if (moved == first).sum() == 1 else first, first)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of ``x``, its bounds, and how many distances were computed.

    ``own`` is each row's last centroid, with bounds as of the centroids before; -1 for rows that have none yet."""
    own, k, seen = own.copy(), len(c.now), 0
    fresh = own < 0
    own[fresh] = 0
    upper = np.where(fresh, np.inf, _up(upper + c.moved[own]))
    lower = np.where(fresh, 0, _down(lower - c.others_moved[own]))
    open_ = np.flatnonzero(upper >= np.maximum(lower, _down(c.near[own] / 2)))
    tight = ((x[open_] - c.now[own[open_]]) ** 2).sum(1)
    seen += len(open_)
    upper[open_] = _up(np.sqrt(tight.astype(np.float64)))
    open_ = open_[upper[open_] >= np.maximum(lower[open_], _down(c.near[own[open_]] / 2))]
    radius = _up(2 * upper[open_] + c.near[own[open_]])
    for a in np.unique(own[open_]):
        rows = open_[own[open_] == a]
        inside = np.searchsorted(c.sorted[a], radius[own[open_] == a], side="right")
        annulus = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64), k)
        for size in np.unique(annulus):
            pick = rows[annulus == size]
            ball = np.sort(c.order[a, :size])  # by number, so that the first smallest is the smaller number
            d = squared(x[pick], c.now[ball])
            seen += d.size
            best = d.argmin(1)
            at = np.arange(len(pick))
            nearest = d[at, best].astype(np.float64)
            d[at, best] = np.iinfo(np.int64).max
            own[pick] = ball[best]
            upper[pick] = _up(np.sqrt(nearest))
            lower[pick] = _down(np.sqrt(d.min(1).astype(np.float64))) if k > 1 else np.inf
    return own, upper, lower, seen


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def _round(c: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                was, upper, lower = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower"))
                own, upper, lower, _ = assign(_matrix(batch.column("body")), was.astype(np.int64), upper, lower, c)
                new = {"cluster": pa.array(own, pa.int32()), "was": batch.column("cluster"), "upper": pa.array(upper), "lower": pa.array(lower)}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return run


def _differences(k: int, width: int):
    """Per task: by how much each centroid's sum and count changed through the rows that came and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([_matrix(batch.column(0)), np.ones(batch.num_rows, np.int64)])
                to, was = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                np.add.at(sums, to, x)
                np.subtract.at(sums, was[was >= 0], x[was >= 0])
        at = np.flatnonzero(sums.any(1))
        if len(at):
            rows = np.repeat(at, width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(np.tile(np.arange(width + 1), len(at)), pa.int32()), pa.array(sums[at].ravel())], ["cluster", "part", "change"])

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("cluster").to_numpy(zero_copy_only=False)
                d = ((_matrix(batch.column("body")) - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def kept_vectors(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and whole, the components as whole numbers, of the vectors that have ``dimensions`` finite components."""
    x = F.col(column)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    kept = vectors.select("vec_id", x.alias("x")).filter(F.coalesce(F.size("x") == dimensions, F.lit(False)) & F.forall("x", lambda v: F.coalesce(finite(v.cast("double")), F.lit(False))))
    return kept.select("vec_id", F.transform("x", lambda v: _whole(v, scale)).alias("whole"))


def _whole(v: Column, scale: int) -> Column:
    """floor(scale * v) as an integer; an error where its absolute value is over ``LIMIT``."""
    n = F.floor(v.cast("double") * scale)
    return F.when(F.abs(v.cast("double") * scale) <= LIMIT, n.cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is over {LIMIT}: squared distances would not fit a long")).cast("int"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components as one run of little-endian 32-bit numbers a row."""
    for batch in batches:
        if batch.num_rows:
            flat = np.asarray(batch.column(1).flatten(), "<i4").reshape(batch.num_rows, -1)
            n = batch.num_rows
            none = pa.array(np.full(n, -1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in flat], pa.binary()), none, none, pa.array(np.full(n, np.inf)), pa.array(np.zeros(n))],
                ["vec_id", "body", "cluster", "was", "upper", "lower"],
            )


def cluster(vectors: DataFrame, column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """k-means in whole numbers: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row per kept vector.

    ``vectors`` has vec_id and an array of numbers. Kept are arrays of exactly ``dimensions`` finite components, each
    turned into floor(``scale`` * component). The first centroids are the ``clusters`` kept vectors whose
    sha256(``seed``:vec_id) is smallest; where fewer are kept, all of them. Each round assigns every vector to its
    nearest centroid (ties: smaller number) and moves every non-empty centroid to floor(sum / count). The vectors are
    then assigned once more. distance is squared.

    Null arrays, other lengths, null, NaN and infinite components: left out. Null vec_id: kept, hashed as the empty text.
    Repeated rows and equal vectors: each counts, and equal hashes are ordered by their components. Empty table, or no
    vector kept: no rows. Other columns are not read. A component over 2**19 in absolute value raises an error, as
    squared distances would not fit a long.

    The driver holds the centroids and their sums alone. Vectors and bounds are written anew each round and the tables
    of the round before deleted, so a lost executor costs only its tasks.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kept = kept_vectors(vectors, column, dimensions, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    state_schema = f"vec_id {kind}, body binary, cluster int, was int, upper double, lower double"
    state = materialize(kept.mapInArrow(_pack, state_schema), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(order.alias("rank"), "body").orderBy("rank", "body").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.stack([np.frombuffer(bytes(r["body"]), "<i4") for r in first]).astype(np.int64)
    k, before = len(now), None
    sums = [[0] * (dimensions + 1) for _ in range(k)]
    for step in range(rounds + 1):
        after = materialize(state.mapInArrow(_round(Centroids(now, before)), state_schema), "vectors")
        drop_materialized(state)
        state = after
        if step == rounds:
            break
        came = state.filter("cluster <> was").select("body", "cluster", "was")
        changes = came.mapInArrow(_differences(k, dimensions), "cluster int, part int, change long").groupBy("cluster", "part").agg(F.sum("change").alias("change"))
        for r in changes.collect():  # clusters * (dimensions + 1) numbers at most
            sums[r["cluster"]][r["part"]] += r["change"]
        before, now = now, np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, now)], np.int64)
    out = materialize(state.select("vec_id", "body", "cluster").mapInArrow(_distances(now), f"vec_id {kind}, cluster int, distance long"), "clusters")
    drop_materialized(state)
    per = {r["cluster"]: r["n"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    names = [(i, per.get(i, 0), sum(per.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(now.tolist())]
    named = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
