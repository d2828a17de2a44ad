"""Centroid clustering of integer vectors: Lloyd's rounds with Elkan's bounds.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of
that to each of the k centroids. When centroids move, bounds move by as much, and a
distance is computed only where the bounds and the distances between centroids
leave it open. Distances are of integers and exact: the results are those of
computing all of them. Bounds are doubles that are always rounded away from
the true value, and a centroid is passed over only where it is strictly farther,
so ties are decided by exact distances and the smaller number.

A round is one pass of ``mapInArrow`` over the written table of vectors and bounds
and one sum by cluster and component; the driver holds the k centroids alone. Each
round's table is written to the shared folder, so a lost executor costs a round's
tasks at most. No row is shuffled.

Vectors enter as floor(scale * x) of each component. Components below 2^27 in size are
computed in 64-bit integers, larger ones in Python's.

Edge cases: vectors that are null, of another length, with a null or non-finite
component, or with one of 2^53 or more after scaling (no double holds its
fraction) are not kept. Rows with a null id are assigned but never start a
centroid; of rows with one id, the smaller vector starts first. With fewer named
vectors than k there are fewer centroids; without any, cluster and distance are
null. A distance or inertia beyond a long is null. Without rows the result is
empty. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import id_type, materialize

K, ROUNDS, SCALE, SIZE = 16, 3, 64, 64
#: Components up to this size have squared distances within a long, for up to 64 of them.
SMALL = 1 << 27
LARGEST = float(1 << 53)
#: Vectors that a task compares at once.
ROWS = 8192
#: Relative slack of every rounded bound: some units in the last place of a float.
SLACK = 1e-6


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that count, as whole numbers."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(F.when(~F.isnan(c) & (F.abs(c) * scale < LARGEST), c) * scale).cast("long"))
    found = rows.select(F.col(id_col).cast(id_type(rows, id_col)).alias("id"), F.when(F.size(x) == size, whole).alias("v"))
    return found.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull()))


def first_centroids(vectors: DataFrame, k: int = K) -> list[list[int]]:
    """The vectors of the k smallest SHA-256 of ``1:<id>``: k rows, whatever the input."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.where(F.col("id").isNotNull()).select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def up(x: np.ndarray) -> np.ndarray:
    """At least the true value, as a float."""
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """At most the true value, never below zero."""
    return np.maximum(np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = v - c
    return (d * d).sum(axis=1)


def root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class Geometry:
    """What a round needs of its centroids: the integers, half their distances, and how far each has moved."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.exact = np.array(centroids, dtype=object)
        k = len(centroids)
        apart = np.array([[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in centroids] for p in centroids], dtype=object)
        self.half = down(root(apart) / 2)
        others = np.where(np.eye(k, dtype=bool), np.float32(np.inf), self.half)
        self.nearest = others.min(axis=1)
        moved = [0] * k if before is None else [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(centroids, before, strict=True)]
        self.moved = np.where(np.array([m == 0 for m in moved]), np.float32(0), up(root(np.array(moved, dtype=object))))


def first_assignment(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) from all distances."""
    lower = np.empty((len(v), len(centroids)), np.float32)
    best, cluster = None, np.zeros(len(v), np.int64)
    for c, centroid in enumerate(centroids):
        d = squared(v, centroid)
        lower[:, c] = down(root(d))
        if best is None:
            best = d
        else:
            closer = (d < best).astype(bool)
            best, cluster = np.where(closer, d, best), np.where(closer, c, cluster)
    return cluster, up(root(best)), lower


def reassign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, shape: Geometry, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances computed) after the centroids have moved."""
    upper = np.where(shape.moved[cluster] > 0, up(upper + shape.moved[cluster]), upper)
    lower = np.where(shape.moved > 0, down(lower.astype(np.float64) - shape.moved), lower)
    cluster, computed = cluster.copy(), 0
    open_ = np.flatnonzero(~(upper < shape.nearest[cluster]))
    if len(open_):
        best = squared(v[open_], centroids[cluster[open_]])
        computed += len(open_)
        upper[open_] = up(root(best))
        lower[open_, cluster[open_]] = down(root(best))
        still = ~(upper[open_] < shape.nearest[cluster[open_]])
        open_, best = open_[still], best[still]
        for c in range(len(centroids)):
            mine = cluster[open_]
            u = upper[open_]
            test = np.flatnonzero((mine != c) & ~(u < lower[open_, c]) & ~(u < shape.half[mine, c]))
            if not len(test):
                continue
            at = open_[test]
            d = squared(v[at], centroids[c])
            computed += len(at)
            lower[at, c] = down(root(d))
            closer = (d < best[test]) | ((d == best[test]) & (c < cluster[at]))
            closer = closer.astype(bool)
            won = test[closer]
            best[won] = d[closer]
            cluster[open_[won]] = c
            upper[open_[won]] = up(root(d[closer]))
    return cluster, upper, lower, computed


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their vectors) of at most ROWS rows; vectors as objects where 64 bits may not do."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            v = np.asarray(rows.column(rows.schema.get_field_index("v")).flatten()).astype(np.int64).reshape(rows.num_rows, size)
            yield rows, v if not v.size or np.abs(v).max() <= SMALL else v.astype(object)


def _centroids(shape: Geometry, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, centroids) of one number type that holds their distances."""
    if v.dtype == object or max(map(abs, shape.exact.ravel()), default=0) > SMALL:
        return v.astype(object), shape.exact
    return v, shape.exact.astype(np.int64)


def _assigned(state: DataFrame, shape: Geometry, size: int, first: bool) -> DataFrame:
    """The vectors with their cluster and bounds for these centroids."""
    kind = state.schema["id"].dataType.simpleString()
    k = len(shape.exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, v in _blocks(batches, size):
            v, centroids = _centroids(shape, v)
            if first:
                cluster, upper, lower = first_assignment(v, centroids)
            else:
                old = np.asarray(rows.column(2)).astype(np.int64)
                bound = np.asarray(rows.column(4).flatten()).reshape(rows.num_rows, k)
                cluster, upper, lower, _ = reassign(v, old, np.asarray(rows.column(3)), bound, shape, centroids)
            offsets = pa.array(np.arange(0, rows.num_rows * k + 1, k), pa.int32())
            columns = [rows.column(0), rows.column(1), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), pa.ListArray.from_arrays(offsets, pa.array(lower.ravel(), pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(run, f"id {kind}, v array<bigint>, cluster int, upper float, lower array<float>")


def _means(state: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """Componentwise floor(sum / count) of each cluster; empty ones stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * size for _ in range(k)], [0] * k
        for rows, v in _blocks(batches, size):
            cluster = np.asarray(rows.column(1))
            for c in np.unique(cluster).tolist():
                mine = v[cluster == c]
                counts[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(axis=0), strict=True)]
        for c in range(k):
            if counts[c]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(list(map(Decimal, sums[c])), pa.decimal128(38, 0)), pa.array([counts[c]] * size, pa.int64())],
                    ["cluster", "place", "s", "n"],
                )

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, place int, s decimal(38,0), n long")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # k * size rows
        out[r["cluster"]][r["place"]] = int(r["s"]) // r["n"]
    return out


def _distances(state: DataFrame, shape: Geometry, size: int) -> DataFrame:
    """(id, cluster, distance): the exact squared distance to the assigned centroid, as a decimal."""
    kind = state.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, v in _blocks(batches, size):
            v, centroids = _centroids(shape, v)
            d = squared(v, centroids[np.asarray(rows.column(2)).astype(np.int64)])
            exact = pa.array(list(map(Decimal, d.tolist())), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), exact], ["id", "cluster", "distance"])

    return state.select("id", "v", "cluster").mapInArrow(run, f"id {kind}, cluster int, distance decimal(38,0)")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    state = materialize(kept_vectors(rows, id_col, vector_col, size, scale), "elkan-vectors")
    centroids, before = first_centroids(state, k), None
    if not centroids:
        nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
        return state.select("id", nothing("int", "cluster"), *[nothing("long", c) for c in ("distance", "cluster_inertia", "inertia")], nothing("string", "centroid_sha256"))
    for done in range(rounds + 1):
        shape = Geometry(centroids, before)
        state = materialize(_assigned(state, shape, size, done == 0), "elkan-state")
        if done < rounds:
            before, centroids = centroids, _means(state, centroids, size)
    found = _distances(state, shape, size)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    by_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    distance: Column = F.expr("try_cast(distance as bigint)")
    return found.select(
        "id", "cluster", distance.alias("distance"),
        by_cluster([fits(sums.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"),
        by_cluster([centroid_digest(c) for c in centroids], "string").alias("centroid_sha256"),
    )
