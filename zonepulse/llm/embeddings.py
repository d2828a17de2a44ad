"""Embedding near-duplicates in spherical k-means cells.

Equal vectors are collapsed into classes first. Centroids are fitted on a bounded
sample (SAMPLE_VECTORS); each class is assigned to its nearest centroid's cell and
also visits every cell where a link partner might live: if u's nearest centroid
is c and v lies within chord r of u, then v.(c' - c) <= r |c' - c| for v's nearest
centroid c'. So the cells lose no link, and clustered vectors visit few cells.

Labels of up to CELL_ROWS vectors are one cell. For the others the first level has at
most FIRST_CELLS cells of a dimension, and each cell of more than REFINE of the rows aimed at is divided again by centroids of its own, fitted on
SUB_SAMPLE of its vectors; its visitors are divided with it by the same rule. Inside
a cell, blocks of at most BLOCK_ROWS vectors are compared by matrix products in
double precision; a task holds two blocks and returns counts and a spanning forest
of its links, never the pairs.

Only vectors of equal, non-null label and equal dimension are compared.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing and are kept. Vectors are
scaled by a power of two before their squares are taken, so none overflows. Repeated
ids count as one node; rows with a null id link but never name a component, and
a component without any id is null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import connected_components, id_type, local_components, materialize

THRESHOLD = 0.98
SAMPLE_VECTORS = 20_000
#: Rows that a cell is to hold; labels of no more are one cell.
CELL_ROWS = 4096
BLOCK_ROWS = 2048
FIRST_CELLS = 4096
#: Cells of more than REFINE * cell_rows members are divided, LEVELS times at most, into SUB_CELLS each.
REFINE, LEVELS, SUB_CELLS, SUB_SAMPLE = 4, 4, 64, 2048
#: Rows divided in one task, and cells whose sizes are broadcast.
REFINE_ROWS, CELLS_BROADCAST = 8192, 100_000
ITERATIONS = 8


def spherical_kmeans(vectors: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centers = vectors[rng.permutation(len(vectors))[:k]].copy()
    for _ in range(iterations):
        near = np.argmax(vectors @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1)
        sums[size < 1e-12] = vectors[rng.integers(0, len(vectors), int((size < 1e-12).sum()))]
        centers = sums / np.linalg.norm(sums, axis=1)[:, None]
    return centers


def _unit(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    if not x.size:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _visits(unit: np.ndarray, centers: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own) of every cell that each vector lies in or visits."""
    dots = unit @ centers.T
    own = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centers @ centers.T)))
    near = dots[np.arange(len(own)), own][:, None] - dots <= reach * apart[own]
    near[np.arange(len(own)), own] = True
    rows, cells = np.nonzero(near)
    return rows, cells, cells == own[rows]


def _fit(classes: DataFrame, sample: int, cell_rows: int, first_cells: int) -> dict[int, np.ndarray]:
    """Centroids by dimension, from vectors of large labels (``large``); dimensions without any have none."""
    classes = classes.where("large")
    sizes = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
    out = {}
    for dim, most, n in sizes:
        k = min(first_cells, math.ceil(most / cell_rows))
        if k < 2:
            continue
        part = min(1.0, 1.1 * sample / n)
        drawn = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit("cells"), "vector"), F.lit(1 << 20)) < part * (1 << 20))).select("vector").limit(sample).toArrow()
        if drawn.num_rows >= k:
            out[dim] = spherical_kmeans(_unit(drawn.column(0).combine_chunks()), k)
    return out


def _divided(cells: DataFrame, big: DataFrame, schema: str, reach: float) -> DataFrame:
    """The cells of ``big`` (label, dim, cell, homes, members) divided by centroids of their own."""
    key = ["label", "dim", "cell"]
    inside = cells.join(F.broadcast(big) if big.count() <= CELLS_BROADCAST else big, key)
    drawn = inside.where("home").where(F.pmod(F.xxhash64(F.lit("sub"), "rep"), F.col("homes")) < SUB_SAMPLE)

    def fit(frame: pa.Table) -> pa.Table:
        frame = frame.combine_chunks()
        unit = _unit(frame.column("vector").combine_chunks())
        centers = spherical_kmeans(unit, min(SUB_CELLS, len(unit)))
        names = frame.slice(0, 1).select(["label", "dim", "cell"])
        return names.append_column("centers", pa.array([centers.ravel()], pa.list_(pa.float64())))

    head = ", ".join(schema.split(", ")[:3])
    centers = materialize(drawn.select(*key, "vector").groupBy(*key).applyInArrow(fit, f"{head}, centers array<double>"), "sub-cells")
    salts = F.greatest(F.lit(1), F.ceil(F.col("members") / REFINE_ROWS)).cast("int")
    dealt = inside.withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    spread = centers.join(big, key).select(*key, "centers", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def divide(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["label", "dim", "cell", "home", "rep", "n", "vector"]
        left = left.select(names).combine_chunks()
        if not left.num_rows or not right.num_rows:
            return left
        unit = _unit(left.column("vector").combine_chunks())
        rows, sub, own = _visits(unit, np.array(right.column("centers")[0].as_py()).reshape(-1, unit.shape[1]), reach)
        taken = left.take(pa.array(rows))
        taken = taken.set_column(2, "cell", pa.array(np.asarray(taken.column("cell")) * FIRST_CELLS + sub))
        # at home where it is so on every level
        return taken.set_column(3, "home", pa.array(np.asarray(taken.column("home").cast(pa.int8())).astype(bool) & own))

    by = [*key, "salt"]
    smaller = dealt.select(*by, "home", "rep", "n", "vector").groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(divide, schema)
    return cells.join(big.select(*key), key, "left_anti").select(*smaller.columns).unionByName(smaller)


def links(
    classes: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE_VECTORS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, first_cells: int = FIRST_CELLS, refine: int = REFINE
) -> DataFrame:
    """(rep, root, linked): per class and block pair, its forest edge and the vectors linked.

    classes: rep, label, dim, vector (array of float or double), n (copies).
    """
    large = materialize(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > cell_rows).select("label", "dim", F.lit(True).alias("large")), "large-labels")
    large = F.broadcast(large) if large.count() <= CELLS_BROADCAST else large
    classes = classes.join(large, ["label", "dim"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
    centers = classes.sparkSession.sparkContext.broadcast(_fit(classes, sample, cell_rows, first_cells))
    reach = 2 * math.sin(math.acos(threshold) / 2) + 1e-9
    kind = dict(classes.dtypes)
    schema = f"label {kind['label']}, dim int, cell long, home boolean, rep long, n long, vector {kind['vector']}"

    def assign(batches: Iterator[pa.RecordBatch], whole_rows: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # rows of small labels stand apart, as dimension 0
            dims = np.where(np.asarray(whole.column(5).cast(pa.int8())) == 1, np.asarray(whole.column(1)), 0)
            for dim in np.unique(dims):
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048).filter(pa.array(dims[at : at + 2048] == dim))
                    if not batch.num_rows:
                        continue
                    c = centers.value.get(int(dim))
                    if c is None:
                        rows, cells, home = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
                    else:
                        rows, cells, home = _visits(_unit(batch.column(4)), c, reach)
                    taken = (batch if whole_rows else batch.select([0, 1])).take(pa.array(rows))
                    # numbers of different levels differ: one of a level lies between its power of FIRST_CELLS and twice that
                    columns = [taken.column(0), taken.column(1), pa.array(cells.astype(np.int64) + FIRST_CELLS), pa.array(home)]
                    names = ["label", "dim", "cell", "home"]
                    if whole_rows:
                        columns, names = [*columns, taken.column(2), taken.column(3), taken.column(4)], [*names, "rep", "n", "vector"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = classes.select("label", F.col("dim").cast("int"), "rep", "n", "vector", "large")
    blocks = lambda n: F.ceil(n / F.lit(block_rows)).cast("int")

    def sized(cells: DataFrame) -> DataFrame:
        counts = cells.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("members"))
        return materialize(counts.where("members > 1 and homes > 0"), "cell-sizes")

    # sizes first, from the cells' numbers alone: the vectors move once
    sizes = sized(rows.mapInArrow(lambda it: assign(it, False), ", ".join(schema.split(", ")[:4])))
    cells = rows.mapInArrow(lambda it: assign(it, True), schema)
    for level in range(LEVELS):
        big = sizes.where(F.col("homes") > refine * cell_rows)
        if big.isEmpty():
            break
        cells = materialize(_divided(cells if level else materialize(cells, "cells"), big, schema, reach), "cells")
        sizes = sized(cells)
    # members of a cell meet each other and its visitors; visitors do not meet here
    few = sizes.count() <= CELLS_BROADCAST
    sizes = sizes.select("label", "dim", "cell", blocks(F.col("homes")).alias("homes"), blocks(F.col("members") - F.col("homes")).alias("guests"))
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda guest, a, b, second: F.struct(F.lit(guest).alias("guest"), a.alias("i"), b.alias("j"), second.alias("second"))
    own = F.transform(upto(F.col("homes")), lambda k: task(False, F.least(k, F.col("mine")), F.greatest(k, F.col("mine")), k < F.col("mine")))
    met = F.transform(upto(F.col("guests")), lambda k: task(True, F.col("mine"), k, F.lit(False)))
    visits = F.transform(upto(F.col("homes")), lambda k: task(True, k, F.col("mine"), F.lit(True)))
    dealt = (
        cells.join(F.broadcast(sizes) if few else sizes, ["label", "dim", "cell"])
        .withColumn("mine", mine)
        .select("label", "dim", "cell", "rep", "n", "vector", F.explode(F.when(F.col("home"), F.concat(own, met)).otherwise(visits)).alias("t"))
        .select("label", "dim", "cell", "t.guest", "t.i", "t.j", "t.second", "rep", "n", "vector")
    )

    def compare(frame: pa.Table) -> pa.Table:
        frame = frame.combine_chunks()
        get = lambda name: frame.column(name).combine_chunks()
        unit, rep, n = _unit(get("vector")), np.asarray(get("rep")), np.asarray(get("n"))
        second = np.asarray(get("second").cast(pa.int8())).astype(bool)
        guest = frame.column("guest")[0].as_py()
        split = guest or frame.column("i")[0].as_py() != frame.column("j")[0].as_py()
        a = np.flatnonzero(~second) if split else np.arange(len(rep))
        b = np.flatnonzero(second) if split else np.arange(len(rep))
        close = unit[a] @ unit[b].T >= threshold
        if guest:  # such a pair meets in both its cells and counts in that of its smaller member
            close &= rep[a][:, None] < rep[b][None, :]
        if not split:
            np.fill_diagonal(close, False)
        linked = np.zeros(len(rep), np.int64)
        linked[a] += close @ n[b]
        if split:
            linked[b] += close.T @ n[a]
        x, y = np.nonzero(close)
        root = local_components(len(rep), a[x], b[y])
        some = np.flatnonzero(linked > 0)
        return pa.table({"rep": rep[some], "root": rep[root[some]], "linked": linked[some]})

    return dealt.groupBy("label", "dim", "cell", "guest", "i", "j").applyInArrow(compare, "rep long, root long, linked long")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per vector: id, n_links, component, kept."""
    rows = vectors.select(F.col(id_col).cast(id_type(vectors, id_col)).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    flaw = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & ~flaw & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable")
    # 128 bits stand for a label and a vector, so that vectors move once
    key = [F.xxhash64(F.lit(k), F.col("label"), F.col("vector")).alias(f"k{k}") for k in (1, 2)]
    grouped = good.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped.select("label", "vector", *key, "first", "n", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("rep")), "vectors")
    found = materialize(links(classes, threshold, **options), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    joined = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # classes without an id name no component
    known = classes.select("k1", "k2", "first", "n", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("k1", "k2", "rep", "first", "n", F.coalesce("component", "rep").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    of = known.join(least, "root").join(counts, "rep", "left").select("k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    of = materialize(of, "vector-of")
    linked = good.select("id", *key).join(of, ["k1", "k2"]).select("id", "n_links", "component")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()))
