"""Helpers shared by the training-data operators.

* ``materialize`` and the names beside it: tables in the folder that driver and
  executors share, from ``zonepulse.sources.shared``.
* ``text_slices``: cuts Arrow batches into pieces of bounded bytes, so that the
  numpy work of one task stays small whatever the batch size.
* ``local_components``: connected components of a small graph held in a task.
* ``connected_components``: the same for a graph held in a DataFrame.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from zonepulse.sources.shared import DEFAULT_SHARED_DIR, materialize, new_path, qualified, release, shared_dir

__all__ = ["DEFAULT_SHARED_DIR", "materialize", "new_path", "qualified", "release", "shared_dir"]

SLICE_BYTES = 2 << 20


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_type(df: DataFrame, name: str) -> str:
    """The type in which an operator returns ids: long for whole numbers, else the column's own."""
    kind = df.schema[name].dataType
    return "long" if isinstance(kind, IntegralType) else kind.simpleString()


def kept_id(df: DataFrame, name: str) -> str:
    """The type in which files keep ids: long for whole numbers, else string."""
    return "long" if id_type(df, name) == "long" else "string"


def id_kind(manifest: DataFrame) -> str:
    """That type as a manifest states it; long without a statement or without rows."""
    first = manifest.select("id_kind").first() if "id_kind" in manifest.columns else None
    return first[0] if first else "long"


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as UTF-8; null is empty) in pieces of about ``limit`` bytes.

    A longer text makes a piece of its own and is never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(values.cast(pa.binary())).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            rows = batch.slice(first, last - first)
            yield rows, [x or b"" for x in values.slice(first, last - first).cast(pa.binary()).to_pylist()]
            first = last
    # the worker outlives its task: what Arrow keeps for later goes back
    pa.default_memory_pool().release_unused()


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


#: Edges of a graph whose smallest neighbours are broadcast: 16 bytes a node, two nodes an edge at most.
BROADCAST_EDGES = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star rounds, each a partial aggregation (the
    smallest neighbour of a node) and a join, so no node's neighbours are ever
    gathered in one place. In graphs of up to BROADCAST_EDGES edges the smallest
    neighbours are broadcast; in larger ones they are written first, so that AQE can
    split the join of a node with very many edges. Nodes that are in no edge with
    another node are not returned. Nulls are dropped. Each round is written to the
    shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = materialize(now, "cc"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        if seen[0] == 0:
            break
        small = seen[0] <= BROADCAST_EDGES
        beside = lambda rows: F.broadcast(rows) if small else materialize(rows, "cc-least")  # noqa: B023, E731
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = beside(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        now = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = now if small else materialize(now, "cc-large-star")
        least = beside(now.groupBy("a").agg(F.min("b").alias("m")))
        hung = now.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(hung.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI with scheme, usable in any task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class NewFile:
    """A file that one task attempt writes under a name of its own.

    Only files whose rows reach the written manifest count; a failed or repeated
    attempt leaves at most a file that nothing refers to.
    """

    def __init__(self, folder: str, stem: str, ending: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{ending}"
        self.system, self.path = filesystem(self.uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.size = self.system.open_output_stream(self.path, compression=None, buffer_size=1 << 20), 0

    def write(self, data: bytes) -> int:
        """Where the data begin."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
