"""Best-fit packing of token sequences.

Documents are tokenised, ended with ``end_id`` and cut into pieces of ``capacity``
tokens only where longer. Pieces are dealt by a hash into groups of about
``GROUP_PIECES``, and each group is packed best-fit decreasing: a segment tree
over remaining capacities finds the tightest open sequence for each piece in
logarithmic time. Full pieces fill a sequence alone and are not dealt. The number
of groups follows the input, so no task grows; each group leaves a few sequences
unfilled, one in many thousands.

Only lengths are shuffled; ``packed_ids`` lays the tokens themselves out.

Edge cases: a null or empty text is ``end_id`` alone. Repeated rows are packed
each; the pieces of repeated ids are numbered per row. Rows with a null id are
packed too. Without rows the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import id_type, materialize, text_slices
from zonepulse.llm.tokens import SLICE, encoder

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 20_000


class CapacityTree:
    """Segment tree over capacities 0..size-1: is there an open bin with so much room?"""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """Smallest room of at least ``need`` that some open bin has, or -1."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; bins are numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    tree, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = tree.tightest(length)
        if room < 0:
            chosen, room, n = n, capacity, n + 1
        else:
            chosen = bins[room].pop()
            tree.add(room, -1)
        where[k], offset[k] = chosen, capacity - room
        if room > length:
            bins[room - length].append(chosen)
            tree.add(room - length, 1)
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_space: bool = False, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) per piece; ids are little-endian 32-bit."""
    end = int(end_id).to_bytes(4, "little")
    schema = f"id {id_type(docs, id_col)}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, size = encoder(tokenizer, keep_space), 4 * capacity
        for rows, texts in text_slices(batches, "text", SLICE):
            out: list[list] = [[], [], [], [], [], []]
            for row, ids in enumerate(coder.ids([t.decode("utf-8", "replace") for t in texts])):
                whole = ids + end
                for k, at in enumerate(range(0, len(whole), size)):
                    part = whole[at : at + size]
                    for column, value in zip(out, (row, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            own = rows.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(x, t) for x, t in zip(out[1:], kinds, strict=False))], ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(id_col).cast(id_type(docs, id_col)).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces with id, piece and length."""
    cut = materialize(cut, "pieces")
    short = cut.where(F.col("length") < capacity)
    groups = int(short.count() // group_pieces) + 1
    # the row number only tells repeated pieces apart
    salt = F.xxhash64("id", "piece", "start", F.monotonically_increasing_id())
    dealt = short.withColumn("grp", F.pmod(salt, F.lit(groups)))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "piece"], kind="stable", na_position="first")
        bins, offset = best_fit_decreasing(frame["length"].to_numpy(), capacity)
        return frame.drop(columns="grp").assign(sequence_id=frame["grp"].to_numpy() * (1 << 24) + bins, offset=offset)

    schema = short.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    packed = dealt.groupBy("grp").applyInPandas(fit, schema)
    full = cut.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def packed_ids(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces that carry ids: at most ``capacity`` tokens a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def best_fit_pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), capacity, group_pieces)
