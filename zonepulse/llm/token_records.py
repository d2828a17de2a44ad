"""Token ids as length-delimited binary records with an offset index.

A shard is a sequence of records:

    length        unsigned 64-bit, of the payload
    check         unsigned 32-bit, masked CRC-32 of the length's eight bytes
    payload       flag byte (1: the id is null, 2: it is text), id (signed 64-bit, or the
                  length of the text and the text in UTF-8), ids (unsigned 32-bit or 16-bit)
    check         unsigned 32-bit, masked CRC-32 of the payload

all little-endian; ids take 16 bits if the vocabulary allows. The index beside
it holds one unsigned 64-bit record offset per record, so that a reader can take
records in any order (``read_at``) without scanning. Rows are range-partitioned
and sorted by id, so the shards in order hold ascending ids.

Each task writes files of its own names; the manifest, written once to the shared
folder, names those that count.

Edge cases: a null or empty text is the end id alone. Null ids come first.
Repeated ids keep all their rows, ordered by a hash of the text and the text.
Without rows there are no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepulse.llm.common import NewFile, filesystem, id_kind, kept_id, new_path, qualified, text_slices
from zonepulse.llm.tokens import SLICE, encoder

END_ID = 2
MASK_DELTA = 0xA282EAD8
_HEAD, _CHECK, _KEY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")
NULL, TEXT = 1, 2
MANIFEST = "shard int, path string, index_path string, width int, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    """CRC-32 rotated and shifted, so that a checksum of checksums stays useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _CHECK.pack(masked(size)), payload, _CHECK.pack(masked(payload))))


def payload(key: int | str | None, ids: np.ndarray, width: int) -> bytes:
    raw = key.encode() if isinstance(key, str) else b""
    head = _KEY.pack(TEXT, len(raw)) + raw if isinstance(key, str) else _KEY.pack(NULL if key is None else 0, key or 0)
    return head + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a shard; raises ValueError if a length or checksum does not hold."""
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise ValueError("truncated record length")
        size, check = _HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("record length does not match its checksum")
        body = stream.read(size + 4)
        if len(body) < size + 4:
            raise ValueError("truncated record")
        if masked(body[:size]) != _CHECK.unpack(body[size:])[0]:
            raise ValueError("record does not match its checksum")
        yield body[:size]


def decode(body: bytes, width: int) -> tuple[int | str | None, np.ndarray]:
    flag, key = _KEY.unpack_from(body)
    at = _KEY.size + (key if flag == TEXT else 0)
    own = None if flag == NULL else body[_KEY.size : at].decode() if flag == TEXT else key
    return own, np.frombuffer(body, "<u2" if width == 2 else "<u4", offset=at).astype("<u4")


def write_records(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write the shards and return their manifest, with ``base``: ids in earlier shards; ids that are no whole numbers are kept as text."""
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else new_path(spark, "token-records")
    rows = docs.select(F.col(id_col).cast(kept_id(docs, id_col)).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions, "id", "tie") if partitions else rows.repartitionByRange("id", "tie")
    ordered = dealt.sortWithinPartitions("id", "tie", "text").select("id", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, data = encoder(tokenizer, True), TaskContext.get().partitionId(), None
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        tokens = records = 0
        for piece, texts in text_slices(batches, "text", SLICE):
            if data is None:
                data, index = NewFile(folder, f"part-{shard:06d}", ".rec"), NewFile(folder, f"part-{shard:06d}", ".idx")
            for key, ids in zip(piece.column(0).to_pylist(), coder.ids([t.decode("utf-8", "replace") for t in texts]), strict=True):
                whole = np.frombuffer(ids + end, "<u4")
                index.write(struct.pack("<Q", data.write(frame(payload(key, whole, width)))))
                tokens, records = tokens + len(whole), records + 1
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": data.uri, "index_path": index.uri, "width": width, "records": records, "tokens": tokens, "bytes": data.size}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("width", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return with_bases(spark, f"{folder}/manifest").withColumn("id_kind", F.lit(kept_id(docs, id_col)))


def with_bases(spark: SparkSession, manifest: str) -> DataFrame:
    """The manifest's rows, one per shard, with the ids before each shard."""
    # one row per written file: as many as the writing job had tasks
    base, rows = 0, []
    for r in sorted(spark.read.schema(MANIFEST).parquet(manifest).toLocalIterator(), key=lambda r: r["shard"]):
        rows.append((*r, base))
        base += r["tokens"]
    return spark.createDataFrame(rows, MANIFEST + ", base long")


def read_records(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per record: id, start, n_tokens, ids_crc32[, ids], all from the shards."""
    kind = id_kind(manifest)
    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    kinds = pa.schema([("id", pa.int64() if kind == "long" else pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["path"])
                at, out, n = row["base"], [], 0
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for body in unframe(stream):
                        key, ids = decode(body, row["width"])
                        out.append({"id": key, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())} | ({"ids": ids.astype(np.int64)} if with_ids else {}))
                        at, n = at + len(ids), n + 1
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out = []
                if (n, at - row["base"]) != (row["records"], row["tokens"]):
                    raise ValueError(f"{row['path']} holds {n} records and {at - row['base']} ids, not those of the manifest")
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    shards = manifest.select("path", "width", "records", "tokens", "base")
    return shards.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def read_at(path: str, index_path: str, width: int, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard by their places, in the order asked for."""
    system, at = filesystem(index_path)
    with system.open_input_file(at) as f:
        offsets = np.frombuffer(f.read(), "<u8")
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        out = []
        for k in places:
            f.seek(int(offsets[k]))
            out.append(decode(next(unframe(f)), width))
    return out
