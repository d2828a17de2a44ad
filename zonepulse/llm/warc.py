"""WARC archives in Zstandard: one frame per record, dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed; then each record is one frame compressed with it.
The reader loads the dictionary, decodes one frame at a time and checks the
version line, the needed headers, Content-Length and, where one is stated by an
algorithm it knows, the payload digest. It takes any WARC record: header names in any
case, folded lines, optional headers missing, and types without an HTTP message
(warcinfo, metadata and others), whose payload is the block. Payloads are wrapped in an HTTP response. Equal payloads of at least
``MIN_REVISIT`` bytes are stored once: the row with the smallest id is the
response, the others are revisit records that refer to it and keep the HTTP
headers, so length and digest of the full payload survive.

The dictionary is trained on a bounded sample: at most SAMPLE_ROWS payloads of at
most SAMPLE_BYTES each. Every archive is written by one task under a name of its
own; the manifest in the shared folder names those that count.

Roles are found from digests; payloads move only if there are more than BROADCAST_ROWS
repeated digests, and then those of the most frequent ones still do not.

Edge cases: a null payload is empty. Rows with a null id are responses and never
referred to. Rows that repeat the smallest id of a payload are all responses. A null or multi-line URL is percent-encoded to one line, null to "".
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import NewFile, filesystem, id_kind, kept_id, materialize, new_path, qualified

MIN_REVISIT = 100
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 64 << 10, 64 << 10
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
FIXED_DATE = "2000-01-01T00:00:00Z"
RECORD = "id {0}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {0}, record_id string, refers_to_id string"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
VERSIONS = re.compile(r"WARC/(0\.1[78]|1\.[01])")
#: Types whose block is an HTTP message if their content type says so.
MESSAGES = ("response", "request", "revisit")
#: Repeated digests that are broadcast, and the least rows of those that are beyond it.
BROADCAST_ROWS, HOT_ROWS = 100_000, 10_000
_LABEL = {"sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512", "md5": "md5"}


def urn(key: int | str | None) -> str:
    """A record id of a row's id; text is percent-encoded, so that any id makes one header value."""
    return f"<urn:row:{'' if key is None else key if isinstance(key, int) else '~' + quote(key, safe='')}>"


def row_id(stated: str | None, kind: str) -> int | str | None:
    """The row's id of such a record id, null in others."""
    found = re.fullmatch(r"<urn:row:(?:(-?[0-9]+)|~([^>]*))>", stated or "")
    if not found:
        return None
    if kind == "long":
        return int(found[1]) if found[1] else None
    return unquote(found[2]) if found[2] is not None else found[1]


def record(key: int | str | None, url: str | None, digest: str, payload: bytes, refers_to: int | str | None) -> bytes:
    """One WARC record; refers_to makes it a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {FIXED_DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError("a header line has no name")
        out.setdefault(name, value.strip())
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises ValueError if it is not well-formed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not VERSIONS.fullmatch(lines[0].strip()):
        raise ValueError("not a WARC record")
    headers = _fields(lines[1:])
    for name in NEEDED:
        if name not in headers:
            raise ValueError(f"a record has no {name}")
    size = headers["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the record")
    return headers, rest[:-4]


def http_payload(block: bytes) -> tuple[int | None, bytes]:
    """(the full payload's length if stated, the payload that the block holds)."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), body
    return None, body


def dechunked(body: bytes) -> bytes | None:
    """The content of a chunked message body; None if it is not one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        at += n + 2


def holds(stated: str, payload: bytes) -> bool | None:
    """Whether a digest (``algorithm:value``, hexadecimal or base 32) is the payload's; None if it cannot be told."""
    label, colon, value = stated.partition(":")
    algorithm = _LABEL.get(label.strip().lower())
    if not colon or algorithm is None:
        return None
    raw = hashlib.new(algorithm, payload).digest()
    return value.strip().lower() in (raw.hex(), base64.b32encode(raw).decode().lower(), base64.b32encode(raw).decode().rstrip("=").lower())


def content(headers: dict[str, str], block: bytes) -> tuple[int | None, str, bytes]:
    """(full payload's length, its digest, payload held) of a record; raises ValueError if a stated digest does not hold.

    The digest is the payload's SHA-256 in hexadecimal, but for revisits, which hold
    none, the one they state: bare if it is that, else with its algorithm; "" if none.
    """
    kind, stated = headers["warc-type"].lower(), headers.get("warc-payload-digest", "")
    message = kind in MESSAGES and ("application/http" in headers.get("content-type", "application/http"))
    size, payload = http_payload(block) if message else (len(block), block)
    if kind == "revisit":
        return size, stated.removeprefix("sha256:") if re.fullmatch("sha256:[0-9a-f]{64}", stated) else stated, payload
    if stated and holds(stated, payload) is False:
        plain = dechunked(payload) if message else None
        if plain is None or not holds(stated, plain):
            raise ValueError("a payload does not match its digest")
        payload = plain
    return len(payload), hashlib.sha256(payload).hexdigest(), payload


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def frames(stream) -> Iterator[bytes]:
    """Decoded records of an archive, one zstd frame each."""
    buffer, dictionary, more = b"", None, True

    def fill(n: int) -> None:
        nonlocal buffer, more
        while more and len(buffer) < n:
            got = stream.read(1 << 16)
            more, buffer = bool(got), buffer + got

    fill(8)
    if len(buffer) >= 8 and struct.unpack_from("<I", buffer)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", buffer, 4)[0]
        fill(8 + size)
        if len(buffer) < 8 + size:
            raise ValueError("truncated dictionary frame")
        raw, buffer = buffer[8 : 8 + size], buffer[8 + size :]
        if raw[:4] == zstandard.FRAME_HEADER:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    codec = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        fill(1)
        if not buffer:
            return
        one, out = codec.decompressobj(), []
        while not one.eof:
            fill(1)
            if not buffer:
                raise ValueError("truncated frame")
            out.append(one.decompress(buffer))
            buffer = one.unused_data if one.eof else b""
        yield b"".join(out)


def train_dictionary(pages: DataFrame, payload_col: str = "html") -> bytes:
    """A dictionary from a bounded hash sample; empty if there is too little to train on."""
    sized = pages.select(F.encode(F.col(payload_col).cast("string"), "UTF-8").alias("p")).where(F.octet_length("p").between(1, SAMPLE_BYTES))
    found = sized.count()
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(found, 1))
    sample = [bytes(r[0]) for r in sized.where(F.pmod(F.xxhash64("p"), F.lit(1 << 20)) < share * (1 << 20)).limit(SAMPLE_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """id, url, payload, digest, refers_to (null for responses)."""
    rows = pages.select(F.col(id_col).cast(kept_id(pages, id_col)).alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    least_id = rows.where((F.octet_length("payload") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(least_id.where("n > 1"), "warc-firsts")
    refers = F.when(F.col("id").isNotNull() & (F.col("id") != F.col("first")), F.col("first"))
    out = lambda joined: joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))
    if firsts.count() <= BROADCAST_ROWS:
        return out(rows.join(F.broadcast(firsts), "digest", "left"))
    hot = firsts.where(F.col("n") >= HOT_ROWS)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(firsts, "digest", "left")
    return out(rows.join(hot, "digest")).unionByName(out(rest))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, least: int = MIN_REVISIT, level: int = 3) -> DataFrame:
    """Write one archive per task and return the manifest: path, records, bytes."""
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else new_path(spark, "warc")
    dictionary = train_dictionary(pages, payload_col)
    kinds = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        codec = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                key, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    out = NewFile(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.zst")
                    if dictionary:
                        out.write(dictionary_frame(dictionary))
                out.write(codec.compress(record(key, url, digest, payload or b"", refers_to)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": out.uri, "records": n, "bytes": out.size}], kinds)

    with_roles(pages, id_col, url_col, payload_col, least).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("id_kind", F.lit(kept_id(pages, id_col)))


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Per record: id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id[, payload].

    manifest: path, and records where the number is known, which is then checked. id
    and refers_to are those of rows that ``write_archives`` wrote, null in archives
    from elsewhere, where record_id and refers_to_id are the record ids as stated.
    """
    kind = id_kind(manifest)
    own_type = pa.int64() if kind == "long" else pa.string()
    kinds = pa.schema([("id", own_type), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", own_type), ("record_id", pa.string()), ("refers_to_id", pa.string())] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                system, path = filesystem(one["path"])
                out, n, held = [], 0, 0
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for data in frames(stream):
                        headers, block = parse(data)
                        try:
                            size, digest, payload = content(headers, block)
                        except ValueError as flaw:
                            raise ValueError(f"{one['path']}: {flaw}") from flaw
                        n, held = n + 1, held + len(payload)
                        own, other = headers["warc-record-id"], headers.get("warc-refers-to")
                        row = {"id": row_id(own, kind), "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": headers["warc-type"].lower(), "refers_to": row_id(other, kind), "record_id": own, "refers_to_id": other}
                        out.append(row | ({"payload": payload} if with_payload else {}))
                        if len(out) >= 2048 or with_payload and held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out, held = [], 0
                if one["records"] is not None and n != one["records"]:
                    raise ValueError(f"{one['path']} holds {n} records, not {one['records']}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    records = F.col("records").cast("long") if "records" in manifest.columns else F.lit(None).cast("long")
    paths = manifest.select("path", records.alias("records"))
    return paths.repartition(max(1, manifest.count())).mapInArrow(run, RECORD.format(kind) + ", payload binary" * with_payload)
