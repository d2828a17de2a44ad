"""Benchmark decontamination by winnowing.

Words are hashed, every ``k`` consecutive word hashes make a k-gram hash, and of
each ``WINDOW - k + 1`` consecutive k-grams the smallest is a fingerprint. Any
shared span of WINDOW words therefore shares a fingerprint. Document fingerprints
are joined with benchmark fingerprints; each hit is extended to every
WINDOW-word window around it, and the windows that the benchmark has are marked.
Items shorter than a window are one window each; for each such length every
position is a fingerprint, which is winnowing with a window of one.

The benchmark is the query set: it is cut into blocks of about ``BLOCK_WORDS``
words, long items into overlapping pieces, and every block meets all documents. A
block is a broadcast of bounded size; with one block (any usual benchmark) the whole
operator is a single pass without a shuffle; with more, a block is broadcast, its
hits are written and its broadcast destroyed before the next, and the marks are
merged per document.

Word, k-gram and window hashes have 64 bits and windows are compared by two
independent ones, 128 bits in all.

Edge cases: null texts have no words, on either side. Items without words match
nothing. Repeated rows give repeated results. Item ids that are null are ignored.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import free_name, id_type, materialize, new_path, text_slices

WINDOW = 13
K = 5
BLOCK_WORDS = 2_000_000
#: Contaminated if at least one word in this many is hit.
ONE_IN = 20

_CLASS = np.zeros(256, bool)
_CLASS[0x80:] = True
_CLASS[0x30:0x3A] = True
_CLASS[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 256)
        have = np.full(size, base)
        have[0] = 1
        _POWERS[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of lower-cased UTF-8 bytes."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _CLASS[data]
    turn = np.flatnonzero(np.diff(inside))
    starts, ends = turn[::2], turn[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = ends - starts
    hashes = np.empty(len(starts), np.uint64)
    # words of a stretch at a time, so that the 8-byte arrays stay small
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK)))
        lo, hi = starts[first], ends[last - 1]
        size, begin = sizes[first:last], starts[first:last] - lo
        place = np.arange(hi - lo) - np.repeat(begin, np.diff(np.append(begin, hi - lo)))
        terms = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BASES[0], int(place.max()) + 1)[place]
        # between words lie bytes that do not count
        terms[~_CLASS[data[lo:hi]]] = 0
        hashes[first:last] = _mix(np.add.reduceat(terms, begin) + size.astype(np.uint64))
        first = last
    return starts, ends, hashes


def _rolling(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of every n consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * base + words[k : k + len(out)]
    return _mix(out)


def _window_at(words: np.ndarray, at: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * base + words[at + k]
    return _mix(out)


def _selected(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions that are the (last) smallest of some ``span`` consecutive k-grams."""
    if len(grams) <= span:
        return np.array([len(grams) - 1 - int(grams[::-1].argmin())] if len(grams) else [], np.int64)
    low, n = grams, len(grams) - span + 1
    least = low[:n].copy()
    for k in range(1, span):
        np.minimum(least, low[k : k + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for k in range(span):
        chosen[k : k + n] |= low[k : k + n] == least
    return np.flatnonzero(chosen)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or -1."""
    if not len(sorted_keys) or not len(keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Benchmark:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, k: int = K):
        self.window, self.k, self.items = window, k, [str(i) for i, _ in items]
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        prints = []
        for number, (_, text) in enumerate(items):
            words = words_of(np.frombuffer(text, np.uint8))[2]
            if not len(words):
                continue
            n = min(window, len(words))
            if n == window:
                grams = _rolling(words, k, _BASES[0])
                prints.append(grams[_selected(grams, window - k + 1)])
            one, two = (_rolling(words, n, b) for b in _BASES)
            by_length.setdefault(n, []).append((one, two, np.full(len(one), number)))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        #: by length: sorted first hashes, their second ones, and each one's items
        self.windows = {}
        for n, found in by_length.items():
            one, two, owner = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((owner, two, one))
            one, two, owner = one[order], two[order], owner[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            self.windows[n] = (one[new], two[new], np.append(np.flatnonzero(new), len(one)), owner)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of hit windows, and the numbers of the items hit."""
        starts, ends, owners = [], [], []
        for n, (one, two, first, owner) in self.windows.items():
            if len(words) < n:
                continue
            if n == self.window:
                grams = _rolling(words, self.k, _BASES[0])
                chosen = _selected(grams, n - self.k + 1)
                chosen = chosen[_find(self.prints, grams[chosen]) >= 0]
                if not len(chosen):
                    continue
                at = np.unique((chosen[:, None] - np.arange(n - self.k + 1)).ravel())
                at = at[(at >= 0) & (at <= len(words) - n)]
                keys = _window_at(words, at, n, _BASES[0])
            else:
                keys = _rolling(words, n, _BASES[0])
                at = np.arange(len(keys))
            place = _find(one, keys)
            at, place = at[place >= 0], place[place >= 0]
            if not len(at):
                continue
            second = _window_at(words, at, n, _BASES[1])
            # equal first hashes of different windows lie side by side
            while True:
                wrong = two[place] != second
                more = wrong & (place + 1 < len(one)) & (one[np.minimum(place + 1, len(one) - 1)] == one[place])
                if not more.any():
                    break
                place[more] += 1
            at, place = at[~wrong], place[~wrong]
            if not len(at):
                continue
            starts.append(at)
            ends.append(at + n)
            spans = np.unique(place)
            owners += [owner[first[p] : first[p + 1]] for p in spans]
        if not starts:
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        return np.stack([np.concatenate(starts), np.concatenate(ends)], axis=1), np.unique(np.concatenate(owners))


def merged(spans: np.ndarray) -> list[list[int]]:
    """Sorted disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for s, e in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _pieces(items: DataFrame, most: int, window: int) -> DataFrame:
    """Items of more than ``most`` words in pieces that overlap by window - 1 words, so that no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "text"):
            keys, cut = [], []
            for k, text in enumerate(texts):
                starts, ends, _ = words_of(np.frombuffer(text, np.uint8))
                if len(starts) <= most:
                    keys.append(k)
                    cut.append(text)
                    continue
                for first in range(0, len(starts) - window + 1, most - window + 1):
                    last = min(first + most, len(starts))
                    keys.append(k)
                    cut.append(text[starts[first] : ends[last - 1]])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keys, pa.int64())), pa.array([t.decode("utf-8", "replace") for t in cut], pa.string())], ["id", "text"])

    return items.mapInArrow(run, items.schema)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int = WINDOW) -> list[DataFrame]:
    """The items (id as string, text) in blocks of about block_words words."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # a word and its separator take two bytes at least
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // (2 * block_words)) + 1
    if n == 1:
        return [items]
    spark, path = benchmark.sparkSession, new_path(benchmark.sparkSession, "benchmark")
    cut = _pieces(items, max(4 * window, block_words // 4), window)
    cut.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).write.partitionBy("block").parquet(path)
    whole = spark.read.schema("id string, text string, block int").parquet(path)
    return [whole.where(F.col("block") == k).drop("block") for k in range(n)]


def _broadcast(docs: DataFrame, items: DataFrame, window: int, k: int):
    """One block of the benchmark, on every executor."""
    found = [(r[0], r[1].encode()) for r in items.distinct().toLocalIterator()]
    return docs.sparkSession.sparkContext.broadcast(Benchmark(found, window, k))


def _hits(bench: Benchmark, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and its hit windows and item numbers."""
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    starts, _, hashes = words_of(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    cut = np.searchsorted(starts, begins)
    return np.diff(cut), [bench.hits(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def hit_spans(docs: DataFrame, bound, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, n_words, spans (hit words, [start, end)), items (ids as strings); bound: a broadcast Benchmark."""
    own = id_type(docs, id_col)
    schema = f"id {own}, n_words long, spans array<struct<s:long,e:long>>, items array<string>"
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = bound.value
        for rows, texts in text_slices(batches, "text"):
            n, found = _hits(bench, texts)
            spans = [[{"s": s, "e": e} for s, e in merged(x)] for x, _ in found]
            hit = [sorted({bench.items[i] for i in owners.tolist()}) for _, owners in found]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(spans, kind), pa.array(hit, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return docs.select(F.col(id_col).cast(own).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _hits_of_blocks(docs: DataFrame, blocks: list[DataFrame], row: str, text_col: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_words) of all rows, and (id, spans, items) of those hit by some block, one block at a time."""
    words, parts = None, []
    for block in blocks:
        bound = _broadcast(docs, block, window, k)
        found = hit_spans(docs, bound, row, text_col)
        if words is None:
            words = found = materialize(found, "block-hits")
            words = words.select("id", "n_words")
            parts.append(found.where("size(spans) > 0").select("id", "spans", "items"))
        else:
            parts.append(materialize(found.where("size(spans) > 0").select("id", "spans", "items"), "block-hits"))
        bound.destroy()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    flat = whole.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["s"] > F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-1))), F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["e"]).alias("e"))))
        ),
    )
    return words, flat.withColumn("spans", joined)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per document: id, n_words, spans, items, n_hit, contaminated."""
    blocks = _blocks(benchmark, item_id, item_text, block_words, window)
    if len(blocks) > 1:
        # a row number tells repeated ids apart while blocks are merged
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast(id_type(docs, id_col)).alias("id"), F.col(text_col).cast("string").alias("text")), "decontaminate")
        words, hits = _hits_of_blocks(rows, blocks, "row", "text", window, k)
        none = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")
        found = rows.select("row", F.col("id").alias("own")).join(words.withColumnRenamed("id", "row"), "row").join(hits.withColumnRenamed("id", "row"), "row", "left")
        found = found.select(F.col("own").alias("id"), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    else:
        found = hit_spans(docs, _broadcast(docs, blocks[0], window, k), id_col, text_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, each judged by itself."""
    blocks = _blocks(benchmark, item_id, item_text, block_words, window)
    if len(blocks) > 1:
        row = free_name(docs, "row")
        rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        words, hits = _hits_of_blocks(rows, blocks, row, text_col, window, k)
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
        bad = hits.select("id", n_hit.alias("n_hit")).join(words, "id").where(F.col("n_hit") * one_in >= F.col("n_words")).select(F.col("id").alias(row))
        return rows.join(bad, row, "left_anti").select(*docs.columns)
    bound = _broadcast(docs, blocks[0], window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text_col):
            n, found = _hits(bound.value, texts)
            hit = np.array([sum(e - s for s, e in merged(spans)) for spans, _ in found])
            yield rows.filter(pa.array(~((hit > 0) & (hit * one_in >= n))))

    return docs.mapInArrow(run, docs.schema)
