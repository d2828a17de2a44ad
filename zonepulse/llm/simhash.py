"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles. Fingerprints within ``radius`` bits are linked. In a block of candidates
the fingerprints are stored as bit planes, 64 fingerprints to a word; a query's
differences with 64 others are added up by carry-save counters, and a word is
abandoned as soon as all its lanes exceed the radius. There are two ways to blocks:

* ``fingerprint_links``, for 64 bits and a small radius, loses no link. The bits are
  cut into radius + 2 parts; two fingerprints within the radius agree in at least two
  of them, so every pair of parts is a table of keys. A block of more than
  ``BLOCK_ROWS`` fingerprints is dealt anew, with the pairs of parts of the bits that
  are still free in it as further keys, until 2 ** (free bits) is no more than a
  block; so a hot key costs a fixed number of copies of its rows.
* ``sampled_links``, for wide fingerprints (WIDE words of 64 bits) and a radius of a
  sixth of their bits, as a similarity of 0.8 needs: each table's key is a sample of
  bits, more of them in larger corpora, and there are as many tables as a link of
  exactly the radius needs to meet with probability RECALL; closer ones meet more
  surely. Blocks of more than ``WIDE_ROWS`` are cut and compared in pairs.

A task emits a spanning forest of the links it found, never all pairs.

``simhash_dedup`` takes distinct shingles of five words and wide fingerprints: shares
of a Jaccard similarity of 0.8 differ in about 35 of 256 bits, RADIUS_WIDE covers it.

Edge cases: a null or empty text, or one without words, has fingerprint zero and
is linked like any other. Equal texts have equal fingerprints and share a class.
Rows with a null id keep a fingerprint; their component is the smallest non-null
id that shares or reaches it, or null. Repeated rows give repeated results.
Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import connected_components, id_type, local_components, materialize, text_slices

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Rows of a block that is not dealt anew, and of blocks that never are.
BLOCK_ROWS, LEAST_ROWS = 1024, 256
#: Near-duplicate removal: words of 64 bits, largest distance, words a shingle.
WIDE, RADIUS_WIDE, SHINGLE_WIDE = 4, 44, 5
#: Wide blocks that are not cut, rows a key aimed at, fewest bits a key, chance that a link of the radius meets.
WIDE_ROWS, KEY_ROWS, KEY_BITS, RECALL = 16_384, 1024, 12, 0.9
#: Tables of at most so many hot keys are broadcast, and of at most so many rows that go: 16 bytes a row and the id.
HOT_KEYS, GONE_ROWS = 100_000, 250_000
#: (query, word) pairs compared at once, and rows whose planes are held, but for larger blocks.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 15, 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, in order; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64, len(words) - shingle + 1)


_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray) -> np.uint64:
    """Bits that more than half of the hashes have."""
    n = len(hashes)
    rows = np.zeros(-(-n // 255) * 255, np.uint64)
    rows[:n] = hashes
    ones = np.empty((8, 8), np.int64)  # by place in its byte, and by byte
    for k in range(8):
        # each byte of a sum counts the bit of up to 255 hashes
        sums = ((rows >> np.uint64(k)) & _LANES).reshape(-1, 255).sum(axis=1)
        ones[k] = sums.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(ones.T.ravel() * 2 > n, bitorder="little").view("<u8")[0]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    return int(_majority(shingle_hashes(text, shingle)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: bytes, shingle: int = SHINGLE_WIDE, words: int = WIDE) -> bytes:
    """SimHash of 64 * words bits over distinct shingles; further words come from mixed hashes."""
    own = np.unique(shingle_hashes(text, shingle))
    steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.array([_majority(_mix(own + k) if k else own) for k in steps], "<u8").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """(id, th, fp): the text's XXH64, and its fingerprint, a signed long or for words > 1 binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "text"):
            if words == 1:
                fps = pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
            else:
                fps = pa.array([wide_fingerprint(t, shingle, words) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), fps], ["id", "th", "fp"])

    kind = id_type(docs, id_col)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast(kind).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, f"id {kind}, th long, fp {'long' if words == 1 else 'binary'}")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(bits, words): bit b of fingerprint i is bit i % 64 of planes[b, i // 64].

    fps: one row of 64-bit words a fingerprint.
    """
    words, size = -(-len(fps) // 64), 64 * fps.shape[1]
    padded = np.zeros((words * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, size // 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T.reshape(size, words, 64), axis=2, bitorder="little")
    return np.frombuffer(packed.tobytes(), "<u8").reshape(size, words)


def linked_pairs(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (q, i) within the radius, for each q and the rows first[q] <= i < last[q].

    fps: fingerprints of one 64-bit word, or rows of several.

    Every (query, 64-row word) that a range touches is one lane block; its
    distance is kept in carry-save counters of as many bits as the radius needs.
    """
    fps = fps.reshape(len(fps), -1)
    planes, depth = planes_of(fps), max(1, int(radius + 1).bit_length())
    spans = np.where(last > first, ((last - 1) >> 6) - (first >> 6) + 1, 0)
    ends, found = np.cumsum(spans), []
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, PAIRS_AT_ONCE):
        pair = np.arange(at, min(total, at + PAIRS_AT_ONCE))
        q = np.searchsorted(ends, pair, side="right")
        w = (first[q] >> 6) + (pair - (ends[q] - spans[q]))
        low, high = np.maximum(first[q] - (w << 6), 0), np.minimum(last[q] - (w << 6), 64)
        lanes = (ALL >> (64 - high).astype(np.uint64)) & (ALL << low.astype(np.uint64))
        counters, over = [np.zeros(len(q), np.uint64) for _ in range(depth)], ~lanes
        mine = fps[q]
        for bit in range(len(planes)):
            carry = planes[bit, w] ^ (np.uint64(0) - ((mine[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)))
            for level in range(depth):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            over |= carry
            if bit % 8 == 7 and bit >= radius:
                # lanes whose count already exceeds the radius
                above, equal = np.zeros(len(q), np.uint64), np.full(len(q), ALL)
                for level in reversed(range(depth)):
                    if radius >> level & 1:
                        equal &= counters[level]
                    else:
                        above |= equal & counters[level]
                        equal &= ~counters[level]
                out = over | above
                alive = out != ALL
                if not alive.all():
                    q, w, over, mine, out = q[alive], w[alive], over[alive], mine[alive], out[alive]
                    counters = [c[alive] for c in counters]
                if not len(q):
                    break
        if len(q):
            lanes = np.unpackbits((~out).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            found.append((q[k], (w[k] << 6) + lane))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _compare_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, side, node, fp) sorted in this order; emits forests of links (a, b) of nodes."""
    kept: list[tuple[np.ndarray, ...]] = []

    def flush(key: np.ndarray, cell: np.ndarray, side: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        n = len(key)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        sizes = np.diff(np.append(starts, n))
        first, last = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        others = np.add.reduceat((side == 0).astype(np.int64), starts)
        split = others < sizes  # two sub-blocks: only the first asks, only the second answers
        begin = np.where(np.repeat(split, sizes), first + np.repeat(others, sizes), np.arange(n) + 1)
        last = np.where(side == 1, begin, last)
        q, i = linked_pairs(fp, begin, last, radius)
        root = local_components(n, q, i)
        hung = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[root[hung]])], ["a", "b"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column(4)
        words = np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(fp), -1) if pa.types.is_binary(fp.type) or pa.types.is_large_binary(fp.type) else np.asarray(fp).view(np.uint64).reshape(-1, 1)
        kept.append((*(np.asarray(batch.column(k)) for k in range(4)), words))
        rows += batch.num_rows
        if rows < ROWS_AT_ONCE:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        other = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield flush(*(x[:cut] for x in whole))
        kept, rows = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
    if rows:
        yield flush(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def _compared(blocks: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows of key, cell, side, node, fp."""
    dealt = blocks.select("key", "cell", "side", "node", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell", "side", "node")
    return dealt.mapInArrow(lambda it: _compare_groups(it, radius), "a long, b long")


def _hot_keys(keyed: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(key, n) of keys with more than ``most`` rows, small enough to broadcast or not, and whether there are any."""
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "simhash-hot")
    found = hot.count()
    return (F.broadcast(hot) if found <= HOT_KEYS else hot), found > 0


def _parts(bits: list[int], parts: int) -> list[list[int]]:
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _masks(radius: int, levels: int) -> list[list[int]]:
    """Of each level, the masks of its tables: those of the level above, each with two more parts."""
    tables = [(0, list(range(64)))]
    out = []
    for _ in range(levels):
        below = []
        for mask, free in tables:
            cut = _parts(free, radius + 2)
            for x, y in combinations(range(radius + 2), 2):
                taken = {*cut[x], *cut[y]}
                below.append((mask | sum(1 << b for b in taken), [b for b in free if b not in taken]))
        tables = below
        out.append([mask - (1 << 64) if mask >> 63 else mask for mask, _ in tables])
    return out


def fingerprint_links(classes: DataFrame, radius: int = RADIUS, block_rows: int | None = None) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius, from distinct ``fp``."""
    block_rows = block_rows or BLOCK_ROWS
    per, free, levels = math.comb(radius + 2, 2), 64, 0
    while 1 << free > max(block_rows, LEAST_ROWS):
        free, levels = free - sum(sorted(map(len, _parts(list(range(free)), radius + 2)))[:2]), levels + 1
    masks = _masks(radius, levels)
    rows = classes.select("fp", F.lit(0).alias("table"))
    found = None
    for level in range(levels):
        literal = F.array(*[F.lit(m).cast("long") for m in masks[level]])
        tables = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.col("table") * per + k)
        keyed = rows.select("fp", F.explode(tables).alias("table"))
        keyed = keyed.select("fp", "table", F.xxhash64("table", F.col("fp").bitwiseAND(F.element_at(literal, F.col("table") + 1))).alias("key"))
        hot, any_hot = _hot_keys(keyed, block_rows) if level + 1 < levels else (None, False)
        cold = keyed
        if any_hot:
            rows = keyed.join(hot, "key", "left_semi").select("fp", "table")
            cold = keyed.join(hot, "key", "left_anti")
        part = cold.select("key", F.lit(0).alias("cell"), F.lit(0).alias("side"), F.col("fp").alias("node"), "fp")
        found = part if found is None else found.unionByName(part)
        if not any_hot:
            break
    return _compared(found, radius)


def key_samples(n: int, bits: int, radius: int) -> np.ndarray:
    """(tables, bits a key): the bits that each table samples, for n fingerprints."""
    size = min(40, max(KEY_BITS, math.ceil(math.log2(max(1, n) / KEY_ROWS))))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - radius / bits) ** size))
    rng, dealt = np.random.default_rng(SEED), []
    # every bit is used once before one is used again
    while sum(map(len, dealt)) < tables:
        order = rng.permutation(bits)
        dealt.append(order[: bits // size * size].reshape(-1, size))
    return np.concatenate(dealt)[:tables]


def sampled_links(classes: DataFrame, radius: int, words: int = WIDE, block_rows: int | None = None) -> DataFrame:
    """(a, b): links of nodes within the radius, from (node, fp), distinct binary fingerprints."""
    block_rows = block_rows or WIDE_ROWS
    samples = key_samples(classes.count(), 64 * words, radius)
    powers = np.uint64(1) << np.arange(samples.shape[1], dtype=np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _mix(np.arange(1, len(samples) + 1, dtype=np.uint64))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
                key = np.stack([_mix((bits[:, s].astype(np.uint64) * powers).sum(axis=1) + t) for s, t in zip(samples, tables, strict=True)], axis=1)
                taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), len(samples))))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *taken.columns], ["key", "node", "fp"])

    keyed = classes.select("node", "fp").mapInArrow(keys, "key long, node long, fp binary")
    hot, any_hot = _hot_keys(keyed, block_rows)
    zero = F.lit(0)
    if not any_hot:
        return _compared(keyed.withColumns({"cell": zero.cast("long"), "side": zero}), radius)
    cut = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block_rows)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")
    pairs = F.transform(F.sequence(zero, F.col("cut") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    cell: Column = F.shiftleft(F.col("p.i").cast("long"), 31) + F.col("p.j")
    blocks = keyed.join(hot, "key", "left").withColumn("cut", cut).withColumn("mine", mine).select("key", "node", "fp", "mine", F.explode(pairs).alias("p"))
    return _compared(blocks.select("key", cell.alias("cell"), F.when(F.col("mine") == F.col("p.i"), 0).otherwise(1).alias("side"), "node", "fp"), radius)


def _rooted(prints: DataFrame, radius: int, words: int) -> DataFrame:
    """(fp, first, root): each fingerprint's smallest id and the node of its component."""
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    if words == 1:
        classes = materialize(classes.withColumn("node", F.col("fp")), "simhash-classes")
        links = fingerprint_links(classes.select("fp"), radius)
    else:
        classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "simhash-classes")
        links = sampled_links(classes, radius, words)
    found = connected_components(links).withColumnsRenamed({"node": "__node"})
    return classes.join(found, F.col("node") == F.col("__node"), "left").select("fp", "first", F.coalesce("component", "node").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """One row per row of docs: id, fp (signed long, binary if words > 1), component (smallest id reachable)."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, words), "simhash")
    roots = _rooted(prints, radius, words)
    least = roots.groupBy("root").agg(F.min("first").alias("component"))
    of = materialize(roots.join(least, "root").select("fp", "component"), "simhash-of")
    return prints.join(of, "fp").select("id", "fp", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS_WIDE, shingle: int = SHINGLE_WIDE, words: int = WIDE) -> DataFrame:
    """The rows of docs that stay: one of each group, that with the smallest id.

    Rows are told apart by id and text: of rows that share an id, groups are still
    represented by one row each, the one with the smaller text hash; of rows that
    share both, one stays. Rows without an id cannot stand for a group nor be named
    as a copy, so all of them stay.
    """
    prints = materialize(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, words), "simhash")
    roots = _rooted(prints, radius, words)
    # the row that stands for each fingerprint, then for each group
    firsts = prints.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("row"))
    keep = materialize(firsts.join(roots.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.id").alias("__id"), F.col("row.th").alias("__th")).distinct(), "simhash-keep")
    marked = docs.withColumn("__at", F.xxhash64(F.col(text_col).cast("string")))
    same = (F.col(id_col).cast(id_type(docs, id_col)) == F.col("__id")) & (F.col("__at") == F.col("__th"))
    # the texts stay where they are while the list of rows that go is short enough to send round
    gone = prints.select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct().join(keep, ["__id", "__th"], "left_anti")
    gone = materialize(gone, "simhash-gone")
    if gone.count() <= GONE_ROWS:
        stay = marked.where(F.col(id_col).isNotNull()).join(F.broadcast(gone), same, "left_anti")
    else:
        stay = marked.join(keep, same, "left_semi")
    again = prints.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        stay = stay.dropDuplicates([id_col, "__at"])
    return stay.drop("__at").unionByName(docs.where(F.col(id_col).isNull()))
