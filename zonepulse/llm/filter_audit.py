"""Audit of how text filters interact: what each order of five filters removes, where and whom.

The filters (words: maximal runs without space, tab, line feed to carriage return):

* A: under 100 words; B: under 80 different words of 100; C: over 10 capitals A-Z of
  100 code points; D: holds one of ``#$%&*|``;
* E: the same text as a row with a smaller id, anywhere in the table.

A row is then one number, the set of filters that it fails, and everything else is
known before any row is read: ``FIRST`` gives for each of 32 sets and 120 orders the
step that removes it. Tasks look their rows up there, sum them by ``np.bincount`` and
return one array a part, which are added up.

Texts never move: a row is shuffled as its id, a SHA-256 of the text, four filter
bits and the part. Rows of one text differ in id, part and labels alone, so they are
counted by text, part and labels before they meet; that is how a text which stands
in a third of all rows, in however many tasks, comes down to a few counts.

Edge cases: a null text is empty and fails A alone (and E behind another empty one).
A null part is the empty string. A row with a null id has no smaller id before it
and stands before none; rows that share an id and the smallest one of their text
all pass E. Of several label rows of an id, one with 1 is enough; rows without
labels are neither good nor toxic. Without rows the result is empty. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts that a task sums at once: six arrays of 600 numbers each.
PARTS_AT_ONCE = 64


def first_failures() -> np.ndarray:
    """FIRST[set, order]: the step (0 to 4) at which the order removes a row that fails the set (bit k: filter k), 5 if it stays."""
    place = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(32)[:, None, None] >> place[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), 5)


FIRST = first_failures()
#: LETTER[order, step]: the filter of the step.
LETTER = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: LATE[set, order, step]: whether the set fails the step's filter but went before it; LONE[set, order, step]: whether it fails that filter only.
LATE = (((np.arange(32)[:, None, None] >> LETTER[None]) & 1) == 1) & (np.arange(5)[None, None] > FIRST[:, :, None])
LONE = np.arange(32)[:, None, None] == (1 << LETTER)[None]


def failed_bits(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    points = F.length(text).cast("long")
    capitals = points - F.length(F.translate(text, CAPITALS, ""))
    tests = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * n,
        100 * capitals > MAX_CAPITALS * points,
        text.rlike(MARKS),
    ]
    return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))


def failure_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, failed, good, toxic, n): how many rows of a part and label fail just the filters of ``failed``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), failed_bits(text).alias("failed"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    is_one = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    counted = rows.groupBy("id", "digest", "failed", "part").count()
    counted = counted.join(marks, "id", "left").na.fill({"good": 0, "toxic": 0})
    keys = ["digest", "failed", "part", "good", "toxic"]
    named = F.col("id").isNotNull()
    alike = counted.groupBy(*keys).agg(
        F.sum("count").alias("n"),
        F.min(F.when(named, F.struct("id", "count"))).alias("least"),
        F.sum(F.when(named, 0).otherwise(F.col("count"))).alias("unnamed"),
    )
    # a few rows a text: one for each part and label that it has
    first = F.min("least.id").over(Window.partitionBy("digest"))
    pass_e = F.col("unnamed") + F.when(F.col("least.id") == first, F.col("least.count")).otherwise(0)
    alike = alike.withColumn("pass_e", pass_e)
    e = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("failed").alias("failed"), F.col("pass_e").alias("n")), F.struct((F.col("failed") + e).alias("failed"), (F.col("n") - F.col("pass_e")).alias("n")))
    return alike.select("part", "good", "toxic", F.inline(both)).where("n > 0").select("part", "failed", "good", "toxic", "n")


def _sums(part: np.ndarray, failed: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, parts: int) -> list[np.ndarray]:
    """(kept, removed, redundant, unique_fails, good_lost, toxic_lost), each of [part, order, step]."""
    order = np.arange(len(ORDERS))
    at = ((part[:, None] * len(ORDERS) + order) * 6 + FIRST[failed]).ravel()

    def lost(weight: np.ndarray) -> np.ndarray:
        # float64 sums of integers are exact below 2^53; one batch holds far less
        return np.bincount(at, np.repeat(weight, len(ORDERS)), parts * len(ORDERS) * 6).reshape(parts, len(ORDERS), 6).astype(np.int64)

    all_lost = lost(n)
    sets = np.bincount(part * 32 + failed, n, parts * 32).reshape(parts, 32).astype(np.int64)
    kept = sets.sum(1)[:, None, None] - np.cumsum(all_lost[:, :, :5], axis=2)
    late, lone = (np.tensordot(sets, table.astype(np.int64), 1) for table in (LATE, LONE))
    return [kept, all_lost[:, :, :5], late, lone, lost(n * good)[:, :, :5], lost(n * toxic)[:, :, :5]]


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def partial_arrays(sets: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts) of each task's rows, zeros included."""

    def rows(names: list[str], sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, name in enumerate(names):
            size = len(ORDERS) * 5
            columns = [pa.array([name] * size, pa.string()), pa.array(np.repeat(np.arange(len(ORDERS)), 5), pa.int32()), pa.array(np.tile(np.arange(1, 6), len(ORDERS)), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(s[k].ravel(), pa.int64()) for s in sums], ["part", "place", "step", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        totals = [np.zeros((PARTS_AT_ONCE, len(ORDERS), 5), np.int64) for _ in COUNTS]
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                coded = batch.column(0).dictionary_encode()
                names, local = coded.dictionary.to_pylist(), np.asarray(coded.indices)
                failed, good, toxic, n = (np.asarray(batch.column(k)).astype(np.int64) for k in (1, 2, 3, 4))
                for low in range(0, len(names), PARTS_AT_ONCE):
                    some = names[low : low + PARTS_AT_ONCE]
                    if len(known.keys() | some) > PARTS_AT_ONCE:
                        yield from rows(list(known), totals)
                        known = {}
                        for total in totals:
                            total[:] = 0
                    mine = (local >= low) & (local < low + len(some))
                    where = [known.setdefault(name, len(known)) for name in some]
                    for total, s in zip(totals, _sums(local[mine] - low, failed[mine], n[mine], good[mine], toxic[mine], len(some)), strict=True):
                        total[where] += s
        yield from rows(list(known), totals)

    schema = "part string, place int, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return sets.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    shapley sums what the step's filter removes over all orders: divided by 120 it is the
    filter's Shapley value for the number of removed rows.
    """
    partial = partial_arrays(failure_sets(docs, labels, id_col, text_col, part_col))
    summed = partial.groupBy("part", "place", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    orders = F.array(*[F.lit(o) for o in ORDERS])
    named = summed.withColumn("filter_order", F.element_at(orders, F.col("place") + 1))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shapley = F.sum("removed").over(Window.partitionBy("part", letter))
    return named.withColumn("shapley", shapley).select("part", "filter_order", "step", *COUNTS, "shapley")
