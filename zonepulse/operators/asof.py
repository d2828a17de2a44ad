"""As-of lookups: those of one day as aggregations, those of every row as one sweep over both sides."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, StructField, StructType

from zonepulse.sources.shared import materialize


def _row(rows: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[c for c in rows.columns if c not in keys])


def latest_or_first(rows: DataFrame, keys: list[str], date_col: str, day: datetime.date | str) -> DataFrame:
    """Per key the latest row on or before the day, else the earliest row."""
    day = F.lit(day).cast("date")
    past = F.when(F.col(date_col) <= day, F.col(date_col))
    found = rows.groupBy(*keys).agg(F.coalesce(F.max_by(_row(rows, keys), past), F.min_by(_row(rows, keys), F.col(date_col))).alias("r"))
    return found.select(*keys, "r.*")


def latest_or_last(rows: DataFrame, date_col: str, day: datetime.date | str) -> DataFrame:
    """The exact or latest prior row of all rows, else the latest row."""
    day = F.lit(day).cast("date")
    past = F.when(F.col(date_col) <= day, F.col(date_col))
    return rows.agg(F.coalesce(F.max_by(F.struct(*rows.columns), past), F.max_by(F.struct(*rows.columns), F.col(date_col))).alias("r")).select("r.*")


def latest_metric(rows: DataFrame, metric: str, day: datetime.date | str, level: str | None = None, province: str | None = None, pos: str = "pos") -> DataFrame:
    """One row: the latest non-null value on or before the day; ties go to the last in file order."""
    held = rows.where(F.col(metric).isNotNull() & (F.col("date") <= F.lit(day).cast("date")))
    if level is not None:
        held = held.where(F.col("admin_level") == level)
    if province is not None:
        held = held.where(F.col("province") == province)
    best = F.max_by(F.struct("date", "province", "admin_level", F.col(metric).alias("value")), F.struct("date", pos))
    return held.agg(best.alias("r")).select("r.date", "r.province", F.col("r.admin_level").alias("source_level"), "r.value")


def baseline_date(rows: DataFrame, date_col: str, day: datetime.date | str, back: int = 7) -> DataFrame:
    """One row: the latest date at least ``back`` days before the day, else the first date."""
    limit = F.date_sub(F.lit(day).cast("date"), back)
    return rows.agg(F.coalesce(F.max(F.when(F.col(date_col) <= limit, F.col(date_col))), F.min(date_col)).alias("baseline"))


def increase(rows: DataFrame, day: datetime.date | str, back: int = 7, key: Column | None = None) -> DataFrame:
    """Rows of the day with the increase since the baseline, never below 0.

    The key is the zone id, else name and province; zones missing at the baseline
    count from 0.
    """
    key = F.coalesce("zone_id", F.concat_ws("|", F.lower("health_zone"), F.lower("province"))) if key is None else key
    keyed = rows.withColumn("__key", key)
    base = keyed.join(F.broadcast(baseline_date(rows, "date", day, back)), F.col("date") == F.col("baseline")).select("__key", F.col("confirmed_cases").alias("__c"), F.col("confirmed_deaths").alias("__d"))
    now = keyed.where(F.col("date") == F.lit(day).cast("date")).join(base, "__key", "left")
    up = lambda a, b: F.greatest(F.lit(0), F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    return now.select("zone_id", "health_zone", "province", F.col("confirmed_cases").alias("cumulative_cases"), up(F.col("confirmed_cases"), F.col("__c")).alias("recent_cases"), up(F.col("confirmed_deaths"), F.col("__d")).alias("recent_deaths"))


LEFT, RIGHT = 1, 0


def _carry(keys: list[str]):
    """Arrow pass over rows sorted by keys and time: each row with the last right row of its key before it.

    Only the last right row of a batch is held for the next; ``__open`` marks rows whose
    key the partition began with and that no right row precedes there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            carried = held is not None
            rows = pa.Table.from_batches([held, batch] if carried else [batch]).combine_chunks()
            n = rows.num_rows
            new = np.ones(n, bool)
            new[1:] = False
            for name in keys:
                column = rows.column(name)
                new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, n - 1)))
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            right = np.asarray(rows.column("__side")) == RIGHT
            last = np.maximum.accumulate(np.where(right, np.arange(n), -1))
            known = last >= begin
            key = [rows.column(name) for name in keys]
            if first is None:
                first = [c[0] for c in key]
            same = np.asarray(pc.fill_null(functools.reduce(pc.and_, [pc.equal(c, f) for c, f in zip(key, first, strict=True)]), False)) if keys else np.ones(n, bool)
            found = rows.column("__right").take(pa.array(np.where(known, last, 0), mask=~known))
            out = rows.set_column(rows.schema.get_field_index("__right"), "__right", found).append_column("__open", pa.array(same & ~known))
            yield from out.slice(1 if carried else 0).to_batches()
            held = rows.slice(int(last[-1]) if known[-1] else n - 1, 1).to_batches()[0]

    return run


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: list[str] | None = None, within: str | None = None, else_first: bool = False, partitions: int | None = None
) -> DataFrame:
    """left with ``matched``: the latest right row of equal keys at or before the row's time.

    Both sides are united and range-partitioned by keys and time, so a key with very
    many rows is cut into several tasks, each of about the same size. A task carries the
    last right row on from row to row; what it ends with is handed to the tasks behind
    it, one row a task. One shuffle, no self-join.

    Of right rows with equal keys and time, the greatest by ``order`` counts. ``within`` is an
    interval (``INTERVAL 3 DAYS``) beyond which a right row is too old. else_first: rows
    before the first right row of their key take that one. Keys of several columns
    match like SQL equality: nulls match nothing. Rows without a time match nothing.
    Without keys the whole right side is one key. Repeated left rows stay.
    """
    order, names = order or [], [f"__k{n}" for n in range(len(keys))]
    whole = lambda rows: F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    usable = lambda time: functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col(time).isNotNull())
    named = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    ties = [f"__o{n}" for n in range(len(order))]
    rows = left.where(usable(left_time)).select(
        *named, F.col(left_time).cast("timestamp").alias("__t"), F.lit(LEFT).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(o) for c, o in zip(order, ties, strict=True)],
        F.lit(None).cast(right.schema).alias("__right"), whole(left).alias("__left"),
    )
    given = right.where(usable(right_time)).select(
        *named, F.col(right_time).cast("timestamp").alias("__t"), F.lit(RIGHT).alias("__side"), *[F.col(c).alias(o) for c, o in zip(order, ties, strict=True)],
        whole(right).alias("__right"), F.lit(None).cast(left.schema).alias("__left"),
    )
    # the hash lets rows of one key and instant stand in several tasks
    place = [*names, "__t", "__side", *ties, "__h"]
    both = rows.unionByName(given).withColumn("__h", F.xxhash64("__left", "__right"))
    both = both.repartitionByRange(partitions, *place) if partitions else both.repartitionByRange(*place)
    # tasks are numbered in the order of their ranges
    both = both.sortWithinPartitions(*place).select(*place, "__right", "__left", F.spark_partition_id().alias("__p"))
    swept = materialize(both.mapInArrow(_carry(names), StructType([*both.schema.fields, StructField("__open", BooleanType())])), "asof")
    # what a task ends with, and whether it began in the middle of a key: two rows a task, met by key in the order of tasks
    ends = swept.groupBy("__p").agg(F.max_by(F.struct(*names, "__right"), F.struct(*place)).alias("e")).select("__p", F.lit(1).alias("__end"), "e.*")
    heads = swept.where("__open").select("__p", F.lit(0).alias("__end"), *names, F.lit(None).cast(right.schema).alias("__right")).distinct()
    earlier = W.partitionBy(*names).orderBy("__p", "__end").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.unionByName(heads).withColumn("__handed", F.last("__right", ignorenulls=True).over(earlier)).where("__end = 0").select("__p", "__handed")
    found = swept.where(F.col("__side") == LEFT).join(F.broadcast(handed), "__p", "left")
    match = F.when(F.col("__open"), F.col("__handed")).otherwise(F.col("__right"))
    if within:
        match = F.when(match[right_time].cast("timestamp") + F.expr(within) >= F.col("__t"), match)
    found = found.select(*names, "__left", match.alias("matched"))
    if else_first:
        firsts = given.groupBy(*names).agg(F.min_by("__right", F.struct("__t", *ties)).alias("__first"))
        open_ = found.where("matched is null").drop("matched")
        open_ = open_.join(firsts, names, "left") if names else open_.crossJoin(F.broadcast(firsts))
        found = found.where("matched is not null").unionByName(open_.withColumnRenamed("__first", "matched"))
    rest = left.where(~usable(left_time)).withColumn("matched", F.lit(None).cast(right.schema))
    return found.select("__left.*", "matched").unionByName(rest)
