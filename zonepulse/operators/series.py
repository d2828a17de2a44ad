"""Daily series from cumulative reports, windows, renewal sums and runs.

A series has one row per report or day and is small against flows; windows are
partitioned by the series' keys where there are several series.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_reports(reports: DataFrame, date: str = "date", value: str = "cumulative", pos: str = "pos") -> DataFrame:
    """Reports with a date and cases, one per date: the highest cumulative, ties to the later row."""
    held = reports.where(F.col(date).isNotNull() & (F.col(value) > 0))
    best = held.groupBy(date).agg(F.max_by(F.struct(*[c for c in reports.columns if c != date]), F.struct(value, pos)).alias("r"))
    return best.select(date, "r.*")


def daily(reports: DataFrame, keys: tuple[str, ...] = (), date: str = "date", value: str = "cumulative", label: str = "report_no") -> DataFrame:
    """One row per day: increments of cumulative reports, spread evenly over gaps.

    Decreases count as 0; the first report's incidence is its cumulative value; the
    label stays on the last day of a gap only.
    """
    order = W.partitionBy(*keys).orderBy(date)
    rows = reports.withColumn("__pd", F.lag(date).over(order)).withColumn("__pv", F.lag(value).over(order))
    gap = F.datediff(date, "__pd")
    rows = rows.withColumn("__gap", F.coalesce(gap, F.lit(1))).withColumn("__inc", F.when(F.col("__pd").isNull(), F.col(value)).otherwise(F.greatest(F.lit(0), F.col(value) - F.col("__pv"))))
    days = F.when(F.col("__pd").isNull(), F.array(F.col(date))).otherwise(F.sequence(F.date_add("__pd", 1), F.col(date)))
    spread = rows.select(*keys, F.explode(days).alias("__day"), F.col(date).alias("__end"), (F.col("__inc") / F.col("__gap")).alias("incidence"), F.col(value).alias("__v"), F.coalesce("__pv", F.lit(0)).alias("__from"), "__pd", "__gap", F.col(label).alias("__label"))
    done = F.when(F.col("__pd").isNull(), F.lit(0)).otherwise(F.datediff("__day", "__pd"))
    cumulative = F.when(F.col("__pd").isNull(), F.col("__v")).otherwise(F.col("__from") + F.col("incidence") * done)
    return spread.select(*keys, F.col("__day").alias("date"), "incidence", cumulative.cast("double").alias("cumulative"), F.when(F.col("__day") == F.col("__end"), F.col("__label")).alias("report_no"))


def windows(days: DataFrame, day: datetime.date | str, width: int = 7) -> DataFrame:
    """Recent and previous window sums, their ratio, and a status instead of an infinite ratio."""
    d = F.lit(day).cast("date")
    part = lambda a, b: F.coalesce(F.sum(F.when((F.col("date") > F.date_sub(d, a)) & (F.col("date") <= F.date_sub(d, b)), F.col("incidence"))), F.lit(0.0))
    rows = days.agg(part(width, 0).alias("recent"), part(2 * width, width).alias("previous"))
    status = F.when(F.col("previous") > 0, "ratio").when(F.col("recent") > 0, "infinite").otherwise("none")
    return rows.withColumn("ratio", F.try_divide("recent", F.nullif("previous", F.lit(0.0)))).withColumn("status", status)


def generation_weights(spark: SparkSession, mean: float, sd: float, lags: int = 40) -> DataFrame:
    """(lag, weight): gamma density at lag - 0.5, normalised; its constant cancels."""
    shape, scale = (mean / sd) ** 2, sd * sd / mean
    x = F.col("lag") - 0.5
    raw = spark.range(1, lags + 1).select(F.col("id").cast("int").alias("lag")).withColumn("raw", F.exp((shape - 1) * F.log(x) - x / scale))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("lag", (F.col("raw") / F.col("total")).alias("weight"))


def renewal(days: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``pressure``: the weighted sum of earlier incidence.

    Each day sends its incidence to the days that follow by the lags (a bounded
    fan-out), and the receiving days add it up: one shuffle, no range join.
    """
    held = days.select(*keys, "date", F.greatest(F.lit(0.0), F.col("incidence")).alias("__i"))
    sent = held.crossJoin(F.broadcast(weights)).select(*keys, F.date_add("date", F.col("lag")).alias("date"), (F.col("__i") * F.col("weight")).alias("__p"))
    sums = sent.groupBy(*keys, "date").agg(F.sum("__p").alias("pressure"))
    return days.join(sums, [*keys, "date"], "left").withColumn("pressure", F.coalesce("pressure", F.lit(0.0)))


def trailing(days: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The last n days, but never the first day of a series."""
    order = W.partitionBy(*keys)
    rows = days.withColumn("__back", F.row_number().over(order.orderBy(F.desc("date")))).withColumn("__at", F.row_number().over(order.orderBy("date")))
    return rows.where((F.col("__back") <= n) & (F.col("__at") > 1)).drop("__back", "__at")


def zero_run(days: DataFrame, length: int, keys: tuple[str, ...] = (), value: str = "incidence") -> DataFrame:
    """(keys, start): the first day of the first run of at least ``length`` zero days."""
    order = W.partitionBy(*keys).orderBy("date")
    runs = days.withColumn("__g", F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).over(order)).where(F.col(value) == 0)
    found = runs.groupBy(*keys, "__g").agg(F.min("date").alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= length)
    return found.groupBy(*keys).agg(F.min("start").alias("start")) if keys else found.agg(F.min("start").alias("start"))


def days_without_increase(increments: DataFrame, history: DataFrame, day: datetime.date | str, keys: tuple[str, ...]) -> DataFrame:
    """Per key the days since the last increase and on what basis.

    increments: (keys, date, increase); history: (keys, date, cumulative). The last
    positive increment counts, else the last rise of the history, else the span of
    the history, else it is unknown.
    """
    d = F.lit(day).cast("date")
    inc = increments.where(F.col("date") <= d).groupBy(*keys).agg(F.max(F.when(F.col("increase") > 0, F.col("date"))).alias("__i"))
    rose = history.where(F.col("date") <= d).withColumn("__p", F.lag("cumulative").over(W.partitionBy(*keys).orderBy("date")))
    hist = rose.groupBy(*keys).agg(F.max(F.when(F.col("cumulative") > F.col("__p"), F.col("date"))).alias("__h"), F.min("date").alias("__f"))
    out = inc.join(hist, list(keys), "full_outer")
    basis = F.when(F.col("__i").isNotNull(), "daily").when(F.col("__h").isNotNull(), "history").when(F.col("__f").isNotNull(), "span").otherwise("unknown")
    return out.select(*keys, F.datediff(d, F.coalesce("__i", "__h", "__f")).alias("days"), basis.alias("basis"))


def selected(rows: DataFrame, day: datetime.date | str) -> DataFrame:
    """Adds ``is_selected``: the latest row on or before the day."""
    past = rows.agg(F.max(F.when(F.col("date") <= F.lit(day).cast("date"), F.col("date"))).alias("__s"))
    return rows.crossJoin(F.broadcast(past)).withColumn("is_selected", F.coalesce(F.col("date") == F.col("__s"), F.lit(False))).drop("__s")


