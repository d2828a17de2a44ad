"""Keyed state and timers over report streams, and joins of two streams within a time span."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: State of keyed operators lives in RocksDB files beside the checkpoint, not on the heap.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 86_400_000
_EPOCH = datetime.date(1970, 1, 1)


class ReportWatch(StatefulProcessor):
    """What a source has reported last, and how long its number has not risen.

    Rows of a source come as (number, date, cumulative). One whose number is not above the
    last accepted is skipped, so repeated and older reports change nothing. A rise of
    the cumulative number sets ``since``; when ``quiet_days`` more have ended, a timer raises ``quiet``
    once, whether the next report comes in time, late or never: a report that finds its
    predecessor's time run out raises what the timer would have. The result does
    not depend on how rows fall into batches, as long as each source's numbers rise.
    """

    OUT = "source string, kind string, number long, date date, cumulative long, since date"

    def __init__(self, quiet_days: int):
        self.quiet_days = quiet_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "number long, cumulative long, since int, raised boolean")

    def _due(self, since: int) -> int:
        # the end of the last quiet day: reports of that day count until the watermark is past it
        return (since + self.quiet_days + 1) * DAY_MS

    def _row(self, key, kind: str, number: int | None, day: int, cumulative: int | None, since: int | None) -> tuple:
        date = lambda d: None if d is None else _EPOCH + datetime.timedelta(days=int(d))
        return (key[0], kind, number, date(day), cumulative, date(since))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["source", "kind", "number", "date", "cumulative", "since"])
        return frame.astype({"number": "Int64", "cumulative": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a source's reports of one batch: some a day, in the order of their numbers
        batch = pd.concat(list(rows)).sort_values(["number", "cumulative"], kind="stable")
        state = self.last.get() if self.last.exists() else None
        number, cumulative, since, raised = state if state else (None, None, None, False)
        timer = None if since is None or raised else self._due(since)
        out, armed = [], timer
        for n, date, c in zip(batch["number"].tolist(), batch["date"].tolist(), batch["cumulative"].tolist(), strict=True):
            day = (date - _EPOCH).days
            if number is not None and n <= number:
                out.append(self._row(key, "skipped", n, day, c, None))
                continue
            if since is not None and not raised and day > since + self.quiet_days:
                out.append(self._row(key, "quiet", number, since + self.quiet_days, cumulative, since))
                raised = True
            if cumulative is None or c > cumulative:
                since, raised = day, False
            number, cumulative = n, c
            out.append(self._row(key, "accepted", n, day, c, since))
        timer = None if since is None or raised else self._due(since)
        if timer != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.last.update((number, cumulative, since, raised))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, cumulative, since, raised = self.last.get()
        out = []
        if not raised and expiredTimerInfo.getExpiryTimeInMs() == self._due(since):
            out = [self._row(key, "quiet", number, since + self.quiet_days, cumulative, since)]
            self.last.update((number, cumulative, since, True))
        yield self._frame(out)

    def close(self) -> None:
        pass


def watched_reports(reports: DataFrame, quiet_days: int, late: str = "0 days") -> DataFrame:
    """(source, kind, number, date, cumulative, since) of a stream with source, number, date and cumulative.

    kind is accepted, skipped or quiet; since is the day of the last rise.
    """
    reports.sparkSession.conf.set(*STORE)
    told = reports.select(F.col("source").cast("string").alias("source"), F.col("number").cast("long").alias("number"), "date", F.col("cumulative").cast("long").alias("cumulative"), F.col("date").cast("timestamp").alias("at"))
    return told.withWatermark("at", late).groupBy("source").transformWithStateInPandas(ReportWatch(quiet_days), ReportWatch.OUT, "Append", "EventTime")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before: str, late: str) -> DataFrame:
    """Pairs of two streams with equal keys whose right row is at most ``before`` older than the left one, and not newer.

    Both sides have watermarks, so state is held for ``before`` and ``late`` only. Columns other
    than the keys must differ by name. Rows behind the watermark are dropped here:
    ``kept_late`` keeps them, ``late_pairs`` joins them.
    """
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    span = [F.col(right_time) <= F.col(left_time), F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {before}")]
    test = same[0]
    for more in [*same[1:], *span]:
        test = test & more
    return a.join(b, test).drop(*[f"__{k}" for k in keys])


def kept_late(rows: DataFrame, time: str, late: str, into: str, checkpoint: str) -> StreamingQuery:
    """Write the rows of a stream that are at or behind its watermark to ``into``, a folder a batch.

    The watermark is the latest time of all earlier batches less ``late``, as the engine takes
    it; each batch's latest time is written beside, so a restart goes on where it
    stopped and a repeated batch writes the same folder again. With as many files a
    trigger as the join, no row that the join drops is missing: the join's watermark is
    the lesser of its two sides'.
    """
    spark = rows.sparkSession
    marks = f"{into}-marks"

    def keep(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema("batch long, latest timestamp").parquet(f"{marks}/*").where(F.col("batch") < number) if _exists(spark, marks) else None
        before = seen.agg(F.max("latest")).first()[0] if seen is not None else None
        old = F.lit(False) if before is None else F.coalesce(F.col(time) <= F.lit(before) - F.expr(f"INTERVAL {late}"), F.lit(False))
        batch.where(old).write.mode("overwrite").parquet(f"{into}/batch={number}")
        batch.agg(F.lit(number).cast("long").alias("batch"), F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{marks}/{number}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)  # noqa: SLF001


def late_pairs(left: DataFrame, right: DataFrame, late_left: DataFrame, late_right: DataFrame, keys: list[str], left_time: str, right_time: str, before: str) -> DataFrame:
    """The pairs of which at least one row came late, from the tables of all rows and of the late ones.

    A range join by time buckets of the span's width: each right row meets the left rows
    of its bucket and the next, so a pair is found by equality of keys and bucket.
    """

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        width = F.expr(f"CAST(unix_seconds(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {before}) AS DOUBLE)")
        bucket = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / 1e6 / width)
        l, r = a.withColumn("__b", bucket(left_time)), b.withColumn("__b", F.explode(F.array(bucket(right_time), bucket(right_time) + 1)))
        near = (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {before}"))
        return l.join(r, [*keys, "__b"]).where(near).drop("__b")

    return pairs(late_left, right).unionByName(pairs(left, late_right)).distinct()


def polled(rows: DataFrame, parts: list[Column], landing: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Land the rows of each test in turn, and after each let ``run`` take what is new: a poll a part, each from the checkpoint of the one before."""
    for number, test in enumerate(parts):
        rows.where(test).write.parquet(f"{landing}/{number:04d}")
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{landing}/*")).awaitTermination()
