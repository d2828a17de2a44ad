"""Keyed state with timers and joins of streams: replay, restart, late rows, equality with batch."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.operators import series
from zonepulse.streaming import ingest, stateful

REPORTS = "source string, number long, date date, cumulative long"


def day(k):
    return datetime.date(2024, 3, 1) + datetime.timedelta(k)


def watch(spark, path, rows, parts, quiet=2, late="30 days"):
    def run(stream):
        found = stateful.watched_reports(stream, quiet, late)
        return found.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    stateful.polled(rows, parts, f"{path}/landing", run)
    return sorted(map(tuple, spark.read.schema(stateful.ReportWatch.OUT).parquet(f"{path}/out").collect()), key=str)


def random_reports(spark, seed, sources=6, days=25):
    rng, rows = random.Random(seed), []
    for s in range(sources):
        total, number = 0, 0
        for d in range(days):
            if rng.random() < 0.7:
                total, number = total + rng.choice([0, 0, 0, 3]), number + 1
                rows.append((f"s{s}", number, day(d), total))
    return rows, spark.createDataFrame(rows, REPORTS).repartition(3)


def test_polls_and_one_poll_agree_and_restart_goes_on(spark, tmp_path):
    rows, df = random_reports(spark, 1)
    cut = [F.col("date") < day(8), (F.col("date") >= day(8)) & (F.col("date") < day(9)), F.col("date") >= day(9)]
    whole = watch(spark, f"{tmp_path}/one", df, [F.lit(True)])
    assert watch(spark, f"{tmp_path}/three", df, cut) == whole
    assert [r[:5] for r in whole if r[1] == "accepted"] == sorted(((r[0], "accepted", *r[1:]) for r in rows), key=str)
    # a slow version of what is quiet
    want = set()
    for source, mine in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        mine = list(mine)
        rises = [mine[0]] + [b for a, b in itertools.pairwise(mine) if b[3] > a[3]]
        for k, r in enumerate(rises):
            end = r[2] + datetime.timedelta(2)
            following = rises[k + 1][2] if k + 1 < len(rises) else datetime.date.max
            if following > end and any(x[2] > end for x in mine):
                before = [x for x in mine if x[2] <= end][-1]
                want.add((source, "quiet", before[1], end, before[3], r[2]))
    assert {r for r in whole if r[1] == "quiet"} == want and want


def test_a_replayed_poll_is_skipped(spark, tmp_path):
    rows, df = random_reports(spark, 2)
    twice = watch(spark, f"{tmp_path}/x", df, [F.lit(True), F.lit(True)])
    assert sum(r[1] == "accepted" for r in twice) == sum(r[1] == "skipped" for r in twice) == len(rows)
    assert [r for r in twice if r[1] != "skipped"] == watch(spark, f"{tmp_path}/y", df, [F.lit(True)])


def test_a_silent_source_is_raised_by_its_timer(spark, tmp_path):
    rows = [("a", 1, day(0), 5), ("b", 1, day(0), 1), ("b", 2, day(1), 2), ("b", 3, day(2), 3), ("b", 4, day(3), 4), ("b", 5, day(9), 5)]
    df = spark.createDataFrame(rows, REPORTS)
    got = watch(spark, tmp_path, df, [F.col("date") <= day(3), F.col("date") > day(3)], late="0 days")
    assert [r for r in got if r[1] == "quiet"] == [("a", "quiet", 1, day(2), 5, day(0)), ("b", "quiet", 4, day(5), 4, day(3))]


def test_days_without_increase_equal_the_batch(spark, tmp_path):
    rows, df = random_reports(spark, 3)
    got = watch(spark, tmp_path, df, [F.lit(True)])
    last = {}
    for source, kind, number, _, _, since in got:
        if kind == "accepted" and number > last.get(source, (0, None))[0]:
            last[source] = (number, since)
    none = spark.createDataFrame([], "source string, date date, increase long")
    batch = series.days_without_increase(none, df, day(30), ("source",)).collect()
    risen = {r["source"]: r["days"] for r in batch if r["basis"] == "history"}
    assert risen and all((day(30) - last[s][1]).days == n for s, n in risen.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_with_late_rows_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 3, 1)
    left = [(n, rng.choice("aab"), start + datetime.timedelta(minutes=rng.randint(0, 600)), rng.randint(0, 2)) for n in range(80)]
    right = [(n, rng.choice("aab"), start + datetime.timedelta(minutes=rng.randint(0, 600)), rng.randint(0, 2)) for n in range(80)]
    a = spark.createDataFrame(left, "l long, k string, t timestamp, part int")
    b = spark.createDataFrame(right, "r long, k string, u timestamp, part int")
    path = str(tmp_path)
    for number in range(3):
        for name, table in (("a", a), ("b", b)):
            table.where(F.col("part") == number).drop("part").write.parquet(f"{path}/{name}/{number}")
        s, u = (spark.readStream.schema(x.drop("part").schema).parquet(f"{path}/{n}/*") for n, x in (("a", a), ("b", b)))
        joined = stateful.interval_join(s, u, ["k"], "t", "u", "60 MINUTES", "10 MINUTES")
        joined.writeStream.format("parquet").outputMode("append").option("path", f"{path}/pairs").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
        for n, x, time in (("a", s, "t"), ("b", u, "u")):
            stateful.kept_late(x, time, "10 MINUTES", f"{path}/late-{n}", f"{path}/cp-{n}").awaitTermination()
    late_a, late_b = (spark.read.schema(x.drop("part").schema).parquet(f"{path}/late-{n}") for n, x in (("a", a), ("b", b)))
    more = stateful.late_pairs(a.drop("part"), b.drop("part"), late_a, late_b, ["k"], "t", "u", "60 MINUTES")
    streamed = {(r["l"], r["r"]) for r in spark.read.parquet(f"{path}/pairs").collect()}
    added = {(r["l"], r["r"]) for r in more.collect()}
    want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and datetime.timedelta(0) <= x[2] - y[2] <= datetime.timedelta(hours=1)}
    assert streamed | added == want and streamed < want
    for table, rows, time in ((late_a, left, "t"), (late_b, right, "u")):
        marks = [max(r[2] for r in rows if r[3] < n) - datetime.timedelta(minutes=10) for n in (1, 2)]
        assert table.count() == sum(r[3] > 0 and r[2] <= marks[r[3] - 1] for r in rows) > 0


def test_rows_of_one_batch_in_many_files_keep_their_order(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 3).alias("v"), "id").repartition(6)
    ingest.split_publish(F.lit(True), f"{path}/table", f"{path}/held", "s", F.col("id"))(rows, 0)
    assert {r["k"]: r["id"] for r in ingest.current(spark, f"{path}/table", ["k"]).collect()} == {k: max(n for n in range(1000) if n % 7 == k) for k in range(7)}
    assert isinstance(rows.schema["v"].dataType, T.LongType)
