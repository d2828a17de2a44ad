"""As-of rows of every left row against a slow version; hot keys, ties, nulls, empty sides."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from zonepulse.operators import asof

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + datetime.timedelta(minutes=minutes)


def slow(left, right, within=None, else_first=False):
    out = []
    for key, t, n in left:
        mine = [r for r in right if r[0] == key and key is not None and r[1] is not None]
        found = None
        if t is not None:
            past = [r for r in mine if r[1] <= t and (within is None or r[1] + within >= t)]
            found = max(past, key=lambda r: (r[1], r[2])) if past else None
            if found is None and else_first and mine:
                found = min(mine, key=lambda r: (r[1], r[2]))
        out.append((n, found and found[2]))
    return sorted(out, key=str)


def found(spark, left, right, partitions, keys=("key",), **options):
    a = spark.createDataFrame([(k, at(t), n, "x") for k, t, n in left], "key string, t timestamp, n long, matched_by string")
    b = spark.createDataFrame([(k, at(t), n) for k, t, n in right], "key string, t timestamp, n long")
    rows = asof.asof_join(a.repartition(3), b.repartition(3), list(keys), "t", "t", order=["n"], partitions=partitions, **options)
    assert rows.columns == [*a.columns, "matched"]
    return sorted(((r["n"], r["matched"] and r["matched"]["n"]) for r in rows.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("else_first", [False, True])
def test_asof_equals_slow_version(spark, partitions, else_first):
    rng = random.Random(partitions)
    keys = ["a"] * 12 + ["b", "c", "d", None]
    left = [(rng.choice(keys), rng.choice([None, *range(60)]), n) for n in range(400)] + [("e", 5, 400), ("e", 5, 400)]
    right = [(rng.choice(keys[:14] + [None]), rng.choice([None, *range(5, 60)]), n) for n in range(90)] + [("f", 3, 90)]
    assert found(spark, left, right, partitions, else_first=else_first) == slow(left, right, else_first=else_first)


def test_tolerance_and_no_keys(spark):
    rng = random.Random(4)
    left, right = ([(None, rng.randint(0, 500), n) for n in range(size)] for size in (300, 12))
    want = slow([("k", *r[1:]) for r in left], [("k", *r[1:]) for r in right])
    assert found(spark, left, right, 9, keys=()) == want
    close = slow([("k", *r[1:]) for r in left], [("k", *r[1:]) for r in right], within=20)
    assert found(spark, left, right, 9, keys=(), within="INTERVAL 20 MINUTES") == close


def test_empty_sides(spark):
    assert found(spark, [], [("a", 1, 1)], 3) == []
    assert found(spark, [("a", 1, 1), (None, None, 2)], [], 3, else_first=True) == [(1, None), (2, None)]


def test_a_hot_key_is_cut_into_several_tasks(spark):
    """One key holds all rows, a third of them at one instant, and its only right row stands in the first task."""
    left = spark.range(60_000).select(F.lit("hot").alias("key"), (F.lit(START) + F.make_interval(mins=F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("int"))).alias("t"), "id")
    right = spark.createDataFrame([("hot", at(0), 5)], "key string, t timestamp, n long")
    sizes = []
    kept = asof.materialize

    def seen(df, label):
        out = kept(df, label)
        sizes.extend(r["count"] for r in out.groupBy("__p").count().collect())
        return out

    asof.materialize = seen
    try:
        rows = asof.asof_join(left, right, ["key"], "t", "t", partitions=12)
        assert rows.where("matched.n = 5").count() == 60_000
    finally:
        asof.materialize = kept
    assert len(sizes) >= 10 and max(sizes) < 60_000 / 4
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(key") == 0
