"""The source of landed reports, flows by month, sketches, collations and documents of unknown fields."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from zonepulse.operators import keys, mobility, publish, sketches
from zonepulse.plans import registry
from zonepulse.sources import landed

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "number long, date date, cases long, share double, note string, extra string"


def land(folder, number, rows):
    os.makedirs(f"{folder}/number={number}", exist_ok=True)
    with open(f"{folder}/number={number}/part-{len(rows)}.json", "w") as f:
        f.write("\n".join(map(json.dumps, rows)))


def test_landed_reports_in_a_batch_and_a_stream(spark, tmp_path):
    landed.register(spark)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    land(folder, 1, [{"date": "2024-01-01", "cases": 5, "share": 0.5, "note": "é"}, {"date": "bad", "cases": "x", "share": 1, "note": {"a": 1}, "unknown": 2}])
    land(folder, 10, [{"cases": 7}])
    os.makedirs(f"{folder}/number=11/_temporary")
    for hidden in ("number=11/_temporary/part-0.json", "number=10/.part.crc", "number=10/_SUCCESS"):
        with open(f"{folder}/{hidden}", "w") as f:
            f.write("{")

    def batch(**options):
        return sorted((tuple(r) for r in spark.read.format("landed_reports").schema(SCHEMA).options(**options).load(folder).collect()), key=str)

    first = (1, datetime.date(2024, 1, 1), 5, 0.5, "é", None)
    assert batch() == sorted([first, (1, None, None, 1.0, '{"a": 1}', None), (10, None, 7, None, None, None)], key=str)
    assert batch(newerThan=1) == [(10, None, 7, None, None, None)] and batch(newerThan=10) == []
    assert spark.read.format("landed_reports").schema(SCHEMA).option("filesPerPartition", 1).load(folder).rdd.getNumPartitions() == 2

    def poll():
        stream = spark.readStream.format("landed_reports").schema(SCHEMA).load(folder)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["number"] for r in spark.read.schema(SCHEMA).parquet(out).collect())

    assert poll() == [1, 1, 10] and poll() == [1, 1, 10]
    # an older report landed late, a newer one, and more lines of a report that was read
    land(folder, 4, [{"cases": 1}])
    land(folder, 12, [{"cases": 2}])
    land(folder, 10, [{"cases": 1}, {"cases": 2}])
    assert poll() == [1, 1, 10, 12]
    assert spark.read.format("landed_reports").schema(SCHEMA).load(f"{tmp_path}/none").count() == 0


def test_flows_of_months_read_their_partitions_only(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    t = registry.Source(spark, SF)
    flows = t.monthly_flows()
    asked = spark.createDataFrame([("1995-03", 1), ("1996-07", 1), (None, 1), ("1999-01", 0)], "month string, wanted int")
    found = mobility.of_months(flows, asked.where("wanted = 1").select("month"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "PartitionFilters: [isnotnull(month" in plan
    assert {r["month"] for r in found.select("month").distinct().collect()} <= {"1995-03", "1996-07"} and found.count() > 0
    # a literal month is a partition filter too
    one = flows.where("month = '1995-03'")
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().executedPlan().toString() and one.count() == t.flows.where("month = '1995-03'").count()


def test_sketches_merge_within_their_bound(spark):
    rng = random.Random(1)
    rows = [(f"m{k % 12}", rng.choice([rng.gauss(0, 1), rng.expovariate(0.01), 7.0])) for k in range(60_000)] + [("m0", None), ("m0", float("nan"))]
    df = spark.createDataFrame(rows, "month string, v double").repartition(8)
    months = sketches.sketched(df, ["month"], "v", 200)
    shares = [0.01, 0.2, 0.4, 0.6, 0.8, 0.99]
    for ranged, names in ((months, None), (sketches.merged(months.where("month in ('m1', 'm2', 'm3')").withColumn("month", F.lit("q")), ["month"], 200), ("m1", "m2", "m3")), (sketches.merged(months.withColumn("month", F.lit("all")), ["month"], 200), tuple(f"m{k}" for k in range(12)))):
        for r in ranged.withColumn("q", sketches.quantiles(shares)).withColumn("at7", sketches.rank_of(F.lit(7.0))).collect():
            held = sorted(v for m, v in rows if (m == r["month"] if names is None else m in names) and v is not None and v == v)
            assert r["n"] == len(held)
            for share, value in zip(shares, r["q"], strict=True):
                low, high = sum(v < value for v in held) / len(held), sum(v <= value for v in held) / len(held)
                assert low - sketches.rank_error(200) <= share <= high + sketches.rank_error(200)
            assert abs(r["at7"] - sum(v <= 7 for v in held) / len(held)) <= sketches.rank_error(200)


def test_grouping_sets_take_one_shuffle(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    from zonepulse.plans import layers

    df = layers.k4_grouping_sets(registry.Source(spark, SF))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("grouping") >= 1
    top = df._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert top.count("Exchange hashpartitioning") == 1


def test_collated_names_equal_stripped_ones(spark):
    names = ["Élan", "elan", " ELAN ", "ẻlan", "Elan-x", "ß", "ss", "", None, "Zoë"]
    df = keys.collated(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id int, name string"), "name")
    pairs = {(r["a"], r["b"]) for r in df.select(F.col("id").alias("a"), "name").join(df.select(F.col("id").alias("b"), "name"), "name").collect()}
    assert {(a, b) for a, b in pairs if a < b} >= {(0, 1), (0, 2), (1, 2), (0, 3)} and not any(4 in p and p != (4, 4) or 8 in p for p in pairs)
    assert df.where("name is not null").groupBy("name").count().where("count = 4").count() == 1


def test_fields_of_unknown_documents(spark):
    rows = [(1, '{"a": 1, "b": {"c": [1, 2]}, "n": null}', '{"a": null, "z": true, "b": "x"}'), (2, "[1]", '{"q": 1.5}'), (3, None, "{}"), (4, "not json", '{"a": "b"}')]
    got = sorted(map(tuple, publish.merged_fields(spark.createDataFrame(rows, "id int, own string, over string"), "id", "own", "over").collect()), key=str)
    assert got == sorted([(1, "a", "1"), (1, "b", "x"), (1, "n", None), (1, "z", "true"), (2, "q", "1.5"), (4, "a", "b")], key=str)
