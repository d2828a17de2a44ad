"""The dashboard's layers as one tall table, and its numbers, rankings and trends.

A layer row is (layer, month, place, place_name, province, value, incoming, extra,
is_capital, is_border): what a layer shows of a place in a month. All layers that
depend on flows come from one aggregation of flows by month and destination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonepulse.functions.text import province_key
from zonepulse.operators.mobility import air_factor, contact_multiplier

COLUMNS = ("layer", "month", "place", "place_name", "province", "value", "incoming", "extra", "is_capital", "is_border")


def sums(flows: DataFrame, affected: DataFrame, contacts: DataFrame, day: str) -> DataFrame:
    """(month, destination_id, total, incoming, arrivals, score, adjusted): one pass over flows.

    total is the movement of all origins, arrivals that of affected ones, incoming that
    of affected origins on edges with movement; scores weigh incoming by cases at the
    origin, adjusted also by the shortfall of contact follow-up.
    """
    factors = contact_multiplier(contacts, day)
    origin = affected.withColumn("province_key", province_key(F.col("province"))).join(factors, "province_key", "left")
    origin = origin.select(F.col("zone_id").alias("__o"), F.col("confirmed_cases").alias("__c"), F.coalesce("multiplier", F.lit(1.0)).alias("__m"))
    edges = flows.join(origin, flows["origin_id"] == origin["__o"], "left")
    known, moved = F.col("__o").isNotNull(), (F.col("movement") > 0) & (F.col("__c") > 0)
    weight = F.when(moved, F.col("__c") * F.col("movement"))
    zero = F.lit(0)
    return edges.groupBy("month", "destination_id").agg(
        F.sum("movement").alias("total"), F.coalesce(F.sum(F.when(moved, F.col("movement"))), zero).alias("incoming"), F.coalesce(F.sum(F.when(known, F.col("movement"))), zero).alias("arrivals"),
        F.coalesce(F.sum(weight), zero).alias("score"), F.coalesce(F.sum(weight * F.col("__m")), F.lit(0.0)).alias("adjusted"),
    )


def forecast(found: DataFrame, recent: int = 3) -> DataFrame:
    """found with ``ahead`` and ``ahead_incoming``: each month's values are the next month's, the last month's the mean of the last ones.

    Scores are linear in movement, so the basis needs no second pass over flows.
    """
    months = found.select("month").distinct()
    order = months.withColumn("__next", F.lead("month").over(W.orderBy("month"))).withColumn("__place", F.row_number().over(W.orderBy(F.desc("month"))))
    last = order.where(F.col("__place") == 1).select(F.col("month").alias("__to")).crossJoin(F.broadcast(order.where(F.col("__place") <= recent).select("month")))
    basis = order.where("__next is not null").select(F.col("month").alias("__to"), F.col("__next").alias("month")).unionByName(last)
    parts = basis.groupBy("__to").agg(F.count(F.lit(1)).alias("__parts"))
    values = found.select("month", "destination_id", "score", "incoming")
    ahead = values.join(basis.join(parts, "__to"), "month").groupBy("__to", "destination_id").agg((F.sum("score") / F.first("__parts")).alias("ahead"), (F.sum("incoming") / F.first("__parts")).alias("ahead_incoming"))
    return found.join(ahead.withColumnRenamed("__to", "month"), ["month", "destination_id"], "full_outer")


def _row(rows: DataFrame, layer: str | Column, place: str, value: Column, **given: Column) -> DataFrame:
    """Rows of one layer; columns not given are the table's own or null."""
    own = {"month": F.lit(None).cast("string"), "place_name": F.lit(None).cast("string"), "province": F.lit(None).cast("string"), "incoming": F.lit(None), "extra": F.lit(None), "is_capital": F.lit(False), "is_border": F.lit(False)} | given
    flags = {c: F.coalesce(own[c].cast("boolean"), F.lit(False)) for c in ("is_capital", "is_border")}
    numbers = {c: own[c].cast("double") for c in ("incoming", "extra")}
    own = own | flags | numbers
    return rows.select((F.lit(layer) if isinstance(layer, str) else layer).alias("layer"), own["month"].alias("month"), F.col(place).cast("string").alias("place"), own["place_name"].cast("string").alias("place_name"), own["province"].cast("string").alias("province"), value.cast("double").alias("value"), *[own[c].alias(c) for c in COLUMNS[6:]])


def flow_layers(found: DataFrame, zones: DataFrame, rules: DataFrame) -> DataFrame:
    """weighted, contact, air, forecast, risk and movement rows of every month and destination, from ``forecast(sums(...))``."""
    dims = air_factor(zones, rules).select(F.col("zone_id").alias("__z"), "zone_name", "province", "category", "is_kinshasa", "is_uganda_border", "air_factor")
    rows = found.join(dims, F.col("destination_id") == F.col("__z"), "left")
    factor = F.coalesce("air_factor", F.lit(1.0))
    capital = F.coalesce(F.col("is_kinshasa") == 1, F.lit(False)) | F.coalesce(F.col("category") == "kinshasa", F.lit(False))
    border = F.coalesce(F.col("is_uganda_border") == 1, F.lit(False)) | F.coalesce(F.col("category") == "uganda_border", F.lit(False))
    layers = {"weighted": ("score", "incoming", None), "contact": ("adjusted", "incoming", None), "air": (F.col("score") * factor, "incoming", F.col("score") * (1 - factor)), "forecast": ("ahead", "ahead_incoming", None), "risk": ("arrivals", "arrivals", None), "movement": ("total", "total", None)}
    parts = [
        F.struct(F.lit(name).alias("layer"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"), F.col(i).cast("double").alias("incoming"), (F.lit(None) if e is None else e).cast("double").alias("extra"))
        for name, (v, i, e) in layers.items()
    ]
    tall = rows.select("month", "destination_id", "zone_name", "province", capital.alias("is_capital"), border.alias("is_border"), F.explode(F.array(*parts)).alias("x"))
    return tall.where("x.value > 0").select("x.layer", "month", F.col("destination_id").alias("place"), F.col("zone_name").alias("place_name"), "province", "x.value", "x.incoming", "x.extra", "is_capital", "is_border")


def projection_layers(found: DataFrame, zones: DataFrame, profile: DataFrame, fraction: float, capital: str | None = None) -> DataFrame:
    """uganda and uganda_import rows: each month's border movement and pressure allocated to the neighbour's districts.

    uganda is the movement of all origins times the share that crosses, by the districts'
    weights; uganda_import the case-weighted pressure by their observed movement.
    capital: the district whose projected movement counts as that of the capital.
    """
    border = zones.where("is_uganda_border = 1").select(F.col("zone_id").alias("destination_id"))
    base = found.join(border, "destination_id", "left_semi").groupBy("month").agg(F.sum("total").alias("__total"), F.sum("score").alias("__score"), F.sum("incoming").alias("__incoming"))
    shares = profile.crossJoin(F.broadcast(profile.agg(F.sum("weight").alias("__w"), F.sum("observed").alias("__seen"))))
    rows = base.crossJoin(F.broadcast(shares))
    known = F.try_divide("observed", "__seen")
    out = _row(rows, "uganda", "district_id", F.col("__total") * fraction * F.try_divide("weight", "__w"), month=F.col("month"), place_name=F.col("district"), incoming=F.col("__total"), is_capital=F.col("district_id") == F.lit(capital))
    return out.unionByName(_row(rows, "uganda_import", "district_id", F.col("__score") * known, month=F.col("month"), place_name=F.col("district"), incoming=F.col("__incoming") * known, extra=known)).where("value > 0")


def people_layers(zones: DataFrame, population: DataFrame, affected: DataFrame, month: str) -> DataFrame:
    """population and density rows; extra is the area of density and 1 for affected zones of population."""
    hit = affected.select(F.col("zone_id").alias("__a")).distinct()
    rows = population.where("population > 0").join(zones, "zone_id", "left").join(hit, F.col("zone_id") == F.col("__a"), "left")
    flags = {"month": F.lit(month), "place_name": F.col("zone_name"), "province": F.col("province"), "incoming": F.col("population"), "is_capital": (F.col("is_kinshasa") == 1) | (F.col("category") == "kinshasa"), "is_border": (F.col("is_uganda_border") == 1) | (F.col("category") == "uganda_border")}
    people = _row(rows, "population", "zone_id", F.col("population"), extra=F.col("__a").isNotNull().cast("int"), **flags)
    return people.unionByName(_row(rows.where("area_km2 > 0"), "density", "zone_id", F.col("population") / F.col("area_km2"), extra=F.col("area_km2"), **flags))


def ranking(rows: DataFrame, n: int) -> DataFrame:
    """(layer, rank, place, place_name, value): the n largest of each layer, ties by place."""
    order = W.partitionBy("layer").orderBy(F.desc("value"), "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("layer", F.col("rank").cast("long").alias("rank"), "place", "place_name", "value")


def bars(rows: DataFrame, n: int) -> DataFrame:
    """(layer, rank, place, place_name, value, extra): cases by zone, cases of affected zones beside their wealth percentile, movement by border district; the n largest of each."""
    wealth = F.col("layer") == "rwi"
    held = rows.where(F.col("layer").isin("cases", "uganda_border") | (wealth & (F.col("incoming") > 0)))
    shown = held.select("layer", "place", "place_name", F.when(wealth, F.col("incoming")).otherwise(F.col("value")).alias("value"), F.when(wealth, F.col("value")).alias("extra"))
    order = W.partitionBy("layer").orderBy(F.desc("value"), "place")
    return shown.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def trend(rows: DataFrame) -> DataFrame:
    """(layer, month, total, top, capital, border) of each layer and month; densities are people by area."""
    dense = F.col("layer") == "density"
    # of densities the sums are people and area
    amount = F.when(dense, F.col("incoming")).otherwise(F.col("value"))
    share = lambda test: F.when(F.first("layer") == "density", F.try_divide(F.sum(F.when(test, F.col("incoming"))), F.sum(F.when(test, F.col("extra"))))).otherwise(F.sum(F.when(test, amount)))
    return rows.groupBy("layer", "month").agg(share(F.lit(True)).alias("total"), F.max("value").alias("top"), F.coalesce(share(F.col("is_capital")), F.lit(0.0)).alias("capital"), F.coalesce(share(F.col("is_border")), F.lit(0.0)).alias("border"))


def numbers(rows: DataFrame) -> DataFrame:
    """(layer, kpi, value, name): totals, shares and the top place of each layer.

    total and places of the layer's values, incoming, extra (what air rules suppress,
    people of affected zones), capital and border sums with their share, and the top.
    """
    add = lambda c, test=None: F.coalesce(F.sum(F.col(c) if test is None else F.when(test, F.col(c))), F.lit(0.0))
    people = F.col("layer") == "population"
    kept = rows.withColumn("extra", F.when(people, F.col("extra") * F.col("value")).otherwise(F.col("extra")))
    wide = kept.groupBy("layer").agg(
        add("value").alias("total"), F.count(F.lit(1)).cast("double").alias("places"), add("incoming").alias("incoming"), add("extra").alias("extra"), add("value", F.col("is_capital")).alias("capital"), add("value", F.col("is_border")).alias("border"),
        F.percentile("value", 0.5).alias("median"), F.min_by(F.struct(F.coalesce("place_name", "place").alias("name"), "value"), F.struct(-F.col("value"), "place")).alias("t"),
    )
    share = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1.0))
    none = F.lit(None).cast("string")
    kpis = [(k, F.col(k), none) for k in ("total", "places", "incoming", "extra", "capital", "border", "median")]
    kpis += [("capital_share", share("capital"), none), ("border_share", share("border"), none), ("top", F.col("t.value"), F.col("t.name"))]
    items = [F.struct(F.lit(k).alias("kpi"), v.cast("double").alias("value"), n.alias("name")) for k, v, n in kpis]
    return wide.select("layer", F.explode(F.array(*items)).alias("x")).select("layer", "x.kpi", "x.value", "x.name")
