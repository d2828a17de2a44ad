"""Origin-destination pressure and risk scores.

All layers take the month as a column, so a trend over months is one pass and
not a query per month. Dimensions (zones, affected origins, rules) are small
against flows; Spark's own size estimates and AQE choose how they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonepulse.functions.numbers import bucket
from zonepulse.functions.text import norm_name, plausible, province_key, unknown_place
from zonepulse.operators.asof import latest_or_first
from zonepulse.operators.keys import two_key

#: Provinces of the named origin sets. Fixed values.
PROVINCE_SETS = {"ituri": ["ituri"], "north_kivu": ["nord-kivu", "north kivu", "north-kivu"], "south_kivu": ["sud-kivu", "south kivu", "south-kivu"]}
#: Where border pressure points if there is none. Fixed values.
DEFAULT_HUB = (0.55, 30.15)


def affected_origins(cases: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones with cases, resolved by id and then by name, one row of each id; unresolved rows go.

    Of several rows that with the most cases stays, then that with the last name.
    """
    found = two_key(cases.where("confirmed_cases > 0"), zones, "zone_id", "health_zone")
    rows = found.select(
        F.coalesce(F.nullif("zone_id", F.lit("")), F.col("zone.zone_id")).alias("zone_id"),
        F.coalesce(F.nullif("health_zone", F.lit("")), "zone.zone_name", "zone_id").alias("zone_name"),
        F.coalesce(F.nullif("province", F.lit("")), "zone.province", F.lit("")).alias("province"),
        "confirmed_cases",
        "confirmed_deaths",
        F.col("zone.lat").alias("lat"),
        F.col("zone.lon").alias("lon"),
    ).where("zone_id is not null")
    best = F.max_by(F.struct("zone_name", "province", "confirmed_cases", "confirmed_deaths", "lat", "lon"), F.struct("confirmed_cases", "zone_name"))
    return rows.groupBy("zone_id").agg(best.alias("r")).select("zone_id", "r.*")


def origin_set(affected: DataFrame, kind: str = "all_affected", custom: list[str] | None = None, major: list[str] | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """Affected origins of a named set: all_affected, a province set, a custom list, or the major zones.

    A custom list that is empty, and an unknown name, mean the major zones; major
    zones without cases fall back to ``fallback`` (a table with zone_id).
    """
    if kind == "all_affected":
        return affected.select("zone_id")
    if kind in PROVINCE_SETS:
        return affected.where(norm_name(F.col("province")).isin(PROVINCE_SETS[kind])).select("zone_id")
    if kind == "custom" and custom:
        return affected.where(F.col("zone_id").isin(custom)).select("zone_id")
    chosen = affected.where(norm_name(F.col("zone_name")).isin([m.lower() for m in major or []])).select("zone_id")
    if fallback is None:
        return chosen
    none = chosen.agg((F.count(F.lit(1)) == 0).alias("none"))
    return chosen.unionByName(fallback.select("zone_id").join(F.broadcast(none), F.col("none")).select("zone_id"))


def selected(flows: DataFrame, origins: DataFrame, month: str | None = None) -> DataFrame:
    """Flows of the month (all months if None) from the origins."""
    rows = flows if month is None else flows.where(F.col("month") == month)
    return rows.join(origins.select(F.col("zone_id").alias("__o")), rows["origin_id"] == F.col("__o"), "left_semi")


def by_destination(flows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return flows.groupBy(*keys, "destination_id").agg(F.sum("movement").alias("movement"))


def universe(zones: DataFrame, sums: DataFrame, population: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """All zones and all destinations seen; missing sums count 0."""
    values = [c for c in sums.columns if c != "destination_id"]
    joined = zones.join(sums, zones["zone_id"] == sums["destination_id"], "full_outer")
    out = joined.select(F.coalesce("zone_id", "destination_id").alias("zone_id"), *[c for c in zones.columns if c != "zone_id"], *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
    if population is not None:
        people = population.select(F.col("zone_id").alias("__z"), "population")
        out = out.join(people, out["zone_id"] == people["__z"], "left").drop("__z").withColumn("population", F.coalesce("population", F.lit(0)))
    if listed is not None:
        marks = listed.select(F.col("zone_id").alias("__z")).distinct()
        out = out.join(marks, out["zone_id"] == marks["__z"], "left").withColumn("is_outbreak", F.col("__z").isNotNull()).drop("__z")
    return out


def weighted(flows: DataFrame, affected: DataFrame, keys: tuple[str, ...] = (), keep_zero: bool = False) -> DataFrame:
    """Sum of cases at the origin times movement, by destination.

    Edges without movement or cases are left out, unless keep_zero keeps the
    movement of origins without cases.
    """
    origin = affected.select(F.col("zone_id").alias("__o"), F.col("confirmed_cases").alias("__c"))
    edges = flows.where("movement > 0").join(origin, flows["origin_id"] == origin["__o"])
    if not keep_zero:
        edges = edges.where("__c > 0")
    return edges.groupBy(*keys, "destination_id").agg(F.sum(F.col("__c") * F.col("movement")).alias("score"), F.sum("movement").alias("incoming"))


def contact_multiplier(contacts: DataFrame, day: str) -> DataFrame:
    """(province_key, multiplier): 1 plus the shortfall of follow-up as of the day.

    A blank rate counts as 0; provinces without any row are not listed (they get 1).
    """
    rows = latest_or_first(contacts.withColumn("province_key", province_key(F.col("province"))), ["province_key"], "date", day)
    gap = F.coalesce(F.nullif("target_rate", F.lit(0.0)), F.lit(0.95)) - F.coalesce("followup_rate", F.lit(0.0))
    return rows.select("province_key", (1 + F.greatest(F.lit(0.0), gap)).alias("multiplier"))


def adjusted(flows: DataFrame, affected: DataFrame, contacts: DataFrame, day: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Base and contact-adjusted scores and movement, by destination."""
    factors = contact_multiplier(contacts, day)
    origin = affected.withColumn("province_key", province_key(F.col("province"))).join(factors, "province_key", "left")
    origin = origin.select(F.col("zone_id").alias("__o"), F.col("confirmed_cases").alias("__c"), F.coalesce("multiplier", F.lit(1.0)).alias("__m"))
    edges = flows.where("movement > 0").join(origin, flows["origin_id"] == origin["__o"]).where("__c > 0")
    base = F.col("__c") * F.col("movement")
    return edges.groupBy(*keys, "destination_id").agg(F.sum(base).alias("score"), F.sum(base * F.col("__m")).alias("adjusted_score"), F.sum("movement").alias("incoming"))


def air_factor(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """zones with the smallest factor of the rules that hit them by category or name, else 1.

    Two equi-joins with aggregated rules instead of one join on OR.
    """
    least = rules.groupBy("match_type", norm_name(F.col("match_value")).alias("__v")).agg(F.min("air_factor").alias("__f"))
    cat = least.where("match_type = 'category'").select(F.col("__v").alias("__cv"), F.col("__f").alias("__cf"))
    name = least.where("match_type = 'zone_name'").select(F.col("__v").alias("__nv"), F.col("__f").alias("__nf"))
    out = zones.join(cat, norm_name(zones["category"]) == cat["__cv"], "left").join(name, norm_name(zones["zone_name"]) == name["__nv"], "left")
    return out.withColumn("air_factor", F.coalesce(F.least("__cf", "__nf"), F.lit(1.0))).drop("__cv", "__cf", "__nv", "__nf")


def air_adjusted(scored: DataFrame, rules: DataFrame) -> DataFrame:
    rows = air_factor(scored, rules)
    return rows.withColumn("air_score", F.col("score") * F.col("air_factor")).withColumn("suppressed", F.col("score") * (1 - F.col("air_factor"))).withColumn("is_adjusted", F.col("air_factor") < 0.999)


def border_pressure(flows: DataFrame, zones: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: total movement into border zones and its weighted hub, the default hub if 0."""
    border = zones.where("is_uganda_border = 1").select(F.col("zone_id").alias("__z"), "lat", "lon")
    edges = flows.join(border, flows["destination_id"] == border["__z"])
    m = F.col("movement") if weight is None else weight
    total = F.coalesce(F.sum(m), F.lit(0))
    hub = lambda c, d: F.when(total > 0, F.sum(F.col(c) * m) / total).otherwise(F.lit(d))
    return edges.agg(total.alias("border_total"), hub("lat", DEFAULT_HUB[0]).alias("hub_lat"), hub("lon", DEFAULT_HUB[1]).alias("hub_lon"))


def allocate(total: DataFrame, amount: Column, targets: DataFrame, share: Column) -> DataFrame:
    """Split the one-row total over the targets by their normalised shares.

    The total is one row by construction, so its broadcast is bounded.
    """
    shared = targets.crossJoin(F.broadcast(targets.agg(F.sum(share).alias("__s")))).withColumn("share", share / F.col("__s")).drop("__s")
    return shared.crossJoin(F.broadcast(total)).withColumn("allocated", amount * F.col("share"))


def monthly_totals(flows: DataFrame, zones: DataFrame) -> DataFrame:
    dims = zones.select(F.col("zone_id").alias("__z"), "is_kinshasa", "is_uganda_border")
    rows = flows.join(dims, flows["destination_id"] == dims["__z"], "left")
    pick = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("movement")).otherwise(0))
    return rows.groupBy("month").agg(F.sum("movement").alias("total"), pick("is_kinshasa").alias("kinshasa"), pick("is_uganda_border").alias("border"))


def corridors(flows: DataFrame, zones: DataFrame, origins: DataFrame, category: str) -> DataFrame:
    """Per listed origin: movement into a category and the movement-weighted centroid; above 0 only."""
    ends = zones.where(F.col("category") == category).select(F.col("zone_id").alias("__z"), F.coalesce("lat", F.lit(0.0)).alias("__lat"), F.coalesce("lon", F.lit(0.0)).alias("__lon"))
    rows = flows.join(ends, flows["destination_id"] == ends["__z"]).join(origins.select(F.col("zone_id").alias("__o")), F.col("origin_id") == F.col("__o"), "left_semi")
    out = rows.groupBy("origin_id").agg(F.sum("movement").alias("movement"), F.sum(F.col("__lat") * F.col("movement")).alias("__a"), F.sum(F.col("__lon") * F.col("movement")).alias("__b")).where("movement > 0")
    return out.select("origin_id", "movement", (F.col("__a") / F.col("movement")).alias("target_lat"), (F.col("__b") / F.col("movement")).alias("target_lon"))


def breaks(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8), positive: bool = True) -> DataFrame:
    """One row with the quantiles of the (positive) values as an array, null if there are none."""
    held = rows.where(F.col(value) > 0) if positive else rows.where(F.col(value).isNotNull())
    return held.agg(F.percentile(F.col(value), list(shares)).alias("breaks"))


def classed(rows: DataFrame, value: str, cut: DataFrame, positive: bool = True) -> DataFrame:
    """Adds ``class``: 0 for no value, else 1 + how many breaks the value exceeds."""
    return rows.crossJoin(F.broadcast(cut)).withColumn("class", bucket(F.col(value), F.col("breaks"), positive)).drop("breaks")


def top(rows: DataFrame, value: str, n: int, tie: str = "zone_id", positive: bool = False) -> DataFrame:
    """The n largest with their rank; ties by id."""
    held = rows.where(F.col(value) > 0) if positive else rows
    cut = held.orderBy(F.col(value).desc(), tie).limit(n)
    return cut.withColumn("rank", F.row_number().over(W.orderBy(F.col(value).desc(), tie)))


def top_per_origin(flows: DataFrame, n: int) -> DataFrame:
    """The n largest flows of each origin; Spark prunes to n a partition before the shuffle."""
    return flows.withColumn("rank", F.row_number().over(W.partitionBy("origin_id").orderBy(F.col("movement").desc(), "destination_id"))).where(F.col("rank") <= n)


def next_month_basis(flows: DataFrame, month: str, recent: int = 3) -> DataFrame:
    """Edges (origin, destination, movement) of the month after, else the mean of the last months.

    The months are settled first, ``recent`` rows at most, and edges join them by month.
    """
    months = flows.select("month").distinct()
    later = months.where(F.col("month") > month).agg(F.min("month").alias("month")).where("month is not null")
    last = months.orderBy(F.col("month").desc()).limit(recent)
    none = later.agg((F.count(F.lit(1)) == 0).alias("none"))
    basis = later.unionByName(last.join(F.broadcast(none), F.col("none")).select("month"))
    basis = basis.crossJoin(F.broadcast(basis.agg(F.count(F.lit(1)).alias("__parts"))))
    held = flows.join(F.broadcast(basis), "month")
    return held.groupBy("origin_id", "destination_id").agg((F.sum("movement") / F.first("__parts")).alias("movement"))


def hubs(corridors: DataFrame, lat: float | None = None, lon: float | None = None) -> DataFrame:
    """One row (movement, lat, lon): the corridors' movement and weighted end, or the place given; none without movement."""
    total = F.sum("movement")
    at = lambda c, fixed: F.sum(F.col(c) * F.col("movement")) / total if fixed is None else F.lit(fixed)
    return corridors.agg(total.alias("movement"), at("target_lat", lat).alias("lat"), at("target_lon", lon).alias("lon")).where("movement > 0")


def observed(rows: DataFrame, name: str, kind: str) -> DataFrame:
    """(kind, name, observed, rank) of places with observed movement, largest first, ties by name."""
    held = rows.where("observed > 0").select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("observed").cast("long").alias("observed"))
    return held.withColumn("rank", F.row_number().over(W.orderBy(F.desc("observed"), "name")).cast("long"))


def case_map(rows: DataFrame, polygons: DataFrame) -> DataFrame:
    """Adds place, known, labelled, radius and hidden to zones with cases.

    rows: zone_name, zone_id, province, cases, lat, lon. Places that say they are
    unknown are never drawn. Own coordinates count where they are plausible, else
    those of the polygon of the same id, or of the same name and province. hidden is
    the sum of all cases that are not drawn; labels need a share of the largest.
    """
    ids = polygons.where("zone_id is not null").groupBy(F.col("zone_id").alias("__id")).agg(F.max(F.struct("lat", "lon")).alias("__i"))
    names = polygons.groupBy(norm_name(F.col("zone_name")).alias("__name"), norm_name(F.col("province")).alias("__prov")).agg(F.max(F.struct("lat", "lon")).alias("__n"))
    found = rows.join(ids, F.col("zone_id") == F.col("__id"), "left").join(names, (norm_name(F.col("zone_name")) == F.col("__name")) & (norm_name(F.col("province")) == F.col("__prov")), "left")
    direct, other = plausible(F.col("lat"), F.col("lon")), F.coalesce("__i", "__n")
    lat, lon = (F.when(direct, F.col(c)).otherwise(other[c]) for c in ("lat", "lon"))
    marked = found.withColumns({"__lat": lat, "__lon": lon}).withColumn("known", ~unknown_place(F.col("zone_name"), F.col("zone_id")) & plausible(F.col("__lat"), F.col("__lon")))
    sums = marked.agg(F.greatest(F.max("cases"), F.lit(1)).alias("__most"), F.coalesce(F.sum(F.when((F.col("cases") > 0) & ~F.col("known"), F.col("cases"))), F.lit(0)).cast("long").alias("hidden"))
    drawn = F.col("known") & (F.col("cases") > 0)
    return marked.crossJoin(F.broadcast(sums)).select(
        "zone_name", "zone_id", "province", "cases", F.when(F.col("known"), F.col("__lat")).alias("lat"), F.when(F.col("known"), F.col("__lon")).alias("lon"), "known",
        (drawn & (F.col("cases") >= F.greatest(F.lit(10.0), 0.12 * F.col("__most")))).alias("labelled"), F.when(drawn, 5 + 31 * F.sqrt(F.col("cases") / F.col("__most"))).alias("radius"), "hidden",
    )


def of_months(flows: DataFrame, months: DataFrame) -> DataFrame:
    """Flows of the months in a table (month).

    flows lie in partitions by month and months is broadcast while it is few rows (a
    month a row: hundreds for decades), so the engine reads the asked partitions alone.
    """
    return flows.join(F.broadcast(months.where("month is not null")), "month", "left_semi")
