"""Mobility queries: flows, origin sets, weighted layers, allocation, rankings, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.functions.geo import EARTH_KM, area_or_measured, bearing, bend, point_along, polygon_measures, square
from zonepulse.functions.numbers import response_class
from zonepulse.functions.text import norm_name, strip_accents
from zonepulse.operators import asof, keys, mobility
from zonepulse.operators.assess import capital_assessment
from zonepulse.plans.registry import Source, query
from zonepulse.sources.shared import materialize

MONTH, DAY = "2000-06", "2000-06-30"
MAJOR = ["NATION_1", "NATION_4", "NATION_9", "NATION_12"]
_MAJOR = ", ".join(f"'{m.lower()}'" for m in MAJOR)

# affected origins as SQL: id, else the zone of the same name, one row per id
AFFECTED = f"""
today AS (SELECT * FROM cases WHERE date = DATE '{DAY}' AND confirmed_cases > 0),
resolved AS (SELECT coalesce(t.zone_id, z.zone_id) AS zone_id, t.health_zone AS zone_name, t.province, t.confirmed_cases, t.confirmed_deaths,
    coalesce(i.lat, z.lat) AS lat, coalesce(i.lon, z.lon) AS lon
  FROM today t LEFT JOIN zones i ON t.zone_id = i.zone_id LEFT JOIN zones z ON lower(trim(t.health_zone)) = lower(trim(z.zone_name))),
affected AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY confirmed_cases DESC, zone_name DESC) AS rn FROM resolved WHERE zone_id IS NOT NULL) WHERE rn = 1)"""
SCORED = f"""{AFFECTED},
sums AS (SELECT destination_id, CAST(sum(confirmed_cases * movement) AS BIGINT) AS score, CAST(sum(movement) AS BIGINT) AS incoming
  FROM flows JOIN affected ON origin_id = zone_id WHERE month = '{MONTH}' AND movement > 0 GROUP BY 1),
scored AS (SELECT coalesce(z.zone_id, s.destination_id) AS zone_id, zone_name, province, category, is_uganda_border, is_kinshasa, lat, lon, area_km2,
    coalesce(score, 0) AS score, coalesce(incoming, 0) AS incoming
  FROM zones z FULL OUTER JOIN sums s ON z.zone_id = s.destination_id)"""
MULTIPLIER = f"""
latest AS (SELECT lower(trim(province)) AS k, coalesce(max_by(followup_rate, date) FILTER (WHERE date <= DATE '{DAY}'), min_by(followup_rate, date)) AS f,
    coalesce(max_by(target_rate, date) FILTER (WHERE date <= DATE '{DAY}'), min_by(target_rate, date)) AS t FROM contacts GROUP BY 1),
multipliers AS (SELECT k, 1 + greatest(0, t - f) AS multiplier FROM latest)"""


def _affected(t: Source) -> DataFrame:
    return mobility.affected_origins(t.cases.where(F.col("date") == F.lit(DAY).cast("date")), t.zones)


def _affected_once(t: Source) -> DataFrame:
    """The affected zones, written once for queries that read them in several places."""
    return materialize(_affected(t), "affected")


def _month(t: Source) -> DataFrame:
    return t.flows_of(MONTH)


def _scored(t: Source) -> DataFrame:
    return mobility.universe(t.zones, mobility.weighted(_month(t), _affected(t)))


def _scored_once(t: Source) -> DataFrame:
    """A score a zone, written once for queries whose classes or shares need all of them first."""
    return materialize(_scored(t), "scored")


@query("zones flows cases", SCORED + " SELECT row_number() OVER (ORDER BY score DESC, zone_id) AS rank, zone_id, zone_name, score, incoming FROM scored ORDER BY score DESC, zone_id LIMIT 12")
def weighted_risk_topn(t: Source) -> DataFrame:
    return mobility.top(_scored(t), "score", 12).select("rank", "zone_id", "zone_name", "score", "incoming")


@query("cases zones", f"SELECT coalesce(health_zone, '') AS health_zone, zone_id, province, confirmed_cases, confirmed_deaths FROM cases WHERE date = DATE '{DAY}'")
def b1_case_rows(t: Source) -> DataFrame:
    return t.cases.where(F.col("date") == F.lit(DAY).cast("date")).select(F.coalesce("health_zone", F.lit("")).alias("health_zone"), "zone_id", "province", "confirmed_cases", "confirmed_deaths")


@query("reports", "SELECT date, report_no, cumulative FROM reports WHERE date <= DATE '2024-01-20'")
def b2_rows_until(t: Source) -> DataFrame:
    return t.reports.where(F.col("date") <= F.lit("2024-01-20").cast("date")).select("date", "report_no", "cumulative").orderBy("date")


@query("zones flows cases", AFFECTED + f" SELECT month, origin_id, destination_id, movement FROM flows WHERE month = '{MONTH}' AND origin_id IN (SELECT zone_id FROM affected)")
def b3_selected_flows(t: Source) -> DataFrame:
    return mobility.selected(_month(t), mobility.origin_set(_affected(t))).select("month", "origin_id", "destination_id", "movement")


@query("zones flows", "p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), f AS (SELECT * FROM flows JOIN p USING (month)) SELECT month, destination_id, CAST(sum(movement) AS BIGINT) AS movement FROM f GROUP BY 1, 2")
def b3_flows_of_months(t: Source) -> DataFrame:
    """Flows of the months that another table asks for, from a table with a partition a month: the scan leaves the other months out."""
    asked = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return mobility.of_months(t.monthly_flows(), materialize(asked, "months")).groupBy("month", "destination_id").agg(F.sum("movement").alias("movement"))


@query(
    "zones cases",
    AFFECTED
    + f""" SELECT 'all_affected' AS origin_set, zone_id FROM affected
    UNION ALL SELECT 'major', zone_id FROM affected WHERE lower(zone_name) IN ({_MAJOR})
    UNION ALL SELECT 'custom', zone_id FROM affected WHERE zone_id IN ('2', '6', '10')
    UNION ALL SELECT 'ituri', zone_id FROM affected WHERE lower(province) = 'ituri'
    UNION ALL SELECT 'fallback', zone_id FROM zones WHERE category = 'kinshasa'""",
)
def b4_origin_sets(t: Source) -> DataFrame:
    a = _affected_once(t)
    sets = {
        "all_affected": mobility.origin_set(a),
        "major": mobility.origin_set(a, "major", major=MAJOR),
        "custom": mobility.origin_set(a, "custom", custom=["2", "6", "10"]),
        "ituri": mobility.origin_set(a, "ituri"),
        "fallback": mobility.origin_set(a, "major", major=["nowhere"], fallback=t.zones.where("category = 'kinshasa'")),
    }
    out = None
    for name, rows in sets.items():
        part = rows.select(F.lit(name).alias("origin_set"), "zone_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("zones cases", AFFECTED + " SELECT zone_id, zone_name, province, confirmed_cases, confirmed_deaths, lat, lon FROM affected")
def b5_affected_origins(t: Source) -> DataFrame:
    return _affected(t).select("zone_id", "zone_name", "province", "confirmed_cases", "confirmed_deaths", "lat", "lon")


@query("zones population", "SELECT p.zone_id, z.zone_name, z.province, z.lat, z.lon, p.population FROM population p LEFT JOIN zones z USING (zone_id) WHERE p.zone_id IS NOT NULL")
def b9_population_rows(t: Source) -> DataFrame:
    z = t.zones.select("zone_id", "zone_name", "province", "lat", "lon")
    return t.population.where("zone_id is not null").join(z, "zone_id", "left").select("zone_id", "zone_name", "province", "lat", "lon", "population")


@query("zones flows", f"SELECT destination_id, zone_name, category, movement FROM flows LEFT JOIN zones ON destination_id = zone_id WHERE month = '{MONTH}' AND origin_id = '3'")
def c1_lookup_by_id(t: Source) -> DataFrame:
    z = t.zones.select(F.col("zone_id").alias("destination_id"), "zone_name", "category")
    return _month(t).where("origin_id = '3'").join(z, "destination_id", "left").select("destination_id", "zone_name", "category", "movement")


@query("zones", "d AS (SELECT *, substr(zone_name, 1, 8) AS short FROM zones), n AS (SELECT lower(trim(short)) AS k, max_by(zone_id, zone_id) AS zone_id FROM d GROUP BY 1) SELECT d.zone_id, d.short, n.zone_id AS named_id FROM d LEFT JOIN n ON lower(trim(d.short)) = n.k")
def c2_lookup_by_name(t: Source) -> DataFrame:
    d = t.zones.withColumn("short", F.substring("zone_name", 1, 8))
    named = keys.by_name(d, "short").select("name_key", F.col("named.zone_id").alias("named_id"))
    return d.join(named, norm_name(F.col("short")) == F.col("name_key"), "left").select("zone_id", "short", "named_id")


@query("zones cases", f"SELECT c.health_zone, coalesce(i.zone_id, n.zone_id) AS found_id, coalesce(i.category, n.category) AS category FROM cases c LEFT JOIN zones i ON c.zone_id = i.zone_id LEFT JOIN zones n ON lower(c.health_zone) = lower(n.zone_name) WHERE date = DATE '{DAY}'")
def c3_two_key_join(t: Source) -> DataFrame:
    found = keys.two_key(t.cases.where(F.col("date") == F.lit(DAY).cast("date")), t.zones, "zone_id", "health_zone")
    return found.select("health_zone", F.col("zone.zone_id").alias("found_id"), F.col("zone.category").alias("category"))


@query("zones flows cases population", SCORED + " SELECT s.zone_id, s.zone_name, score, incoming, coalesce(population, 0) AS population, a.zone_id IS NOT NULL AS is_outbreak FROM scored s LEFT JOIN population p ON s.zone_id = p.zone_id LEFT JOIN affected a ON s.zone_id = a.zone_id")
def c4_universe(t: Source) -> DataFrame:
    a = _affected_once(t)
    return mobility.universe(t.zones, mobility.weighted(_month(t), a), t.population, a).select("zone_id", "zone_name", "score", "incoming", "population", "is_outbreak")


@query("zones flows cases", AFFECTED + f" SELECT origin_id, destination_id, movement, confirmed_cases, CAST(confirmed_cases * movement AS BIGINT) AS weight FROM flows JOIN affected ON origin_id = zone_id WHERE month = '{MONTH}'")
def c5_edges_with_cases(t: Source) -> DataFrame:
    a = _affected(t).select(F.col("zone_id").alias("origin_id"), "confirmed_cases")
    return _month(t).join(a, "origin_id").select("origin_id", "destination_id", "movement", "confirmed_cases", (F.col("confirmed_cases") * F.col("movement")).alias("weight"))


@query("zones cases", f"l AS (SELECT zone_id, health_zone FROM cases WHERE date = DATE '{DAY}' AND confirmed_cases > 500) SELECT zone_id, zone_name, zone_id IN (SELECT zone_id FROM l WHERE zone_id IS NOT NULL) OR lower(zone_name) IN (SELECT lower(health_zone) FROM l) AS is_outbreak FROM zones")
def c6_membership(t: Source) -> DataFrame:
    listed = t.cases.where((F.col("date") == F.lit(DAY).cast("date")) & (F.col("confirmed_cases") > 500)).select("zone_id", F.col("health_zone").alias("zone_name"))
    return keys.flagged(t.zones.select("zone_id", "zone_name"), listed, "is_outbreak")


@query("zones flows", f"SELECT origin_id, CAST(sum(movement) AS BIGINT) AS movement FROM flows WHERE month = '{MONTH}' AND origin_id IN ('1', '4', '9', '12') GROUP BY 1")
def c7_semi_join_origins(t: Source) -> DataFrame:
    listed = t.zones.where(norm_name(F.col("zone_name")).isin([m.lower() for m in MAJOR]))
    return mobility.selected(_month(t), listed).groupBy("origin_id").agg(F.sum("movement").alias("movement"))


@query("contacts", "SELECT province, coalesce(max_by(date, date) FILTER (WHERE date <= DATE '2000-05-15'), min(date)) AS date, coalesce(max_by(seen, date) FILTER (WHERE date <= DATE '2000-05-15'), min_by(seen, date)) AS seen FROM contacts GROUP BY 1")
def c9_asof_contact(t: Source) -> DataFrame:
    return asof.latest_or_first(t.contacts, ["province"], "date", "2000-05-15").select("province", "date", "seen")


_CONTACT_ASOF = "m AS (SELECT c.*, k.date AS contact_date, k.seen, k.under_followup FROM cases c ASOF LEFT JOIN contacts k ON c.province = k.province AND c.date >= k.date), f AS (SELECT province, min(date) AS d, min_by(seen, date) AS s, min_by(under_followup, date) AS u FROM contacts GROUP BY 1)"


@query("cases contacts", _CONTACT_ASOF + " SELECT date, province, health_zone, confirmed_cases, coalesce(contact_date, d) AS contact_date, coalesce(seen, s) AS seen, coalesce(under_followup, u) AS under_followup FROM m LEFT JOIN f USING (province)")
def c9_asof_every_row(t: Source) -> DataFrame:
    """Every case row with the latest contact row of its province, or its first where none is that old."""
    found = asof.asof_join(t.cases, t.contacts, ["province"], "date", "date", else_first=True)
    return found.select("date", "province", "health_zone", "confirmed_cases", F.col("matched.date").alias("contact_date"), "matched.seen", "matched.under_followup")


@query(
    "flows",
    "e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS seen_id, user_id, ts AS seen_ts FROM events WHERE event_type = 'view'), "
    "m AS (SELECT e.event_id, e.user_id, seen_ts FROM e ASOF LEFT JOIN (SELECT user_id, seen_ts FROM v GROUP BY ALL) v ON e.user_id = v.user_id AND e.ts >= v.seen_ts), n AS (SELECT user_id, seen_ts, max(seen_id) AS seen_id FROM v GROUP BY ALL) SELECT event_id, m.user_id, seen_id FROM m LEFT JOIN n USING (user_id, seen_ts)",
)
def c9_asof_events(t: Source) -> DataFrame:
    """Every purchase with the user's last view before it, the greatest id of those of one instant."""
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    found = asof.asof_join(of("purchase"), of("view"), ["user_id"], "ts", "ts", order=["event_id"])
    return found.select("event_id", "user_id", F.col("matched.event_id").alias("seen_id"))


@query(
    "zones flows cases air_rules",
    SCORED
    + """, f AS (SELECT zone_id, min(air_factor) AS m FROM scored JOIN air_rules ON (match_type = 'category' AND lower(match_value) = lower(category)) OR (match_type = 'zone_name' AND lower(match_value) = lower(zone_name)) GROUP BY 1)
    SELECT s.zone_id, zone_name, coalesce(m, 1) AS air_factor FROM scored s LEFT JOIN f USING (zone_id)""",
)
def c13_rule_join(t: Source) -> DataFrame:
    return mobility.air_factor(_scored(t), t.air_rules).select("zone_id", "zone_name", "air_factor")


_BORDER = f"""
border AS (SELECT coalesce(CAST(sum(movement) AS BIGINT), 0) AS border_total, sum(lat * movement) / sum(movement) AS hub_lat, sum(lon * movement) / sum(movement) AS hub_lon
  FROM flows JOIN zones ON destination_id = zone_id WHERE month = '{MONTH}' AND is_uganda_border = 1)"""


@query("zones", "c AS (SELECT c_custkey, translate(n_name, 'AEIOUN', 'ÁÈÎÖÜÑ') AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT lower(strip_accents(raw)) AS name, z.zone_id, count(*) AS n FROM c LEFT JOIN zones z ON lower(strip_accents(raw)) = lower(z.zone_name) GROUP BY 1, 2")
def c3_collation_join(t: Source) -> DataFrame:
    """Names that differ by accents and case, joined and grouped by a collation of the engine."""
    said = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.translate("n_name", "AEIOUN", "ÁÈÎÖÜÑ").alias("raw"))
    counted = keys.collated(said, "raw").groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.min(F.lower(strip_accents(F.collate("raw", "UTF8_BINARY")))).alias("name"))
    zones = keys.collated(t.zones.select("zone_id", "zone_name"), "zone_name")
    return counted.join(zones, F.col("raw") == F.col("zone_name"), "left").select("name", "zone_id", "n")


@query(
    "zones flows cases",
    f"""poly AS (SELECT zone_id, zone_name, province, lat + 0.5 AS plat, lon + 0.5 AS plon FROM zones WHERE CAST(zone_id AS INT) % 2 = 0)
    SELECT c.health_zone, coalesce(i.plat, n.plat) AS lat, coalesce(i.plon, n.plon) AS lon FROM cases c LEFT JOIN poly i ON c.zone_id = i.zone_id
    LEFT JOIN poly n ON lower(c.health_zone) = lower(n.zone_name) AND lower(c.province) = lower(n.province) WHERE date = DATE '{DAY}'""",
)
def c15_spatial_fallback(t: Source) -> DataFrame:
    """Centroid by id, else by name if the provinces agree."""
    poly = t.zones.where("cast(zone_id as int) % 2 = 0").select("zone_id", "zone_name", "province", (F.col("lat") + 0.5).alias("plat"), (F.col("lon") + 0.5).alias("plon"))
    today = t.cases.where(F.col("date") == F.lit(DAY).cast("date"))
    ids = poly.select(F.col("zone_id").alias("__z"), F.struct("plat", "plon").alias("__i"))
    names = poly.select(norm_name(F.col("zone_name")).alias("__n"), norm_name(F.col("province")).alias("__p"), F.struct("plat", "plon").alias("__by"))
    rows = today.join(ids, today["zone_id"] == ids["__z"], "left").join(names, (norm_name(today["health_zone"]) == names["__n"]) & (norm_name(today["province"]) == names["__p"]), "left")
    found = F.coalesce("__i", "__by")
    return rows.select("health_zone", found["plat"].alias("lat"), found["plon"].alias("lon"))


@query("zones flows profile", _BORDER + ", w AS (SELECT sum(weight) AS s FROM profile) SELECT district_id, round(weight / s, 6) AS share, round(border_total * (weight / s), 4) AS allocated FROM profile, w, border")
def c14_cross_join_allocation(t: Source) -> DataFrame:
    total = mobility.border_pressure(_month(t), t.zones)
    rows = mobility.allocate(total, F.col("border_total"), t.profile, F.col("weight"))
    return rows.select("district_id", F.round("share", 6).alias("share"), F.round("allocated", 4).alias("allocated"))


@query("zones flows", f"SELECT destination_id, zone_name, CAST(sum(movement) AS BIGINT) AS movement FROM flows LEFT JOIN zones ON destination_id = zone_id WHERE month = '{MONTH}' GROUP BY 1, 2")
def d1_sum_by_destination(t: Source) -> DataFrame:
    z = t.zones.select(F.col("zone_id").alias("destination_id"), "zone_name")
    return mobility.by_destination(_month(t)).join(z, "destination_id", "left").select("destination_id", "zone_name", "movement").orderBy(F.desc("movement"), "destination_id")


@query("zones flows", "SELECT month, CAST(sum(movement) AS BIGINT) AS total, CAST(sum(CASE WHEN is_kinshasa = 1 THEN movement ELSE 0 END) AS BIGINT) AS kinshasa, CAST(sum(CASE WHEN is_uganda_border = 1 THEN movement ELSE 0 END) AS BIGINT) AS border FROM flows LEFT JOIN zones ON destination_id = zone_id GROUP BY 1")
def d2_monthly_totals(t: Source) -> DataFrame:
    return mobility.monthly_totals(t.flows, t.zones).orderBy("month")


@query("zones flows", f"SELECT origin_id, CAST(sum(movement) AS BIGINT) AS movement, round(sum(lat * movement) / sum(movement), 4) AS target_lat, round(sum(lon * movement) / sum(movement), 4) AS target_lon FROM flows JOIN zones ON destination_id = zone_id WHERE month = '{MONTH}' AND category = 'kinshasa' AND origin_id IN ('1', '4', '9', '12') GROUP BY 1 HAVING sum(movement) > 0")
def d3_corridors(t: Source) -> DataFrame:
    listed = t.zones.where(norm_name(F.col("zone_name")).isin([m.lower() for m in MAJOR]))
    rows = mobility.corridors(_month(t), t.zones, listed, "kinshasa")
    return rows.select("origin_id", "movement", F.round("target_lat", 4).alias("target_lat"), F.round("target_lon", 4).alias("target_lon"))


@query("zones flows", _BORDER + " SELECT border_total, round(hub_lat, 4) AS hub_lat, round(hub_lon, 4) AS hub_lon FROM border UNION ALL SELECT 0, 0.55, 30.15")
def d4_border_pressure(t: Source) -> DataFrame:
    rows = mobility.border_pressure(_month(t), t.zones).unionByName(mobility.border_pressure(t.flows.where("month = 'none'"), t.zones))
    return rows.select("border_total", F.round("hub_lat", 4).alias("hub_lat"), F.round("hub_lon", 4).alias("hub_lon"))


@query("zones flows cases", SCORED + " SELECT destination_id, score, incoming FROM sums")
def d5_weighted_sum(t: Source) -> DataFrame:
    return mobility.weighted(_month(t), _affected(t))


_ADJUSTED = (
    SCORED
    + ","
    + MULTIPLIER
    + f""", adj AS (SELECT destination_id, sum(confirmed_cases * movement * coalesce(multiplier, 1)) AS adjusted_score
  FROM flows JOIN affected ON origin_id = zone_id LEFT JOIN multipliers ON lower(trim(province)) = k WHERE month = '{MONTH}' AND movement > 0 GROUP BY 1)"""
)


@query("zones flows cases contacts", _ADJUSTED + " SELECT destination_id, score, round(adjusted_score, 3) AS adjusted_score, incoming FROM sums JOIN adj USING (destination_id)")
def d6_parallel_sums(t: Source) -> DataFrame:
    rows = mobility.adjusted(_month(t), _affected(t), t.contacts, DAY)
    return rows.select("destination_id", "score", F.round("adjusted_score", 3).alias("adjusted_score"), "incoming")


_IMPORT = f"""
c AS (SELECT coalesce(k.zone_id, z.zone_id) AS zid, max(confirmed_cases) AS n FROM cases k LEFT JOIN zones z ON lower(k.health_zone) = lower(z.zone_name) WHERE date = DATE '{DAY}' GROUP BY 1),
pressure AS (SELECT CAST(sum(n * movement) AS BIGINT) AS score, CAST(sum(movement) AS BIGINT) AS movement FROM flows JOIN c ON origin_id = zid JOIN zones d ON destination_id = d.zone_id
  WHERE month = '{MONTH}' AND is_uganda_border = 1 AND movement > 0)"""


def _import_pressure(t: Source) -> DataFrame:
    today = keys.two_key(t.cases.where(F.col("date") == F.lit(DAY).cast("date")), t.zones, "zone_id", "health_zone")
    origin = today.select(F.coalesce("zone_id", "zone.zone_id").alias("zone_id"), "confirmed_cases").groupBy("zone_id").agg(F.max("confirmed_cases").alias("confirmed_cases"))
    border = t.zones.where("is_uganda_border = 1").select(F.col("zone_id").alias("destination_id"))
    sums = mobility.weighted(_month(t), origin, keep_zero=True).join(border, "destination_id", "left_semi")
    return sums.agg(F.sum("score").alias("score"), F.sum("incoming").alias("movement"))


@query("zones flows cases", _IMPORT + " SELECT score, movement FROM pressure")
def d7_case_weighted_border(t: Source) -> DataFrame:
    return _import_pressure(t)


@query("zones flows cases", "SELECT 'month' AS kind, month AS value FROM flows GROUP BY month UNION ALL SELECT 'province', province FROM cases GROUP BY province UNION ALL SELECT 'date', CAST(date AS VARCHAR) FROM cases GROUP BY date")
def d8_distinct_sorted(t: Source) -> DataFrame:
    one = lambda rows, kind, c: rows.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")).distinct()
    return one(t.flows, "month", "month").unionByName(one(t.cases, "province", "province")).unionByName(one(t.cases, "date", "date")).orderBy("kind", "value")


_BREAKS = "cut AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM scored WHERE score > 0)"


@query("zones flows cases", SCORED + f", {_BREAKS} SELECT round(q[1], 4) AS b1, round(q[2], 4) AS b2, round(q[3], 4) AS b3, round(q[4], 4) AS b4 FROM cut")
def d9_class_breaks(t: Source) -> DataFrame:
    cut = mobility.breaks(_scored(t), "score")
    return cut.select(*[F.round(F.col("breaks")[k], 4).alias(f"b{k + 1}") for k in range(4)])


_CLASS = "CASE WHEN v < {0} THEN 1 WHEN v < {1} THEN 2 WHEN v < {2} THEN 3 WHEN v < {3} THEN 4 ELSE 5 END"


@query(
    "zones flows cases wealth",
    SCORED
    + f""", {_BREAKS}, w AS (SELECT quantile_cont(rwi, [0.2, 0.4, 0.6, 0.8]) AS q FROM wealth), s AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN least(1, greatest(0, (p_size - 5) / 40.0)) END AS v FROM part)
    SELECT 'score' AS kind, zone_id AS key, CAST(CASE WHEN score <= 0 THEN 0 WHEN score <= q[1] THEN 1 WHEN score <= q[2] THEN 2 WHEN score <= q[3] THEN 3 WHEN score <= q[4] THEN 4 ELSE 5 END AS INT) AS class FROM scored, cut
    UNION ALL SELECT 'wealth', zone_id, CAST(CASE WHEN rwi <= q[1] THEN 1 WHEN rwi <= q[2] THEN 2 WHEN rwi <= q[3] THEN 3 WHEN rwi <= q[4] THEN 4 ELSE 5 END AS INT) FROM wealth, w
    UNION ALL SELECT 'gap', CAST(p_partkey AS VARCHAR), CAST(CASE WHEN v IS NULL THEN 0 ELSE {_CLASS.format(0.10, 0.25, 0.45, 0.65)} END AS INT) FROM s
    UNION ALL SELECT 'rate', CAST(p_partkey AS VARCHAR), CAST(CASE WHEN v IS NULL THEN 0 ELSE {_CLASS.format(0.25, 0.50, 0.70, 0.90)} END AS INT) FROM s""",
)
def b10_class_buckets(t: Source) -> DataFrame:
    scored = _scored_once(t)
    out = mobility.classed(scored, "score", mobility.breaks(scored, "score")).select(F.lit("score").alias("kind"), F.col("zone_id").alias("key"), "class")
    wealth = mobility.classed(t.wealth, "rwi", mobility.breaks(t.wealth, "rwi", positive=False), positive=False)
    out = out.unionByName(wealth.select(F.lit("wealth").alias("kind"), F.col("zone_id").alias("key"), "class"))
    value = F.when(F.col("p_size") % 10 != 0, (F.col("p_size") - 5) / 40.0)
    for kind in ("gap", "rate"):
        out = out.unionByName(t.part.select(F.lit(kind).alias("kind"), F.col("p_partkey").cast("string").alias("key"), response_class(value, kind == "gap").alias("class")))
    return out


@query("zones flows cases", SCORED + " SELECT zone_id, round(4 + 18 * sqrt(score / (SELECT max(score) FROM scored)), 4) AS radius FROM scored WHERE score > 0")
def b12_bubble_radius(t: Source) -> DataFrame:
    rows = _scored_once(t)
    scaled = rows.where("score > 0").crossJoin(F.broadcast(rows.agg(F.max("score").alias("most"))))
    return scaled.select("zone_id", F.round(4 + 18 * F.sqrt(F.col("score") / F.col("most")), 4).alias("radius"))


@query("zones flows", f"n AS (SELECT min(month) AS m FROM flows WHERE month > '{MONTH}'), e AS (SELECT origin_id, destination_id, movement FROM flows, n WHERE month = n.m) SELECT 'next' AS basis, count(*) AS edges, round(sum(movement), 3) AS movement FROM e UNION ALL SELECT 'mean', count(*), round(sum(m), 3) FROM (SELECT origin_id, destination_id, sum(movement) / 3 AS m FROM flows WHERE month IN (SELECT DISTINCT month FROM flows ORDER BY month DESC LIMIT 3) GROUP BY 1, 2)")
def e11_next_month_basis(t: Source) -> DataFrame:
    out = None
    for name, month in (("next", MONTH), ("mean", "9999-12")):
        part = mobility.next_month_basis(t.flows, month).agg(F.lit(name).alias("basis"), F.count(F.lit(1)).alias("edges"), F.round(F.sum("movement"), 3).alias("movement"))
        out = part if out is None else out.unionByName(part)
    return out.select("basis", "edges", F.col("movement").cast("double").alias("movement"))


@query("zones flows", f"SELECT origin_id, destination_id, movement, rank FROM (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY movement DESC, destination_id) AS rank FROM flows WHERE month = '{MONTH}') WHERE rank <= 5")
def f2_top_flows_per_origin(t: Source) -> DataFrame:
    return mobility.top_per_origin(_month(t), 5).select("origin_id", "destination_id", "movement", F.col("rank").cast("long").alias("rank"))


@query("zones flows cases", SCORED + " SELECT province, zone_id, zone_name, score FROM scored ORDER BY province, zone_name")
def f3_multi_key_sort(t: Source) -> DataFrame:
    return _scored(t).select("province", "zone_id", "zone_name", "score").orderBy(F.asc_nulls_last("province"), F.asc_nulls_last("zone_name"))


@query("zones flows", "SELECT zone_id FROM zones UNION SELECT destination_id FROM flows")
def g1_union_of_ids(t: Source) -> DataFrame:
    return t.zones.select("zone_id").union(t.flows.select(F.col("destination_id").alias("zone_id"))).distinct()


@query("zones flows", f"b AS (SELECT o.zone_id AS origin_id, d.zone_id AS destination_id, o.lat AS a1, o.lon AS o1, d.lat AS a2, d.lon AS o2 FROM flows JOIN zones o ON origin_id = o.zone_id JOIN zones d ON destination_id = d.zone_id WHERE month = '{MONTH}' AND origin_id = '2' AND origin_id <> destination_id) SELECT origin_id, destination_id, round((degrees(atan2(sin(radians(o2 - o1)) * cos(radians(a2)), cos(radians(a1)) * sin(radians(a2)) - sin(radians(a1)) * cos(radians(a2)) * cos(radians(o2 - o1)))) + 360) % 360, 3) AS bearing, round(a1 + (a2 - a1) * 0.55, 4) AS label_lat, round(o1 + (o2 - o1) * 0.55, 4) AS label_lon, round((a1 + a2) / 2 + (o2 - o1) * 0.12, 4) AS bend_lat, round((o1 + o2) / 2 - (a2 - a1) * 0.12, 4) AS bend_lon FROM b")
def h15_flow_geometry(t: Source) -> DataFrame:
    o = t.zones.select(F.col("zone_id").alias("origin_id"), F.col("lat").alias("a1"), F.col("lon").alias("o1"))
    d = t.zones.select(F.col("zone_id").alias("destination_id"), F.col("lat").alias("a2"), F.col("lon").alias("o2"))
    rows = _month(t).where("origin_id = '2' and origin_id <> destination_id").join(o, "origin_id").join(d, "destination_id")
    ends = F.col("a1"), F.col("o1"), F.col("a2"), F.col("o2")
    label, mid = point_along(*ends, 0.55), bend(*ends, 0.12)
    return rows.select("origin_id", "destination_id", F.round(bearing(*ends), 3).alias("bearing"), F.round(label[0], 4).alias("label_lat"), F.round(label[1], 4).alias("label_lon"), F.round(mid[0], 4).alias("bend_lat"), F.round(mid[1], 4).alias("bend_lon"))


_ARRIVALS = AFFECTED + f", sums AS (SELECT destination_id, CAST(sum(movement) AS BIGINT) AS movement FROM flows WHERE month = '{MONTH}' AND origin_id IN (SELECT zone_id FROM affected) GROUP BY 1), risk AS (SELECT coalesce(z.zone_id, destination_id) AS zone_id, coalesce(movement, 0) AS arrivals FROM zones z FULL OUTER JOIN sums ON z.zone_id = destination_id), cut AS (SELECT quantile_cont(arrivals, [0.2, 0.4, 0.6, 0.8]) AS q FROM risk WHERE arrivals > 0)"


@query("zones flows cases population", _ARRIVALS + " SELECT r.zone_id, arrivals, coalesce(population, 0) AS population, a.zone_id IS NOT NULL AS is_outbreak, CAST(CASE WHEN arrivals <= 0 THEN 0 ELSE 1 + len(list_filter(q, lambda x: arrivals > x)) END AS INT) AS class FROM risk r CROSS JOIN cut LEFT JOIN population p ON r.zone_id = p.zone_id LEFT JOIN affected a ON r.zone_id = a.zone_id")
def j2_spread_risk(t: Source) -> DataFrame:
    a = _affected_once(t)
    rows = materialize(mobility.universe(t.zones, mobility.by_destination(mobility.selected(_month(t), a)), t.population, a).withColumnRenamed("movement", "arrivals"), "arrivals")
    return mobility.classed(rows, "arrivals", mobility.breaks(rows, "arrivals")).select("zone_id", "arrivals", "population", "is_outbreak", "class")


@query("zones flows cases", SCORED + " SELECT zone_id, zone_name, province, score, incoming FROM scored")
def j3_weighted_risk(t: Source) -> DataFrame:
    return _scored(t).select("zone_id", "zone_name", "province", "score", "incoming")


@query("zones flows cases contacts", _ADJUSTED + f", {_BREAKS} SELECT zone_id, score, round(coalesce(adjusted_score, 0), 3) AS adjusted_score, CAST(CASE WHEN coalesce(adjusted_score, 0) <= 0 THEN 0 ELSE 1 + len(list_filter(q, lambda x: adjusted_score > x)) END AS INT) AS class FROM scored LEFT JOIN adj ON zone_id = destination_id CROSS JOIN cut")
def j4_contact_adjusted(t: Source) -> DataFrame:
    rows = materialize(mobility.universe(t.zones, mobility.adjusted(_month(t), _affected(t), t.contacts, DAY)), "adjusted")
    return mobility.classed(rows, "adjusted_score", mobility.breaks(rows, "score")).select("zone_id", "score", F.round("adjusted_score", 3).alias("adjusted_score"), "class")


_AIR = SCORED + """, f AS (SELECT zone_id, min(air_factor) AS m FROM scored JOIN air_rules ON (match_type = 'category' AND lower(match_value) = lower(category)) OR (match_type = 'zone_name' AND lower(match_value) = lower(zone_name)) GROUP BY 1),
air AS (SELECT s.*, coalesce(m, 1) AS air_factor FROM scored s LEFT JOIN f USING (zone_id))"""


@query("zones flows cases air_rules", _AIR + " SELECT zone_id, score, round(score * air_factor, 3) AS air_score, round(score * (1 - air_factor), 3) AS suppressed, air_factor < 0.999 AS is_adjusted FROM air")
def j5_air_adjusted(t: Source) -> DataFrame:
    rows = mobility.air_adjusted(_scored(t), t.air_rules)
    return rows.select("zone_id", "score", F.round("air_score", 3).alias("air_score"), F.round("suppressed", 3).alias("suppressed"), "is_adjusted")


@query("zones flows profile scenarios", _BORDER + ", w AS (SELECT sum(weight) AS s FROM profile) SELECT scenario_id, district_id, round(border_total * fraction * (weight / s), 4) AS projected FROM scenarios, profile, w, border")
def j6_uganda_projection(t: Source) -> DataFrame:
    total = mobility.border_pressure(_month(t), t.zones).crossJoin(t.scenarios)
    rows = t.profile.crossJoin(F.broadcast(t.profile.agg(F.sum("weight").alias("s")))).crossJoin(total)
    return rows.select("scenario_id", "district_id", F.round(F.col("border_total") * F.col("fraction") * (F.col("weight") / F.col("s")), 4).alias("projected"))


_POINTS = "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey * 10 END"


@query("profile", f"SELECT 'district' AS kind, district AS name, observed, rank FROM (SELECT *, row_number() OVER (ORDER BY observed DESC, district) AS rank FROM profile WHERE observed > 0) UNION ALL SELECT 'point', s_name, observed, row_number() OVER (ORDER BY observed DESC, s_name) FROM (SELECT s_name, {_POINTS} AS observed FROM supplier) WHERE observed > 0")
def j7_border_flow(t: Source) -> DataFrame:
    """Observed movement of districts and of monitoring points, largest first."""
    points = t.supplier.select("s_name", F.expr(_POINTS).alias("observed"))
    return mobility.observed(t.profile, "district", "district").unionByName(mobility.observed(points, "s_name", "point"))


@query("zones flows cases profile", _IMPORT + ", o AS (SELECT sum(observed) AS total FROM profile) SELECT district_id, round(score * (observed / total), 3) AS imported FROM profile, o, pressure")
def j8_uganda_import(t: Source) -> DataFrame:
    rows = mobility.allocate(_import_pressure(t), F.col("score"), t.profile, F.col("observed"))
    return rows.select("district_id", F.round("allocated", 3).alias("imported"))


@query("zones population", "SELECT coalesce(p.zone_id, z.zone_id) AS zone_id, zone_name, coalesce(population, 0) AS population FROM zones z LEFT JOIN population p USING (zone_id)")
def j9_population(t: Source) -> DataFrame:
    return t.zones.join(t.population, "zone_id", "left").select("zone_id", "zone_name", F.coalesce("population", F.lit(0)).alias("population"))


_SQUARE = f"{EARTH_KM} * {EARTH_KM} * radians(1) * (sin(radians(lat + 1)) - sin(radians(lat)))"


@query("zones population", f"SELECT z.zone_id, round(coalesce(CASE WHEN area_km2 > 0 THEN area_km2 END, {_SQUARE}), 3) AS area_km2, round(population / coalesce(CASE WHEN area_km2 > 0 THEN area_km2 END, {_SQUARE}), 6) AS density FROM zones z LEFT JOIN population p USING (zone_id)")
def j10_density(t: Source) -> DataFrame:
    """People by the stated area, else by that of the zone's polygon, a square here."""
    rows = t.zones.join(t.population, "zone_id", "left").withColumn("m", polygon_measures(square("lon", "lat")))
    area = area_or_measured(F.col("area_km2"), F.col("m.area_km2"))
    return rows.select("zone_id", F.round(area, 3).alias("area_km2"), F.round(F.col("population") / area, 6).alias("density"))


@query("zones population", "SELECT province, round(sum(population) / sum(CASE WHEN population IS NOT NULL THEN area_km2 END), 6) AS density FROM zones LEFT JOIN population USING (zone_id) GROUP BY 1")
def d16_ratio_of_sums(t: Source) -> DataFrame:
    rows = t.zones.join(t.population, "zone_id", "left")
    return rows.groupBy("province").agg(F.round(F.try_divide(F.sum("population"), F.sum(F.when(F.col("population").isNotNull(), F.col("area_km2")))), 6).alias("density"))


_MOVEMENT = f"""
m AS (SELECT * FROM flows WHERE month = '{MONTH}' AND origin_id IN ('1', '4', '9', '12')),
k AS (SELECT origin_id, category AS corridor, CAST(sum(movement) AS BIGINT) AS movement, sum(lat * movement) / sum(movement) AS lat, sum(lon * movement) / sum(movement) AS lon FROM m JOIN zones ON destination_id = zone_id WHERE category IN ('kinshasa', 'uganda_border') GROUP BY 1, 2)
SELECT origin_id, corridor, movement, round(lat, 4) AS lat, round(lon, 4) AS lon FROM k
UNION ALL SELECT 'hub', 'kinshasa', CAST(sum(movement) AS BIGINT), -4.325, 15.322 FROM k WHERE corridor = 'kinshasa' HAVING sum(movement) > 0
UNION ALL SELECT 'hub', 'uganda_border', CAST(sum(movement) AS BIGINT), round(sum(lat * movement) / sum(movement), 4), round(sum(lon * movement) / sum(movement), 4) FROM k WHERE corridor = 'uganda_border' HAVING sum(movement) > 0
UNION ALL SELECT origin_id, destination_id, movement, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY movement DESC, destination_id) AS rn FROM m) LEFT JOIN zones ON destination_id = zone_id WHERE rn <= 3"""
#: Where all movement to the capital is drawn. Fixed values.
CAPITAL_HUB = (-4.325, 15.322)


@query("zones flows", _MOVEMENT)
def j14_movement(t: Source) -> DataFrame:
    """Corridors of each origin with their ends, both hubs, and the largest flows."""
    listed = t.zones.where(norm_name(F.col("zone_name")).isin([m.lower() for m in MAJOR]))
    rows = mobility.selected(_month(t), listed)
    ends = t.zones.select(F.col("zone_id").alias("corridor"), "lat", "lon")
    out = mobility.top_per_origin(rows, 3).select("origin_id", F.col("destination_id").alias("corridor"), "movement").join(ends, "corridor", "left")
    for category, hub in (("kinshasa", CAPITAL_HUB), ("uganda_border", (None, None))):
        found = mobility.corridors(rows, t.zones, listed, category)
        out = out.unionByName(found.select("origin_id", F.lit(category).alias("corridor"), "movement", F.round("target_lat", 4).alias("lat"), F.round("target_lon", 4).alias("lon")))
        out = out.unionByName(mobility.hubs(found, *hub).select(F.lit("hub").alias("origin_id"), F.lit(category).alias("corridor"), "movement", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")))
    return out.select("origin_id", "corridor", "movement", "lat", "lon")


@query("zones flows cases", AFFECTED + f", e AS (SELECT origin_id, destination_id, movement FROM flows WHERE month = (SELECT min(month) FROM flows WHERE month > '{MONTH}')) SELECT destination_id, CAST(round(sum(confirmed_cases * movement), 3) AS DOUBLE) AS score FROM e JOIN affected ON origin_id = zone_id GROUP BY 1")
def j15_forecast_weighted(t: Source) -> DataFrame:
    rows = mobility.weighted(mobility.next_month_basis(t.flows, MONTH), _affected(t))
    return rows.select("destination_id", F.round("score", 3).cast("double").alias("score"))


_CAPITAL = """ SELECT '{0}' AS capital, cases, round(share, 6) AS share, destinations, CASE WHEN cases > 0 THEN 'high' WHEN share >= 0.15 THEN 'moderate_high' WHEN share >= 0.05 THEN 'moderate' WHEN share < 0.01 THEN 'very_low' ELSE 'low' END AS level
FROM (SELECT coalesce(sum(a) FILTER (WHERE own) / nullif(sum(a), 0), 0) AS share, count(*) FILTER (WHERE own) AS destinations FROM (SELECT score * air_factor AS a, coalesce(is_kinshasa = 1, false) OR coalesce(contains(lower(category), '{0}'), false) OR coalesce(contains(lower(zone_name), '{0}'), false) AS own FROM air WHERE score * air_factor > 0)) s,
(SELECT CAST(coalesce(sum(confirmed_cases), 0) AS BIGINT) AS cases FROM cases WHERE date = DATE '""" + DAY + """' AND (contains(lower(province), '{0}') OR contains(lower(health_zone), '{0}'))) c"""


@query("zones flows cases air_rules", _AIR + " UNION ALL ".join(_CAPITAL.format(c) for c in ("kinshasa", "africa")))
def k14_capital_assessment(t: Source) -> DataFrame:
    """For a capital without local cases and for one whose province has some."""
    rows, today = mobility.air_adjusted(_scored_once(t), t.air_rules), t.cases.where(F.col("date") == F.lit(DAY).cast("date"))
    out = None
    for capital in ("kinshasa", "africa"):
        part = capital_assessment(rows, today, capital).select(F.lit(capital).alias("capital"), "cases", F.round("share", 6).alias("share"), "destinations", "level")
        out = part if out is None else out.unionByName(part)
    return out
