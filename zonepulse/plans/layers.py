"""Numbers, rankings and trends of every dashboard layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.operators import indicators, layers, sketches, stats
from zonepulse.plans.epidemiology import _INTENSITY, _LATEST, _PERCENTILE, _by_province, _rates
from zonepulse.plans.mobility import AFFECTED, DAY, MONTH, MULTIPLIER, _affected
from zonepulse.plans.registry import Source, query
from zonepulse.sources.shared import materialize

FRACTION = 0.15
#: The neighbour's district whose part a trend shows on its own.
CAPITAL = "u3"
TABLES = "zones flows cases contacts air_rules profile population"

_FLOW_ROWS = (
    AFFECTED
    + ","
    + MULTIPLIER
    + """,
found AS (SELECT month, destination_id, sum(movement) AS total, coalesce(sum(movement) FILTER (WHERE a.zone_id IS NOT NULL), 0) AS arrivals, coalesce(sum(movement) FILTER (WHERE confirmed_cases > 0 AND movement > 0), 0) AS incoming,
    coalesce(sum(confirmed_cases * movement) FILTER (WHERE movement > 0), 0) AS score, coalesce(sum(confirmed_cases * movement * coalesce(multiplier, 1)) FILTER (WHERE movement > 0), 0) AS adjusted
  FROM flows LEFT JOIN affected a ON origin_id = a.zone_id LEFT JOIN multipliers ON lower(trim(a.province)) = k GROUP BY 1, 2),
m AS (SELECT month, lead(month) OVER (ORDER BY month) AS nxt, row_number() OVER (ORDER BY month DESC) AS rn FROM (SELECT DISTINCT month FROM found)),
basis AS (SELECT month AS to_month, nxt AS from_month FROM m WHERE nxt IS NOT NULL UNION ALL SELECT (SELECT month FROM m WHERE rn = 1), month FROM m WHERE rn <= 3),
parts AS (SELECT to_month, count(*) AS n FROM basis GROUP BY 1),
ahead AS (SELECT to_month AS month, destination_id, sum(score) / CAST(any_value(n) AS DOUBLE) AS ahead, sum(incoming) / CAST(any_value(n) AS DOUBLE) AS ahead_incoming FROM found JOIN basis ON month = from_month JOIN parts USING (to_month) GROUP BY 1, 2),
dims AS (SELECT z.*, coalesce(min(air_factor), 1) AS air_factor FROM zones z LEFT JOIN air_rules ON (match_type = 'category' AND lower(match_value) = lower(category)) OR (match_type = 'zone_name' AND lower(match_value) = lower(zone_name)) GROUP BY ALL),
wide AS (SELECT * FROM found FULL JOIN ahead USING (month, destination_id) LEFT JOIN dims ON zone_id = destination_id),
flagged AS (SELECT *, coalesce(is_kinshasa = 1 OR category = 'kinshasa', false) AS is_capital, coalesce(is_uganda_border = 1 OR category = 'uganda_border', false) AS is_border, coalesce(air_factor, 1) AS f FROM wide),
base AS (SELECT month, sum(total) AS total, sum(score) AS score, sum(incoming) AS incoming FROM found WHERE destination_id IN (SELECT zone_id FROM zones WHERE is_uganda_border = 1) GROUP BY 1),
shares AS (SELECT district_id, district, weight / sum(weight) OVER () AS w, CAST(observed AS DOUBLE) / sum(observed) OVER () AS seen FROM profile),
people AS (SELECT p.zone_id, population, zone_name, province, area_km2, coalesce(is_kinshasa = 1 OR category = 'kinshasa', false) AS is_capital, coalesce(is_uganda_border = 1 OR category = 'uganda_border', false) AS is_border, p.zone_id IN (SELECT zone_id FROM affected) AS hit FROM population p LEFT JOIN zones z ON p.zone_id = z.zone_id WHERE population > 0),
tall AS (
  SELECT 'weighted' AS layer, month, destination_id AS place, zone_name AS place_name, CAST(score AS DOUBLE) AS value, CAST(incoming AS DOUBLE) AS incoming, CAST(NULL AS DOUBLE) AS extra, is_capital, is_border FROM flagged WHERE score > 0
  UNION ALL SELECT 'contact', month, destination_id, zone_name, adjusted, incoming, NULL, is_capital, is_border FROM flagged WHERE adjusted > 0
  UNION ALL SELECT 'air', month, destination_id, zone_name, score * f, incoming, score * (1 - f), is_capital, is_border FROM flagged WHERE score * f > 0
  UNION ALL SELECT 'forecast', month, destination_id, zone_name, ahead, ahead_incoming, NULL, is_capital, is_border FROM flagged WHERE ahead > 0
  UNION ALL SELECT 'risk', month, destination_id, zone_name, arrivals, arrivals, NULL, is_capital, is_border FROM flagged WHERE arrivals > 0
  UNION ALL SELECT 'movement', month, destination_id, zone_name, total, total, NULL, is_capital, is_border FROM flagged WHERE total > 0
  UNION ALL SELECT 'uganda', month, district_id, district, total * """
    + f"{FRACTION}"
    + f""" * w, total, NULL, district_id = '{CAPITAL}', false FROM base, shares WHERE total * w > 0
  UNION ALL SELECT 'uganda_import', month, district_id, district, score * seen, incoming * seen, seen, false, false FROM base, shares WHERE score * seen > 0
  UNION ALL SELECT 'population', '{MONTH}', zone_id, zone_name, population, population, CASE WHEN hit THEN 1 ELSE 0 END, is_capital, is_border FROM people
  UNION ALL SELECT 'density', '{MONTH}', zone_id, zone_name, population / area_km2, population, area_km2, is_capital, is_border FROM people WHERE area_km2 > 0)"""
)

_OTHER_ROWS = f""",
w AS (SELECT zone_id, {_PERCENTILE.format("rwi")} AS p FROM wealth),
more AS (
  SELECT 'cases' AS layer, coalesce(zone_id, health_zone) AS place, health_zone AS place_name, CAST(confirmed_cases AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS incoming, CAST(confirmed_deaths AS DOUBLE) AS extra FROM cases WHERE date = DATE '{DAY}' AND confirmed_cases > 0
  UNION ALL SELECT 'rwi', w.zone_id, z.zone_name, p, CAST(confirmed_cases AS DOUBLE), NULL FROM w LEFT JOIN zones z ON w.zone_id = z.zone_id LEFT JOIN affected a ON a.zone_id = w.zone_id WHERE p IS NOT NULL
  UNION ALL SELECT 'response_contact_gap', province, province, greatest(0, 0.95 - value), NULL, NULL FROM ({_LATEST.format("contact_followup_rate")}) WHERE value IS NOT NULL
  UNION ALL SELECT 'response_alert', province, province, value, NULL, NULL FROM ({_LATEST.format("alert_investigation_rate")}) WHERE value IS NOT NULL
  UNION ALL SELECT 'response_poe', province, province, value, NULL, NULL FROM ({_LATEST.format("poe_screening_coverage")}) WHERE value IS NOT NULL
  UNION ALL SELECT 'response_intensity', province, province, value, NULL, NULL FROM ({_INTENSITY})
  UNION ALL SELECT 'uganda_points', point_id, point, observed, NULL, NULL FROM points WHERE observed > 0
  UNION ALL SELECT 'uganda_border', district_id, district, observed, NULL, NULL FROM profile WHERE observed > 0),
shown AS (SELECT layer, place, place_name, value, incoming, extra, is_capital, is_border FROM tall WHERE month = '{MONTH}' UNION ALL SELECT layer, place, place_name, value, incoming, extra, false, false FROM more)"""


def _monthly(t: Source, affected: DataFrame | None = None) -> DataFrame:
    """Rows of the layers that have months; the sums over flows, a row a month and destination, are written once."""
    affected, zones = materialize(_affected(t), "affected") if affected is None else affected, t.zones
    found = layers.forecast(materialize(layers.sums(t.flows, affected, t.contacts, DAY), "layer-sums"))
    return layers.flow_layers(found, zones, t.air_rules).unionByName(layers.projection_layers(found, zones, t.profile, FRACTION, CAPITAL)).unionByName(layers.people_layers(zones, t.population, affected, MONTH))


def _shown(t: Source) -> DataFrame:
    """The month's rows and those of the layers without months."""
    one = layers._row  # noqa: SLF001
    names = t.zones.select("zone_id", "zone_name")
    affected = materialize(_affected(t), "affected")
    hit = affected.select("zone_id", F.col("confirmed_cases").alias("cases"))
    today = t.cases.where((F.col("date") == F.lit(DAY).cast("date")) & (F.col("confirmed_cases") > 0)).withColumn("place", F.coalesce("zone_id", "health_zone"))
    wealth = stats.percentile_rank(t.wealth, "rwi").where("percentile is not null").join(names, "zone_id", "left").join(hit, "zone_id", "left")
    parts = [
        one(today, "cases", "place", F.col("confirmed_cases"), place_name=F.col("health_zone"), extra=F.col("confirmed_deaths")),
        one(wealth, "rwi", "zone_id", F.col("percentile"), place_name=F.col("zone_name"), incoming=F.col("cases")),
        one(t.profile.where("observed > 0"), "uganda_border", "district_id", F.col("observed"), place_name=F.col("district")),
    ]
    parts.append(one(t.points.where("observed > 0"), "uganda_points", "point_id", F.col("observed"), place_name=F.col("point")))
    contact, alert, screening = _rates()
    shown = {"response_contact_gap": indicators.contact_gap(contact), "response_alert": alert, "response_poe": screening, "response_intensity": indicators.intensity([contact, alert, screening])}
    told = _by_province(t).select("province", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), v.alias("value")) for k, v in shown.items()])).alias("x")).where("x.value is not null")
    parts.append(one(told, F.col("x.layer"), "province", F.col("x.value"), place_name=F.col("province")))
    return materialize(reduce(DataFrame.unionByName, parts, _monthly(t, affected).where(F.col("month") == MONTH)), "layer-rows")


@query(
    TABLES + " wealth indicators points",
    _FLOW_ROWS
    + _OTHER_ROWS
    + """,
kept AS (SELECT * REPLACE (CASE WHEN layer = 'uganda_points' THEN 'uganda_border' ELSE layer END AS layer) FROM shown WHERE layer <> 'uganda_border'),
s AS (SELECT layer, sum(value) AS total, count(*) AS places, coalesce(sum(incoming), 0) AS incoming, coalesce(sum(CASE WHEN layer = 'population' THEN extra * value ELSE extra END), 0) AS extra, coalesce(sum(value) FILTER (WHERE is_capital), 0) AS capital,
  coalesce(sum(value) FILTER (WHERE is_border), 0) AS border, quantile_cont(value, 0.5) AS median FROM kept GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY value DESC, place) AS rn FROM kept) WHERE rn = 1),
district AS (SELECT * FROM shown WHERE layer = 'uganda_border' ORDER BY value DESC, place LIMIT 1),
k AS (SELECT layer, 'total' AS kpi, CAST(total AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS name FROM s UNION ALL SELECT layer, 'places', places, NULL FROM s UNION ALL SELECT layer, 'incoming', incoming, NULL FROM s UNION ALL SELECT layer, 'extra', extra, NULL FROM s
  UNION ALL SELECT layer, 'capital', capital, NULL FROM s UNION ALL SELECT layer, 'border', border, NULL FROM s UNION ALL SELECT layer, 'capital_share', capital / greatest(total, 1), NULL FROM s UNION ALL SELECT layer, 'border_share', border / greatest(total, 1), NULL FROM s
  UNION ALL SELECT layer, 'median', median, NULL FROM s UNION ALL SELECT layer, 'top', value, coalesce(place_name, place) FROM best UNION ALL SELECT layer, 'top_district', value, place_name FROM district)
SELECT layer, kpi, CAST(round(value, 3) AS DOUBLE) AS value, name FROM k""",
)
def k2_layer_kpis(t: Source) -> DataFrame:
    """The border layer counts monitoring points, and names the top district beside the top point."""
    shown = _shown(t)
    border = F.col("layer") == "uganda_border"
    points = F.when(F.col("layer") == "uganda_points", F.lit("uganda_border")).otherwise(F.col("layer"))
    district = layers.numbers(shown.where(border)).where("kpi = 'top'").withColumn("kpi", F.lit("top_district"))
    return layers.numbers(shown.where(~border).withColumn("layer", points)).unionByName(district).select("layer", "kpi", F.round("value", 3).alias("value"), "name")


@query(TABLES + " wealth indicators points", _FLOW_ROWS + _OTHER_ROWS + " SELECT layer, rank, place, place_name, CAST(round(value, 3) AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY value DESC, place) AS rank FROM shown) WHERE rank <= 12")
def k3_layer_ranking(t: Source) -> DataFrame:
    return layers.ranking(_shown(t), 12).select("layer", "rank", "place", "place_name", F.round("value", 3).alias("value"))


_TREND = "CASE WHEN layer = 'density' THEN coalesce(sum(incoming) {0} / sum(extra) {0}, {1}) ELSE coalesce(sum(value) {0}, {1}) END"


@query(
    TABLES,
    _FLOW_ROWS
    + f" SELECT layer, month, CAST(round({_TREND.format('FILTER (WHERE true)', 'NULL')}, 3) AS DOUBLE) AS total, CAST(round(max(value), 3) AS DOUBLE) AS top, CAST(round({_TREND.format('FILTER (WHERE is_capital)', 0)}, 3) AS DOUBLE) AS capital, CAST(round({_TREND.format('FILTER (WHERE is_border)', 0)}, 3) AS DOUBLE) AS border FROM tall GROUP BY layer, month",
)
def k4_layer_trend(t: Source) -> DataFrame:
    rounded = [F.round(c, 3).alias(c) for c in ("total", "top", "capital", "border")]
    return layers.trend(_monthly(t)).select("layer", "month", *rounded).orderBy("layer", "month")


@query(
    TABLES + " wealth indicators points",
    _FLOW_ROWS
    + _OTHER_ROWS
    + """, bars AS (SELECT layer, place, place_name, value, CAST(NULL AS DOUBLE) AS extra FROM shown WHERE layer IN ('cases', 'uganda_border') UNION ALL SELECT layer, place, place_name, incoming, value FROM shown WHERE layer = 'rwi' AND incoming > 0)
    SELECT layer, rank, place, place_name, CAST(round(value, 3) AS DOUBLE) AS value, CAST(round(extra, 3) AS DOUBLE) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY value DESC, place) AS rank FROM bars) WHERE rank <= 12""",
)
def k4_layer_bars(t: Source) -> DataFrame:
    """What the layers without months show in a trend's place."""
    return layers.bars(_shown(t), 12).select("layer", "rank", "place", "place_name", F.round("value", 3).alias("value"), F.round("extra", 3).alias("extra"))


_SHARES = [0.2, 0.4, 0.6, 0.8]


@query(
    TABLES,
    _FLOW_ROWS
    + """, spans AS (SELECT layer, month AS span, value FROM tall UNION ALL SELECT layer, left(month, 4), value FROM tall UNION ALL SELECT layer, 'all', value FROM tall)
    SELECT layer, span, count(*) AS n, CAST(round(quantile_disc(value, 0.2), 3) AS DOUBLE) AS b1, CAST(round(quantile_disc(value, 0.4), 3) AS DOUBLE) AS b2, CAST(round(quantile_disc(value, 0.6), 3) AS DOUBLE) AS b3, CAST(round(quantile_disc(value, 0.8), 3) AS DOUBLE) AS b4 FROM spans GROUP BY 1, 2""",
)
def d9_breaks_of_spans(t: Source) -> DataFrame:
    """Class breaks of every layer by month, year and over all, from one pass: months are sketched, years and the whole are merged from them.

    Sketches hold more values here than a layer has, so the breaks are exact.
    """
    size = 4096
    months = materialize(sketches.sketched(_monthly(t), ["layer", "month"], "value", size), "sketches").withColumnRenamed("month", "span")
    years = sketches.merged(months.withColumn("span", F.substring("span", 1, 4)), ["layer", "span"], size)
    whole = sketches.merged(years.withColumn("span", F.lit("all")), ["layer", "span"], size)
    found = months.unionByName(years).unionByName(whole).withColumn("b", sketches.quantiles(_SHARES))
    return found.select("layer", "span", "n", *[F.round(F.col("b")[k], 3).alias(f"b{k + 1}") for k in range(4)])


@query(
    TABLES,
    _FLOW_ROWS
    + """ SELECT CAST(grouping_id(layer, month, province) AS INTEGER) AS level, layer, month, province, CAST(round(sum(value), 3) AS DOUBLE) AS total, CAST(round(max(value), 3) AS DOUBLE) AS top, count(*) AS places, CAST(round(sum(incoming) / nullif(sum(value), 0), 6) AS DOUBLE) AS ratio
    FROM (SELECT tall.*, z.province FROM tall LEFT JOIN zones z ON place = z.zone_id) GROUP BY GROUPING SETS ((layer, month, province), (layer, month), (layer, province), (layer), ())""",
)
def k4_grouping_sets(t: Source) -> DataFrame:
    """Totals of the layers by month and province, by either, and over all, from one aggregate; ``level`` tells a total from a place without province."""
    layer, month, province = F.col("layer"), F.col("month"), F.col("province")
    rows = _monthly(t).groupingSets([[layer, month, province], [layer, month], [layer, province], [layer], []], layer, month, province)
    found = rows.agg(F.grouping_id(layer, month, province).cast("int").alias("level"), F.sum("value").alias("total"), F.max("value").alias("top"), F.count(F.lit(1)).alias("places"), F.try_divide(F.sum("incoming"), F.nullif(F.sum("value"), F.lit(0.0))).alias("ratio"))
    return found.select("level", "layer", "month", "province", F.round("total", 3).alias("total"), F.round("top", 3).alias("top"), "places", F.round("ratio", 6).alias("ratio"))
