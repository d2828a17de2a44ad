"""The concept tables (zones, flows, cases, ...) derived from the star schema.

Each is one SQL text that Spark and DuckDB both run; where their functions differ
the text uses a marker that each dialect replaces. ``load`` gives the Spark
DataFrame, ``ctes`` the WITH clause of an oracle query.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "region nation customer supplier part orders lineitem events documents pages conversations labels".split()

TABLES: dict[str, str] = {
    # zone 23 occurs in flows only and zone 24 in zones only, as a full outer join needs
    "zones": """
      SELECT CAST(n_nationkey AS STRING) AS zone_id, n_name AS zone_name, r_name AS province,
        CASE r_name WHEN 'AFRICA' THEN 'kinshasa' WHEN 'ASIA' THEN 'uganda_border' ELSE 'other' END AS category,
        CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END AS is_uganda_border, CASE WHEN r_name = 'AFRICA' THEN 1 ELSE 0 END AS is_kinshasa,
        CAST((n_nationkey * 7) % 20 - 14 AS DOUBLE) AS lat, CAST(11 + (n_nationkey * 5) % 21 AS DOUBLE) AS lon,
        CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST(1000 + 250 * r_regionkey AS DOUBLE) END AS area_km2
      FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey <> 23""",
    # summed by numbers and dates; the few sums take their names behind
    "flows": """
      SELECT MONTH_OF(begun) AS month, CAST(o AS STRING) AS origin_id, CAST(d AS STRING) AS destination_id, movement
      FROM (SELECT date_trunc('month', o_orderdate) AS begun, c_nationkey AS o, s_nationkey AS d, CAST(sum(l_quantity) AS BIGINT) AS movement
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
        WHERE s_nationkey <> 24 GROUP BY 1, 2, 3) m""",
    # every sixth zone is known by name only, every fourth has no cases
    "cases": """
      WITH monthly AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS counted, c_nationkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n,
        sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS d FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2)
      SELECT month_end AS date, MONTH_OF(month_end) AS month, r_name AS province, n_name AS health_zone,
        CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE CAST(n_nationkey AS STRING) END AS zone_id,
        CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE CAST(sum(n) OVER (PARTITION BY n_nationkey ORDER BY month_end) AS BIGINT) END AS confirmed_cases,
        CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE CAST(sum(d) OVER (PARTITION BY n_nationkey ORDER BY month_end) AS BIGINT) END AS confirmed_deaths
      FROM (SELECT month_end, n_nationkey, n_name, n_regionkey, coalesce(n, 0) AS n, coalesce(d, 0) AS d
        FROM (SELECT DISTINCT counted AS month_end FROM monthly) m CROSS JOIN {nation} LEFT JOIN monthly ON counted = month_end AND c_nationkey = n_nationkey) g
      JOIN {region} ON n_regionkey = r_regionkey""",
    # days are left out so that gaps exist
    "reports": """
      SELECT date, concat('N', CAST(row_number() OVER (ORDER BY date) AS STRING)) AS report_no, row_number() OVER (ORDER BY date) AS number,
        cumulative, CAST(floor(cumulative / 5) AS BIGINT) AS deaths, CAST(floor(cumulative / 50) AS BIGINT) AS neighbour_cases
      FROM (SELECT date, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS cumulative
        FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY 1) d) c
      WHERE day(date) % 3 <> 2""",
    "contacts": """
      SELECT r_name AS province, last_day(CAST(o_orderdate AS DATE)) AS date, count(*) AS under_followup,
        CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS seen,
        CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS followup_rate, CAST(0.95 AS DOUBLE) AS target_rate
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
      WHERE month(o_orderdate) % 3 = 0 AND r_name <> 'EUROPE' GROUP BY 1, 2""",
    "indicators": """
      SELECT date, CASE WHEN p = 0 THEN 'national' ELSE 'province' END AS admin_level, concat('P', CAST(p AS STRING)) AS province,
        CASE WHEN v > 0 AND day(date) % 4 <> 1 THEN CAST(b AS DOUBLE) / v END AS contact_followup_rate,
        CASE WHEN k > 0 AND p <> 0 THEN CAST(s AS DOUBLE) / k END AS alert_investigation_rate,
        CASE WHEN day(date) % 5 <> 2 AND e + v > 0 THEN CAST(e AS DOUBLE) / (e + v) END AS poe_screening_coverage,
        CASE WHEN p <> 0 THEN k END AS alerts_reported, CASE WHEN day(date) % 3 <> 0 THEN e END AS samples_analysed,
        CASE WHEN p = 0 OR day(date) % 2 = 0 THEN e + v END AS travellers_screened, CAST(day(date) * 10 + p AS BIGINT) AS pos
      FROM (SELECT CAST(ts AS DATE) AS date, user_id % 5 AS p, count(*) AS n,
          sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS v, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS b,
          sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS k, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS s,
          sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e
        FROM {events} GROUP BY 1, 2) x""",
    "population": "SELECT CAST(c_nationkey AS STRING) AS zone_id, count(*) AS population FROM {customer} WHERE c_nationkey <> 22 GROUP BY 1",
    "wealth": "SELECT CAST(c_nationkey AS STRING) AS zone_id, MEDIAN_OF(cents) AS rwi FROM (SELECT c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM {customer}) c GROUP BY 1",
    "scenarios": "SELECT * FROM (VALUES ('low', 'Low', CAST(0.05 AS DOUBLE)), ('mid', 'Middle', CAST(0.15 AS DOUBLE)), ('high', 'High', CAST(0.30 AS DOUBLE))) AS t(scenario_id, scenario_name, fraction)",
    "air_rules": "SELECT * FROM (VALUES ('category', 'kinshasa', CAST(0.6 AS DOUBLE)), ('zone_name', 'NATION_5', CAST(0.4 AS DOUBLE)), ('zone_name', 'NATION_7', CAST(0.8 AS DOUBLE)), ('category', 'uganda_border', CAST(1.0 AS DOUBLE))) AS t(match_type, match_value, air_factor)",
    "profile": "SELECT * FROM (VALUES ('u1', 'West', CAST(0.5 AS DOUBLE), CAST(400 AS BIGINT)), ('u2', 'North', CAST(0.3 AS DOUBLE), CAST(250 AS BIGINT)), ('u3', 'Capital', CAST(0.1 AS DOUBLE), CAST(0 AS BIGINT))) AS t(district_id, district, weight, observed)",
    # monitoring points of the districts in "profile"
    "points": """
      SELECT concat('f', CAST(n_nationkey AS STRING)) AS point_id, n_name AS point, CASE n_nationkey % 3 WHEN 0 THEN 'u1' WHEN 1 THEN 'u2' ELSE 'u3' END AS district_id, count(*) AS observed
      FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1, 2, 3""",
    "analog_curves": """
      SELECT event_type AS outbreak_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY date) - 1 AS INT) AS day,
        CAST(sum(n) OVER (PARTITION BY event_type ORDER BY date) AS BIGINT) AS cases
      FROM (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM {events} GROUP BY 1, 2) x""",
}

_NEEDS = {name: [t for t in BASE if "{" + t + "}" in text] for name, text in TABLES.items()}


def _dialect(text: str, month: str, median: str) -> str:
    return re.sub(r"MEDIAN_OF\((\w+)\)", median, re.sub(r"MONTH_OF\((\w+)\)", month, text))


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, month: str | None = None) -> DataFrame:
    """The concept or base table as a lazy DataFrame; of flows only one month if named, by a range that reaches the scan."""
    if name not in TABLES:
        return base(spark, sf_dir, name)
    text = _dialect(TABLES[name], r"date_format(\1, 'yyyy-MM')", r"percentile(\1, 0.5)")
    held = {t: base(spark, sf_dir, t) for t in _NEEDS[name]}
    if month is not None:
        first = datetime.datetime.strptime(month, "%Y-%m")
        after = (first + datetime.timedelta(days=32)).replace(day=1)
        held["orders"] = held["orders"].where((F.col("o_orderdate") >= F.lit(first)) & (F.col("o_orderdate") < F.lit(after)))
    return spark.sql(text, **held)


def sql(name: str) -> str:
    text = _dialect(TABLES[name], r"strftime(\1, '%Y-%m')", r"quantile_cont(\1, 0.5)")
    return re.sub(r"\{(\w+)\}", r"\1", text)


def ctes(names: str, body: str) -> str:
    """An oracle query over concept tables; body may begin with further CTEs."""
    head = ",\n".join(f"{n} AS ({sql(n)})" for n in names.split())
    body = body.strip()
    return f"WITH {head}{',' if not body.upper().startswith('SELECT') else ''}\n{body}" if head else body
