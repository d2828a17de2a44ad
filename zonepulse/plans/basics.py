"""Set operations, ordering and scan queries over the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.functions.geo import EARTH_KM, polygon_measures, square
from zonepulse.operators.keys import first_rows
from zonepulse.plans.registry import Source, query


@query("zones", "SELECT p_partkey, p_name, rank FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 12")
def f1_top_n(t: Source) -> DataFrame:
    from zonepulse.operators.mobility import top

    return top(t.part, "p_retailprice", 12, "p_partkey").select("p_partkey", "p_name", F.col("rank").cast("long").alias("rank"))


@query("zones", "SELECT DISTINCT p_name, CAST(length(p_name) AS INT) AS size FROM part ORDER BY size DESC, p_name")
def f4_longest_first(t: Source) -> DataFrame:
    return t.part.select("p_name", F.length("p_name").alias("size")).distinct().orderBy(F.desc("size"), "p_name")


@query("zones", "SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def f5_stable_latest(t: Source) -> DataFrame:
    """Ties on the day go to the last position, as a stable sort gives."""
    best = F.max_by(F.struct("event_id", "ts"), F.struct(F.to_date("ts"), "event_id")).alias("r")
    return t.events.groupBy("event_type").agg(best).select("event_type", "r.event_id", "r.ts")


@query("reports", "SELECT 'observed' AS kind, date, CAST(cumulative AS DOUBLE) AS value FROM reports UNION ALL SELECT 'projected', date + 30, cumulative * 1.5 FROM reports")
def g2_concatenation(t: Source) -> DataFrame:
    seen = t.reports.select(F.lit("observed").alias("kind"), "date", F.col("cumulative").cast("double").alias("value"))
    ahead = t.reports.select(F.lit("projected").alias("kind"), F.date_add("date", 30).alias("date"), (F.col("cumulative") * 1.5).alias("value"))
    return seen.unionByName(ahead)


@query("cases", "SELECT health_zone FROM cases WHERE confirmed_cases > 0 AND date = DATE '2000-06-30' EXCEPT SELECT health_zone FROM cases WHERE confirmed_cases > 0 AND date = DATE '1995-01-31'")
def g3_set_difference(t: Source) -> DataFrame:
    at = lambda d: t.cases.where((F.col("confirmed_cases") > 0) & (F.col("date") == F.lit(d).cast("date"))).select("health_zone")
    return at("2000-06-30").subtract(at("1995-01-31"))


@query("zones", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def g4_ordered_dedupe(t: Source) -> DataFrame:
    return first_rows(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("zones", "SELECT n_nationkey, n_name || chr(10) || 'second \"line\"' AS n_name, n_regionkey FROM nation")
def a1_required_scan(t: Source) -> DataFrame:
    """A CSV with header, written to the shared folder and read with its types; quoted text spans lines."""
    from zonepulse.sources import shared, tables

    path = shared.new_path(t.spark, "required")
    tables.write_csv(t.nation.select("n_nationkey", F.concat("n_name", F.lit('\nsecond "line"')).alias("n_name"), "n_regionkey"), path)
    return tables.scan_csv(t.spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT")


@query("zones", "SELECT n_name, CAST(NULL AS VARCHAR) AS notes FROM nation")
def a2_optional_scan(t: Source) -> DataFrame:
    """A missing optional table joins as empty."""
    from zonepulse.sources.tables import scan_optional_csv

    extra = scan_optional_csv(t.spark, f"{t.sf_dir}/absent.csv", "n_name STRING, notes STRING")
    return t.nation.select("n_name").join(extra, "n_name", "left")


@query("zones", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS s_nationkey FROM supplier")
def a6_string_scan(t: Source) -> DataFrame:
    """A CSV read as text in every column, blanks as ''."""
    from zonepulse.sources import shared, tables

    path = shared.new_path(t.spark, "strings")
    tables.write_csv(t.supplier.select("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey")), path)
    return tables.scan_strings(t.spark, path)


@query("zones", "SELECT 'cases' AS name, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'scenarios', 0")
def a7_load_all(t: Source) -> DataFrame:
    """All known tables of a folder, missing ones empty."""
    from zonepulse.sources import shared, tables

    path = shared.new_path(t.spark, "folder")
    tables.write_csv(t.nation.select(F.lit("2000-01-01").alias("date"), F.col("n_name").alias("month")), f"{path}/cases.csv")
    found = tables.load_all(t.spark, path)
    count = lambda name: found[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("cases").unionByName(count("scenarios"))


@query("zones", "SELECT user_id, start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS end, count(*) AS n FROM (SELECT *, min(ts) OVER (PARTITION BY user_id, s) AS start FROM (SELECT *, sum(CASE WHEN ts < p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))) GROUP BY user_id, s, start")
def l2_sessions(t: Source) -> DataFrame:
    from zonepulse.streaming.ingest import sessions

    return sessions(t.events)


def _streamed(t: Source, rows: DataFrame, mode: str, label: str) -> DataFrame:
    """The streaming table's output so far, written by batches to the shared folder."""
    from zonepulse.sources import shared

    path = shared.new_path(t.spark, label)
    running = rows.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{path}/out")


def _event_stream(t: Source) -> DataFrame:
    from zonepulse.sources import shared

    path = shared.new_path(t.spark, "events")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


@query("zones", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= date_trunc('second', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE")
def l3_stream_windows(t: Source) -> DataFrame:
    """Windows that the watermark closed, as a stream emits them."""
    from zonepulse.streaming.ingest import windowed_counts

    rows = _streamed(t, windowed_counts(_event_stream(t)), "append", "windows")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("zones", "SELECT DISTINCT user_id, event_type FROM events")
def l4_stream_dedupe(t: Source) -> DataFrame:
    """One event of each user and type from a stream, within a watermark longer than the table."""
    from zonepulse.streaming.ingest import deduplicated

    return _streamed(t, deduplicated(_event_stream(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "4000 days").select("user_id", "event_type"), "append", "dedupe")


@query("zones", "e AS (SELECT user_id % 500 AS k, user_id AS v, event_id FROM events WHERE user_id % 11 <> 0) SELECT 'published' AS kind, k, max_by(v, event_id) AS v FROM e GROUP BY 2 UNION ALL SELECT 'held', user_id % 500, user_id FROM events WHERE user_id % 11 = 0")
def l5_incremental_ingest(t: Source) -> DataFrame:
    """Landed files polled twice by one source: valid rows upserted, others held, a repeated batch published once."""
    from zonepulse.sources import shared, tables
    from zonepulse.streaming import ingest

    spark, path = t.spark, shared.new_path(t.spark, "ingest")
    schema = "k BIGINT, v BIGINT, event_id BIGINT"
    rows = t.events.select((F.col("user_id") % 500).alias("k"), F.col("user_id").alias("v"), "event_id")
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    last: list[DataFrame] = []
    publish = ingest.split_publish(F.col("v") % 11 != 0, f"{path}/table", f"{path}/held", "landing", F.col("event_id"))

    def twice(batch: DataFrame, number: int) -> None:
        publish(batch, number)
        publish(batch, number)
        last.append(number)

    for n, part in enumerate((rows.where(F.col("event_id") <= middle), rows.where(F.col("event_id") > middle))):
        # a poll's files are one batch; its rows carry their order
        tables.write_csv(part, f"{path}/landing/{n}")
        ingest.ingest(spark, f"{path}/landing/*", schema, f"{path}/checkpoint", twice).awaitTermination()
    published = ingest.current(spark, f"{path}/table", ["k"]).select(F.lit("published").alias("kind"), "k", "v")
    return published.unionByName(spark.read.schema(schema).json(f"{path}/held/*").select(F.lit("held").alias("kind"), "k", "v"))


_DAILY = "d AS (SELECT user_id % 40 AS k, CAST(ts AS DATE) AS date, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1, 2), c AS (SELECT k, date, row_number() OVER (PARTITION BY k ORDER BY date) AS number, CAST(sum(n) OVER (PARTITION BY k ORDER BY date) AS BIGINT) AS cumulative FROM d)"
_FIRST, _SECOND = "date <= DATE '2024-01-12'", "date BETWEEN DATE '2024-01-09' AND DATE '2024-01-20'"
_THIRD = "date >= DATE '2024-01-18'"


def _daily_reports(t: Source) -> DataFrame:
    from pyspark.sql import Window as W

    daily = t.events.groupBy((F.col("user_id") % 40).alias("k"), F.to_date("ts").alias("date")).agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("n"))
    order = W.partitionBy("k").orderBy("date")
    return daily.select(F.col("k").cast("string").alias("source"), F.row_number().over(order).cast("long").alias("number"), "date", F.sum("n").over(order).alias("cumulative"))


@query(
    "zones",
    _DAILY
    + f""", r AS (SELECT *, lag(cumulative) OVER (PARTITION BY k ORDER BY number) IS DISTINCT FROM cumulative AS rose FROM c),
s AS (SELECT *, max(date) FILTER (WHERE rose) OVER (PARTITION BY k ORDER BY number) AS since FROM r),
q AS (SELECT k, since, max(number) AS number, max(cumulative) AS cumulative FROM (SELECT *, max(date) OVER (PARTITION BY k) AS fin FROM s) s WHERE date <= since + 1 GROUP BY k, since, fin
  HAVING fin > since + 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.k = s.k AND rose AND r.date = since + 1))
SELECT CAST(k AS VARCHAR) AS source, 'accepted' AS kind, number, date, cumulative, since FROM s
UNION ALL SELECT CAST(k AS VARCHAR), 'skipped', number, date, cumulative, NULL FROM c WHERE ({_FIRST} AND {_SECOND}) OR ({_SECOND} AND {_THIRD})
UNION ALL SELECT CAST(k AS VARCHAR), 'quiet', number, since + 1, cumulative, since FROM q""",
)
def l6_report_watch(t: Source) -> DataFrame:
    """Daily reports of 40 sources in three polls that overlap: accepted, skipped, and quiet after a day without a rise."""
    from zonepulse.sources import shared
    from zonepulse.streaming import stateful

    path, rows = shared.new_path(t.spark, "watch"), _daily_reports(t)

    def run(reports: DataFrame):
        watched = stateful.watched_reports(reports, 1, "12 days")
        return watched.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    stateful.polled(rows, [F.expr(x) for x in (_FIRST, _SECOND, _THIRD)], f"{path}/landing", run)
    return t.spark.read.schema(stateful.ReportWatch.OUT).parquet(f"{path}/out")


_LANDED = "number long, date date, report_no string, cumulative long, deaths long"


@query("reports", "SELECT 'batch' AS way, number, date, report_no, cumulative, deaths FROM reports UNION ALL SELECT 'stream', number, date, report_no, cumulative, deaths FROM reports WHERE number <> 3 UNION ALL SELECT 'newer', number, date, report_no, cumulative, deaths FROM reports WHERE number > 12")
def a5_landed_reports(t: Source) -> DataFrame:
    """Reports in a folder a number, read by the library's own source: whole, from a number on, and by a stream that passes over one landed late."""
    from zonepulse.sources import landed, shared

    landed.register(t.spark)
    path, rows = shared.new_path(t.spark, "landed"), t.reports.select("number", "date", "report_no", "cumulative", "deaths")

    def land(test: str) -> None:
        rows.where(test).write.mode("append").partitionBy("number").json(f"{path}/in")

    def poll() -> None:
        stream = t.spark.readStream.format("landed_reports").schema(_LANDED).load(f"{path}/in")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for test in ("number < 8 AND number <> 3", "number >= 8 OR number = 3"):
        land(test)
        poll()
    read = t.spark.read.format("landed_reports").schema(_LANDED).option("filesPerPartition", 4)
    whole, newer = read.load(f"{path}/in"), read.option("newerThan", 12).load(f"{path}/in")
    found = {"batch": whole, "stream": t.spark.read.schema(_LANDED).parquet(f"{path}/out"), "newer": newer}
    out = None
    for way, part in found.items():
        part = part.select(F.lit(way).alias("way"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_EARLY, _LATER, _BEHIND = "ts < TIMESTAMP '2024-01-15' AND event_id % 10 <> 0", "ts >= TIMESTAMP '2024-01-15' AND event_id % 10 <> 0", "event_id % 10 = 0"


@query(
    "zones",
    "p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view') SELECT 'pair' AS kind, p.event_id AS event_id, v.event_id AS seen_id FROM p JOIN v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 12 HOUR AND p.ts "
    + f"UNION ALL SELECT 'late', event_id, NULL FROM events e WHERE event_type IN ('purchase', 'view') AND {_BEHIND} AND ts <= (SELECT max(ts) FROM events m WHERE m.event_type = e.event_type AND m.event_id % 10 <> 0) - INTERVAL 30 MINUTE",
)
def l7_interval_join(t: Source) -> DataFrame:
    """Purchases with the user's views of twelve hours before, from two streams; rows behind the watermark are kept and joined too."""
    from zonepulse.sources import shared
    from zonepulse.streaming import stateful

    spark, path, span, late = t.spark, shared.new_path(t.spark, "interval"), "12 HOURS", "30 MINUTES"
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    sides = {"purchase": rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), "view": rows.where("event_type = 'view'").select(F.col("event_id").alias("seen_id"), "user_id", F.col("ts").alias("seen_ts"))}
    tests = {"purchase": [_EARLY, _LATER, _BEHIND], "view": [x.replace("ts ", "seen_ts ").replace("event_id", "seen_id") for x in (_EARLY, _LATER, _BEHIND)]}
    for number in range(3):
        for side, table in sides.items():
            table.where(tests[side][number]).write.parquet(f"{path}/{side}/{number}")
        streams = {side: spark.readStream.schema(table.schema).parquet(f"{path}/{side}/*") for side, table in sides.items()}
        joined = stateful.interval_join(streams["purchase"], streams["view"], ["user_id"], "ts", "seen_ts", span, late).select("event_id", "seen_id")
        running = [joined.writeStream.format("parquet").outputMode("append").option("path", f"{path}/pairs").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()]
        running += [stateful.kept_late(streams[side], time, late, f"{path}/late-{side}", f"{path}/checkpoint-{side}") for side, time in (("purchase", "ts"), ("view", "seen_ts"))]
        for each in running:
            each.awaitTermination()
    behind = {side: spark.read.schema(table.schema).parquet(f"{path}/late-{side}") for side, table in sides.items()}
    whole = {side: spark.read.schema(table.schema).parquet(f"{path}/{side}/*") for side, table in sides.items()}
    more = stateful.late_pairs(whole["purchase"], whole["view"], behind["purchase"], behind["view"], ["user_id"], "ts", "seen_ts", span).select("event_id", "seen_id")
    pairs = spark.read.schema(more.schema).parquet(f"{path}/pairs").unionByName(more).distinct()
    kept = behind["purchase"].select("event_id").unionByName(behind["view"].select(F.col("seen_id").alias("event_id")))
    return pairs.select(F.lit("pair").alias("kind"), "event_id", "seen_id").unionByName(kept.select(F.lit("late").alias("kind"), "event_id", F.lit(None).cast("long").alias("seen_id")))


@query("zones", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def l1_hourly_windows(t: Source) -> DataFrame:
    from zonepulse.streaming.ingest import windowed_counts

    return windowed_counts(t.events).select("start", "event_type", "n")


@query("zones", f"SELECT zone_id, CASE WHEN k % 5 < 3 THEN round({EARTH_KM} * {EARTH_KM} * radians(1) * (sin(radians(lat + 1)) - sin(radians(lat))), 3) END AS area_km2, CASE WHEN k % 5 < 3 THEN lat + 0.5 END AS lat, CASE WHEN k % 5 < 3 THEN lon + 0.5 END AS lon FROM (SELECT *, CAST(zone_id AS INT) AS k FROM zones)")
def h16_polygon_measures(t: Source) -> DataFrame:
    """Area and centroid of a square at each zone; null for a null geometry and for an empty ring."""
    k = F.col("zone_id").cast("int") % 5
    shape = F.when(k == 3, "null").when(k == 4, '{"type":"Polygon","coordinates":[[]]}').otherwise(square("lon", "lat"))
    return t.zones.select("zone_id", polygon_measures(shape).alias("m")).select("zone_id", F.round("m.area_km2", 3).alias("area_km2"), "m.lat", "m.lon")


@query("zones", "SELECT zone_id, zone_name AS name, area_km2 IS NOT NULL AS has_area FROM zones")
def a3_geojson_features(t: Source) -> DataFrame:
    """A GeoJSON document per zone, read back as features."""
    from zonepulse.sources.tables import geojson_features, property_of

    text = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("zone_name").alias("nom"), "area_km2").alias("properties"), F.struct(F.lit("Point").alias("type")).alias("geometry"))).alias("features")))
    rows = geojson_features(t.zones.select("zone_id", text.alias("value")), keep=("zone_id",))
    return rows.select("zone_id", property_of(["name", "nom"]).alias("name"), property_of(["area_km2"]).isNotNull().alias("has_area"))


@query("zones", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def a4_json_documents(t: Source) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long").alias("j")).select("event_id", "j.k")


@query("zones", "SELECT conv_id AS doc_id, string_agg('--- PAGE ' || turn || ' ---' || chr(10) || text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def a12_page_text(t: Source) -> DataFrame:
    from zonepulse.sources.tables import page_text

    return page_text(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("zones", "SELECT p_partkey, CAST(2 AS INT) AS n_rows, p_name AS first_cell, p_brand AS last_cell FROM part")
def a13_cell_grids(t: Source) -> DataFrame:
    from zonepulse.sources.tables import cell_grid

    text = F.concat(F.col("p_name"), F.lit(" | x ;  y"), F.lit("\n"), F.lit("a;b | "), F.col("p_brand"))
    grid = t.part.select("p_partkey", cell_grid(text).alias("g"))
    return grid.select("p_partkey", F.size("g").alias("n_rows"), F.col("g")[0][0].alias("first_cell"), F.element_at(F.element_at("g", -1), -1).alias("last_cell"))


@query("zones", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS line FROM nation""")
def a17_audit_lines(t: Source) -> DataFrame:
    from zonepulse.operators.publish import audit_lines

    return audit_lines(t.nation, ["n_nationkey", "n_name"])


@query("reports", "SELECT report_no, CASE WHEN cumulative > 200 AND deaths % 2 = 0 THEN 'published' ELSE 'needs review' END AS status, concat_ws(',', CASE WHEN NOT cumulative > 200 THEN 'total' END, CASE WHEN NOT deaths % 2 = 0 THEN 'deaths' END) AS reasons FROM reports")
def a21_quarantine(t: Source) -> DataFrame:
    from zonepulse.operators.publish import quarantined

    return quarantined(t.reports, {"total": F.col("cumulative") > 200, "deaths": F.col("deaths") % 2 == 0}).select("report_no", "status", "reasons")


@query("zones", "SELECT p_partkey, nfc_normalize(p_name) || ' 1/2 fi' AS clean FROM part")
def h2_compatibility_form(t: Source) -> DataFrame:
    from zonepulse.functions.text import nfkc

    return t.part.select("p_partkey", F.replace(nfkc(F.concat("p_name", F.lit(" ½ ﬁ"))), F.lit("⁄"), F.lit("/")).alias("clean"))


@query()
def h17_random_draws(t: Source) -> DataFrame:
    """Moments of the seeded draws; the tests hold them to their distributions."""
    from zonepulse.operators.models import draws

    rows = draws(t.spark, ["a", "b", "c"], 2000, 6.0, 0.4)
    return rows.groupBy("seed").agg(*[F.round(f(c), 4).alias(f"{c}_{n}") for c in ("normal", "gamma", "poisson", "negative_binomial") for n, f in (("mean", F.avg), ("variance", F.var_samp))])


def _draws_sql() -> str:
    times = lambda x, y: f"CAST((CAST({x} AS HUGEINT) * {y}) % 4294967296 AS BIGINT)"
    seed = times(f"xor({times('xor(2166136261, 115)', 16777619)}, 48 + r_regionkey)", 16777619)
    steps = f"""
w AS (SELECT r_regionkey, {seed} AS seed FROM region), k AS (SELECT *, unnest(generate_series(1, 400)) AS k FROM w),
a AS (SELECT *, (seed + k * 1831565813) % 4294967296 AS a FROM k), b AS (SELECT *, {times("xor(a, a >> 15)", "(a | 1)")} AS b FROM a),
c AS (SELECT *, xor(b, (b + {times("xor(b, b >> 7)", "(b | 61)")}) % 4294967296) AS c FROM b), u AS (SELECT seed, r_regionkey, k, xor(c, c >> 14) / 4294967296.0 AS u FROM c)"""
    return steps + " SELECT x.r_regionkey, x.seed, CAST((x.k + 1) // 2 AS INT) AS k, CAST(round(x.u, 9) AS DOUBLE) AS first, CAST(round(y.u, 9) AS DOUBLE) AS second, CAST(round(sqrt(-2 * ln(greatest(x.u, 1e-12))) * cos(2 * pi() * greatest(y.u, 1e-12)), 6) AS DOUBLE) AS normal FROM u x JOIN u y ON x.r_regionkey = y.r_regionkey AND y.k = x.k + 1 WHERE x.k % 2 = 1"


@query("zones", _draws_sql())
def h17_seeded_streams(t: Source) -> DataFrame:
    """Pairs of each seed's stream and the normal number they make."""
    from zonepulse.functions.draws import normal, seed_of, uniform

    rows = t.region.select("r_regionkey", seed_of(F.concat(F.lit("s"), F.col("r_regionkey").cast("string"))).alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(200))).alias("k"))
    seed, k = F.col("seed"), F.col("k")
    return rows.select("r_regionkey", "seed", "k", F.round(uniform(seed, 2 * k - 1), 9).alias("first"), F.round(uniform(seed, 2 * k), 9).alias("second"), F.round(normal(seed, k), 6).alias("normal"))
