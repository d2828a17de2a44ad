"""Cases, series, reproduction numbers, indicators, statistics, models and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonepulse.functions.numbers import quintile_label
from zonepulse.operators import asof, assess, indicators, mobility, models, series, stats
from zonepulse.plans.registry import Source, query

DAY, REPORT_DAY = "2000-06-30", "2024-01-28"


def r(column: str, places: int = 4):
    return F.round(F.col(column), places).alias(column)


_TWO = f"""
b AS (SELECT coalesce(max(date) FILTER (WHERE date <= DATE '{DAY}' - 7), min(date)) AS d FROM cases),
now AS (SELECT *, coalesce(zone_id, lower(health_zone) || '|' || lower(province)) AS k FROM cases WHERE date = DATE '{DAY}'),
base AS (SELECT coalesce(zone_id, lower(health_zone) || '|' || lower(province)) AS k, confirmed_cases AS c, confirmed_deaths AS e FROM cases, b WHERE date = b.d),
recent AS (SELECT zone_id, health_zone, province, confirmed_cases AS cumulative_cases, greatest(0, confirmed_cases - coalesce(c, 0)) AS recent_cases, greatest(0, confirmed_deaths - coalesce(e, 0)) AS recent_deaths FROM now LEFT JOIN base USING (k))"""


@query("cases", f"SELECT coalesce(max(date) FILTER (WHERE date <= DATE '{DAY}' - 7), min(date)) AS baseline FROM cases")
def c11_baseline_date(t: Source) -> DataFrame:
    return asof.baseline_date(t.cases, "date", DAY)


@query("cases", _TWO + " SELECT health_zone, cumulative_cases, recent_cases FROM recent")
def c12_baseline_diff(t: Source) -> DataFrame:
    return asof.increase(t.cases, DAY).select("health_zone", "cumulative_cases", "recent_cases")


@query("cases", _TWO + " SELECT health_zone, province, cumulative_cases, recent_cases, recent_deaths FROM recent")
def e5_recent_increase(t: Source) -> DataFrame:
    return asof.increase(t.cases, DAY).select("health_zone", "province", "cumulative_cases", "recent_cases", "recent_deaths")


@query("reports", "SELECT report_no, date, cumulative FROM reports WHERE date = (SELECT coalesce(max(date) FILTER (WHERE date <= DATE '2024-01-20'), max(date)) FROM reports)")
def c16_record_lookup(t: Source) -> DataFrame:
    return asof.latest_or_last(t.reports, "date", "2024-01-20").select("report_no", "date", "cumulative")


@query("reports", "e AS (SELECT event_id, ts FROM events WHERE event_type = 'error'), m AS (SELECT e.event_id, r.report_no, r.cumulative, r.date FROM e ASOF LEFT JOIN reports r ON e.ts >= CAST(r.date AS TIMESTAMP)) SELECT event_id, report_no, cumulative FROM m")
def c16_record_of_every_row(t: Source) -> DataFrame:
    """Every error event with the report that was the latest at its time: no key, so all rows are one hot key."""
    found = asof.asof_join(t.events.where("event_type = 'error'").select("event_id", "ts"), t.reports.select("date", "report_no", "cumulative"), [], "ts", "date")
    return found.select("event_id", "matched.report_no", "matched.cumulative")


@query(
    "cases",
    "k AS (SELECT *, coalesce(zone_id, lower(health_zone) || '|' || lower(province)) AS k FROM cases), f AS (SELECT k, min_by(confirmed_cases, date) AS c, min_by(confirmed_deaths, date) AS e FROM k GROUP BY 1), "
    "m AS (SELECT a.date, a.health_zone, a.k, a.confirmed_cases, a.confirmed_deaths, b.confirmed_cases AS bc, b.confirmed_deaths AS be FROM k a ASOF LEFT JOIN k b ON a.k = b.k AND a.date - 7 >= b.date) "
    "SELECT date, health_zone, greatest(0, confirmed_cases - coalesce(bc, c)) AS recent_cases, greatest(0, confirmed_deaths - coalesce(be, e)) AS recent_deaths FROM m LEFT JOIN f USING (k)",
)
def c12_increase_every_row(t: Source) -> DataFrame:
    """Every case row's increase since its zone's latest row at least seven days older, or the first."""
    keyed = t.cases.withColumn("__zone", F.coalesce("zone_id", F.concat_ws("|", F.lower("health_zone"), F.lower("province")))).withColumn("until", F.date_sub("date", 7))
    found = asof.asof_join(keyed, keyed.select("__zone", "date", "confirmed_cases", "confirmed_deaths"), ["__zone"], "until", "date", else_first=True)
    up = lambda c: F.greatest(F.lit(0), F.col(c) - F.col(f"matched.{c}"))
    return found.select("date", "health_zone", up("confirmed_cases").alias("recent_cases"), up("confirmed_deaths").alias("recent_deaths"))


@query("reports", "SELECT report_no, lag(report_no) OVER (ORDER BY date) AS previous_no, lag(cumulative) OVER (ORDER BY date) AS previous FROM reports")
def c17_previous_report(t: Source) -> DataFrame:
    w = W.orderBy("date")
    return t.reports.select("report_no", F.lag("report_no").over(w).alias("previous_no"), F.lag("cumulative").over(w).alias("previous"))


@query("reports", "SELECT max_by(report_no, number) AS report_no, max_by(cumulative, number) AS cumulative FROM reports WHERE number < 9")
def c18_previous_by_number(t: Source) -> DataFrame:
    return t.reports.where("number < 9").agg(F.max_by(F.struct("report_no", "cumulative"), F.struct("number", "date")).alias("r")).select("r.report_no", "r.cumulative")


@query("reports", "x AS (SELECT date, cumulative, number AS pos FROM reports UNION ALL SELECT date, cumulative - 1, number + 100 FROM reports UNION ALL SELECT date, cumulative, number + 200 FROM reports UNION ALL SELECT NULL, 5, 1 UNION ALL SELECT DATE '2023-01-01', 0, 1) SELECT date, cumulative, pos FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cumulative DESC, pos DESC) AS rn FROM x WHERE date IS NOT NULL AND cumulative > 0) WHERE rn = 1")
def a5_report_scan(t: Source) -> DataFrame:
    base = t.reports.select("date", "cumulative", F.col("number").cast("long").alias("pos"))
    extra = t.spark.sql("SELECT CAST(NULL AS DATE) AS date, 5L AS cumulative, 1L AS pos UNION ALL SELECT DATE '2023-01-01', 0L, 1L")
    rows = base.unionByName(base.withColumn("cumulative", F.col("cumulative") - 1).withColumn("pos", F.col("pos") + 100)).unionByName(base.withColumn("pos", F.col("pos") + 200)).unionByName(extra)
    return series.best_reports(rows).select("date", "cumulative", "pos")


_DAILY = """
lagged AS (SELECT date, report_no, cumulative, lag(date) OVER (ORDER BY date) AS pd, lag(cumulative) OVER (ORDER BY date) AS pv FROM reports),
days AS (SELECT CAST(d AS DATE) AS date, CASE WHEN pd IS NULL THEN CAST(cumulative AS DOUBLE) ELSE CAST(greatest(0, cumulative - pv) AS DOUBLE) / (date - pd) END AS incidence,
    CASE WHEN pd IS NULL THEN cumulative ELSE pv + CAST(greatest(0, cumulative - pv) AS DOUBLE) / (date - pd) * (CAST(d AS DATE) - pd) END AS cumulative,
    CASE WHEN CAST(d AS DATE) = date THEN report_no END AS report_no
  FROM (SELECT *, unnest(generate_series(CAST(coalesce(pd + 1, date) AS TIMESTAMP), CAST(date AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM lagged))"""


@query("reports", _DAILY + " SELECT date, round(incidence, 4) AS incidence, round(cumulative, 4) AS cumulative, report_no FROM days")
def e3_daily_incidence(t: Source) -> DataFrame:
    return series.daily(t.reports).select("date", r("incidence"), r("cumulative"), "report_no")


_WINDOWS = f""", w AS (SELECT coalesce(sum(incidence) FILTER (WHERE date > DATE '{REPORT_DAY}' - 7 AND date <= DATE '{REPORT_DAY}'), 0) AS recent,
  coalesce(sum(incidence) FILTER (WHERE date > DATE '{REPORT_DAY}' - 14 AND date <= DATE '{REPORT_DAY}' - 7), 0) AS previous FROM days)"""


@query("reports", _DAILY + _WINDOWS + " SELECT round(recent, 4) AS recent, round(previous, 4) AS previous, round(recent / nullif(previous, 0), 4) AS ratio, CASE WHEN previous > 0 THEN 'ratio' WHEN recent > 0 THEN 'infinite' ELSE 'none' END AS status FROM w")
def e4_weekly_ratio(t: Source) -> DataFrame:
    return series.windows(series.daily(t.reports), REPORT_DAY).select(r("recent"), r("previous"), r("ratio"), "status")


@query("reports", _DAILY + f" SELECT round(sum(incidence), 4) AS incidence FROM days WHERE date > DATE '2024-01-10' AND date <= DATE '{REPORT_DAY}'")
def d20_window_sum(t: Source) -> DataFrame:
    held = series.daily(t.reports).where((F.col("date") > F.lit("2024-01-10").cast("date")) & (F.col("date") <= F.lit(REPORT_DAY).cast("date")))
    return held.agg(F.round(F.sum("incidence"), 4).alias("incidence"))


_WEIGHTS = """
raw AS (SELECT CAST(k AS INT) AS lag, exp((5.76 - 1) * ln(k - 0.5) - (k - 0.5) / (25.0 / 12)) AS g FROM generate_series(1, 40) AS s(k)),
weights AS (SELECT lag, g / (SELECT sum(g) FROM raw) AS weight FROM raw)"""


@query("reports", _WEIGHTS + " SELECT lag, round(weight, 9) AS weight FROM weights")
def h14_generation_weights(t: Source) -> DataFrame:
    return series.generation_weights(t.spark, 12.0, 5.0).select("lag", r("weight", 9))


_RENEWAL = _DAILY + "," + _WEIGHTS + ", renewed AS (SELECT a.date, a.incidence, coalesce(sum(b.incidence * weight), 0) AS pressure FROM days a LEFT JOIN (days b CROSS JOIN weights) ON b.date + lag = a.date GROUP BY 1, 2)"


@query("reports", _RENEWAL + " SELECT date, round(incidence, 4) AS incidence, round(pressure, 4) AS pressure FROM renewed")
def e7_renewal_pressure(t: Source) -> DataFrame:
    return series.renewal(series.daily(t.reports), series.generation_weights(t.spark, 12.0, 5.0)).select("date", r("incidence"), r("pressure"))


@query("reports", _DAILY + " SELECT date, round(incidence, 4) AS incidence FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS b, row_number() OVER (ORDER BY date) AS a FROM days) WHERE b <= 10 AND a > 1")
def e8_trailing_window(t: Source) -> DataFrame:
    return series.trailing(series.daily(t.reports), 10).select("date", r("incidence"))


_LAST = ", last AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM renewed)"


@query("reports", _RENEWAL + _LAST + " SELECT round(1 + sum(incidence), 4) AS shape, round(1 + sum(pressure), 4) AS rate, round((1 + sum(incidence)) / (1 + sum(pressure)), 4) AS rt FROM last WHERE b <= 10")
def i1_rt_short_term(t: Source) -> DataFrame:
    return models.rt_posterior(series.daily(t.reports)).select(r("shape"), r("rate"), r("rt"))


@query("reports", _RENEWAL + _LAST + " SELECT round(1.2 + sum(incidence), 4) AS shape, round(1.2 + sum(pressure), 4) AS rate, round((1.2 + sum(incidence)) / (1.2 + sum(pressure)), 4) AS rt FROM last WHERE b <= 10")
def i2_rt_batch(t: Source) -> DataFrame:
    return models.rt_posterior(series.daily(t.reports), models.FINAL_SIZE).select(r("shape"), r("rate"), r("rt"))


def _forecasts(t: Source) -> DataFrame:
    """Each generation interval; the first days of a longer forecast are those of a shorter one."""
    days, out = series.daily(t.reports), None
    for mean in (9.0, 12.0, 15.0):
        ahead = models.forecast(days, REPORT_DAY, preset=models.Preset(mean=mean))
        part = ahead.select(F.lit(mean).alias("mean"), F.explode(F.array(F.lit(7), F.lit(14))).alias("horizon"), "*").where("h <= horizon")
        out = part if out is None else out.unionByName(part)
    return out


_QUANTILES = ("q05", "q25", "q50", "q75", "q95")


def _ordered(columns=_QUANTILES):
    """Aggregate: no quantile is below the one before."""
    return F.bool_and(F.expr(" and ".join(f"{a} <= {b}" for a, b in zip(columns, columns[1:], strict=False)))).alias("ordered")


@query()
def i3_forecast(t: Source) -> DataFrame:
    return _forecasts(t)


@query("reports", "SELECT CAST(m AS DOUBLE) AS mean, CAST(h AS INT) AS horizon, h AS days, 1 AS first_day, CAST(h AS INT) AS last_day, true AS ordered, true AS counts FROM (VALUES (9), (12), (15)) AS a(m), (VALUES (7), (14)) AS b(h) WHERE (SELECT count(*) FROM reports WHERE date <= DATE '2024-01-28') > 3")
def i3_forecast_shape(t: Source) -> DataFrame:
    """What must hold whatever the draws: days, order of quantiles, no negative counts."""
    return _forecasts(t).groupBy("mean", "horizon").agg(F.count(F.lit(1)).alias("days"), F.min("h").alias("first_day"), F.max("h").alias("last_day"), _ordered(), F.bool_and(F.col("q05") >= 0).alias("counts"))


def _final_size(t: Source) -> DataFrame:
    return models.final_size(series.daily(t.reports), REPORT_DAY)


@query()
def i4_final_size(t: Source) -> DataFrame:
    return _final_size(t).agg(*[F.percentile("final_size", q).alias(f"size_q{int(q * 100):02d}") for q in models.QUANTILES], F.percentile("end_h", 0.5).alias("end_median"))


@query("reports", "SELECT 800 AS paths, 0 AS first_path, 799 AS last_path, true AS not_below_now, true AS ends_in_time, true AS whole FROM (SELECT 1) WHERE (SELECT max(date) - min(date) + 1 FROM reports WHERE date <= DATE '2024-01-28') >= 8")
def i4_final_size_shape(t: Source) -> DataFrame:
    """All paths, none below the cases so far, each with an end within the horizon."""
    now = t.reports.where(F.col("date") <= F.lit(REPORT_DAY).cast("date")).agg(F.max("cumulative").alias("now"))
    rows = _final_size(t).crossJoin(F.broadcast(now))
    size = F.col("final_size")
    return rows.agg(F.count(F.lit(1)).alias("paths"), F.min("sim").cast("int").alias("first_path"), F.max("sim").cast("int").alias("last_path"), F.bool_and(size >= F.col("now")).alias("not_below_now"), F.bool_and(F.col("end_h").between(1, 260)).alias("ends_in_time"), F.bool_and(size == F.floor(size)).alias("whole")).where("paths > 0")


_ANALOG = """
seen AS (SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS day, cumulative AS o FROM reports),
ends AS (SELECT outbreak_id, max_by(cases, day) AS final, max(day) AS e FROM analog_curves GROUP BY 1),
grid AS (SELECT outbreak_id, s.day, CAST(o AS DOUBLE) AS o, CAST(coalesce(c.cases, CASE WHEN s.day > e THEN final ELSE 0 END) AS DOUBLE) AS c, (SELECT max(day) FROM seen) AS last FROM seen s CROSS JOIN ends LEFT JOIN analog_curves c USING (outbreak_id, day)),
fit AS (SELECT outbreak_id, least(80, greatest(0.05, sum(o * c) / sum(c * c))) AS scale FROM grid GROUP BY 1),
err AS (SELECT outbreak_id, scale, sqrt(sum((0.65 + 0.7 * day / last) * pow(ln(1 + c * scale) - ln(1 + o), 2)) / sum(0.65 + 0.7 * day / last)) AS rmse FROM grid JOIN fit USING (outbreak_id) GROUP BY 1, 2),
matched AS (SELECT outbreak_id, scale, rmse, 0.7 * exp(-rmse * rmse / (2 * 0.45 * 0.45)) AS weight, scale * final AS final_size, greatest(0, e + 10 - (SELECT max(day) FROM seen)) AS remaining FROM err JOIN ends USING (outbreak_id))"""


def _analogs(t: Source) -> DataFrame:
    observed = t.reports.select((F.row_number().over(W.orderBy("date")) - 1).alias("day"), F.col("cumulative").alias("cases"))
    features = t.analog_curves.groupBy("outbreak_id").agg(F.max_by("cases", "day").alias("final_size"), (F.max("day") + 10).alias("duration"), F.lit(0.7).alias("base_weight"))
    return models.analogs(observed, t.analog_curves, features)


@query("reports analog_curves", _ANALOG + " SELECT outbreak_id, round(scale, 4) AS scale, round(rmse, 4) AS rmse, round(weight, 4) AS weight, round(final_size, 3) AS final_size, CAST(remaining AS INT) AS remaining FROM matched")
def i5_analog_matching(t: Source) -> DataFrame:
    return _analogs(t).select("outbreak_id", r("scale"), r("rmse"), r("weight"), r("final_size", 3), F.col("remaining").cast("int").alias("remaining"))


@query("reports analog_curves", _ANALOG + ", run AS (SELECT final_size, sum(weight) OVER (ORDER BY final_size) AS cum, sum(weight) OVER () AS total FROM matched) SELECT q, round(min(final_size) FILTER (WHERE cum >= q * total), 3) AS final_size FROM run CROSS JOIN (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)) AS v(q) GROUP BY q")
def d11_weighted_quantile(t: Source) -> DataFrame:
    return models.analog_quantiles(_analogs(t), "final_size", (0.25, 0.5, 0.75)).select("q", r("final_size", 3))


@query(
    "reports",
    "s AS (SELECT date AS day, 0.5 + (number % 4) * 0.4 AS rt, cumulative FROM reports), m AS (SELECT day, cumulative * 1.5 AS b, cumulative * 2.0 AS h, CASE WHEN rt < 1 AND cumulative >= 100 THEN 0.2 WHEN cumulative < 100 THEN 0.6 WHEN cumulative <= 500 THEN 0.4 ELSE 0.3 END AS w, row_number() OVER (ORDER BY day) AS n FROM s) SELECT day, CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE w END AS DOUBLE) AS history_weight, CAST(round(CASE WHEN n % 5 = 0 THEN b ELSE w * h + (1 - w) * b END, 4) AS DOUBLE) AS median, CASE WHEN n % 5 <> 0 AND w >= 0.5 THEN 90 ELSE 60 END AS end_median, CASE WHEN n % 5 = 0 THEN 30 ELSE 30 END AS end_low, CASE WHEN n % 5 = 0 THEN 100 ELSE 120 END AS end_high FROM m",
)
def i6_ensemble(t: Source) -> DataFrame:
    rows = t.reports.select(F.col("date").alias("day"), (0.5 + (F.col("number") % 4) * 0.4).alias("rt"), "cumulative", "number")
    shape = lambda f, mid, low, high: [(F.col("cumulative") * f * x).alias(n) for n, x in (("low", 0.5), ("median", 1.0), ("high", 2.0))] + [F.lit(mid).alias("end_median"), F.lit(low).alias("end_low"), F.lit(high).alias("end_high")]
    branching = rows.select("day", *shape(1.5, 60, 30, 100))
    history = rows.where("number % 5 <> 0").select("day", *shape(2.0, 90, 40, 120))
    out = models.ensemble(branching, history, rows.select("day", "rt", "cumulative"))
    return out.select("day", F.col("history_weight").cast("double").alias("history_weight"), r("median"), "end_median", "end_low", "end_high")


@query()
def i7_replay(t: Source) -> DataFrame:
    return models.replay(t.reports)


@query("reports", "r AS (SELECT date, cumulative, count(*) OVER (ORDER BY date) AS n, date - min(date) OVER () + 1 AS days FROM reports) SELECT date AS as_of, n AS reports, true AS ordered, true AS not_below_now, true AS ends_in_time FROM r WHERE n >= 5 AND days >= 8")
def i7_replay_shape(t: Source) -> DataFrame:
    """The report dates replayed, with what must hold whatever the draws."""
    now = t.reports.select(F.col("date").alias("as_of"), "cumulative")
    rows = models.replay(t.reports).join(now, "as_of")
    return rows.select("as_of", "reports", F.expr("low <= median and median <= high").alias("ordered"), (F.col("low") >= F.col("cumulative")).alias("not_below_now"), F.col("end_median").between(1, 260).alias("ends_in_time"))


@query("reports", "h AS (SELECT CAST(k AS INT) AS h FROM generate_series(1, 14) AS s(k)) SELECT 'baseline' AS scenario, h, CAST(1.0 AS DOUBLE) AS multiplier FROM h UNION ALL SELECT 'improved', h, round(1 - 0.3 * (CAST(h AS DOUBLE) / 14), 6) FROM h UNION ALL SELECT 'delayed', h, round(CASE WHEN h < 7 THEN 1 + 0.2 * (CAST(h AS DOUBLE) / 14) ELSE 1.1 - 0.4 * (CAST(h AS DOUBLE) / 14 - 0.5) END, 6) FROM h")
def i8_scenarios(t: Source) -> DataFrame:
    days, out = t.spark.range(1, 15).select(F.col("id").cast("int").alias("h")), None
    for kind in ("baseline", "improved", "delayed"):
        part = days.select(F.lit(kind).alias("scenario"), "h", F.round(models.scenario_multiplier(kind, F.col("h"), 14), 6).alias("multiplier"))
        out = part if out is None else out.unionByName(part)
    return out


@query("indicators", "SELECT date, province, admin_level AS source_level, round(contact_followup_rate, 6) AS value FROM indicators WHERE contact_followup_rate IS NOT NULL AND date <= DATE '2024-01-21' AND province = 'P2' ORDER BY date DESC, pos DESC LIMIT 1")
def c10_latest_metric(t: Source) -> DataFrame:
    return asof.latest_metric(t.indicators, "contact_followup_rate", "2024-01-21", province="P2").select("date", "province", "source_level", r("value", 6))


_TIMELINE = "SELECT '{0}' AS metric, date, round(coalesce(max_by({0}, pos) FILTER (WHERE admin_level = 'national' AND {0} IS NOT NULL), {1}({0}) FILTER (WHERE admin_level <> 'national')), 4) AS value FROM indicators WHERE {0} IS NOT NULL GROUP BY date"
_METRICS = [("contact_followup_rate", "avg"), ("alert_investigation_rate", "avg"), ("poe_screening_coverage", "avg"), ("alerts_reported", "sum"), ("samples_analysed", "sum"), ("travellers_screened", "sum")]


@query("indicators", " UNION ALL ".join(_TIMELINE.format(*m) for m in _METRICS))
def d14_metric_by_date(t: Source) -> DataFrame:
    out = None
    for metric, _ in _METRICS:
        part = indicators.timeline(t.indicators, metric).select(F.lit(metric).alias("metric"), "date", r("value"))
        out = part if out is None else out.unionByName(part)
    return out




@query("indicators", "SELECT date, province, round(list_avg([x FOR x IN [contact_followup_rate, alert_investigation_rate, poe_screening_coverage] IF x IS NOT NULL]), 4) AS intensity FROM (SELECT date, province, CASE WHEN contact_followup_rate IS NOT NULL THEN least(1, greatest(0, contact_followup_rate)) END AS contact_followup_rate, CASE WHEN alert_investigation_rate IS NOT NULL THEN least(1, greatest(0, alert_investigation_rate)) END AS alert_investigation_rate, CASE WHEN poe_screening_coverage IS NOT NULL THEN least(1, greatest(0, poe_screening_coverage)) END AS poe_screening_coverage FROM indicators)")
def d15_response_intensity(t: Source) -> DataFrame:
    return t.indicators.select("date", "province", F.round(indicators.intensity(indicators.RATES), 4).alias("intensity"))


_UNTIL = "2024-01-21"
_LATEST = (
    "SELECT p.province, coalesce(o.value, a.value) AS value, coalesce(o.level, a.level) AS source_level FROM (SELECT DISTINCT province FROM indicators UNION SELECT 'P9') p "
    f"LEFT JOIN (SELECT province, max_by({{0}}, struct_pack(d := date, p := pos)) AS value, max_by(admin_level, struct_pack(d := date, p := pos)) AS level FROM indicators WHERE admin_level = 'province' AND {{0}} IS NOT NULL AND date <= DATE '{_UNTIL}' GROUP BY 1) o USING (province) "
    f"CROSS JOIN (SELECT max_by({{0}}, struct_pack(d := date, p := pos)) AS value, max_by(admin_level, struct_pack(d := date, p := pos)) AS level FROM indicators WHERE {{0}} IS NOT NULL AND date <= DATE '{_UNTIL}') a"
)
#: Per province the mean of the rates that it has, each of its own level or of any.
_INTENSITY = (
    f"SELECT province, avg(least(1, greatest(0, value))) AS value FROM ({_LATEST.format('contact_followup_rate')} UNION ALL {_LATEST.format('alert_investigation_rate')} UNION ALL {_LATEST.format('poe_screening_coverage')}) WHERE value IS NOT NULL GROUP BY 1"
)


def _by_province(t: Source) -> DataFrame:
    """The latest rates of every province, and of one without rows."""
    return indicators.latest_values(t.indicators, indicators.RATES, _UNTIL, t.spark.sql("SELECT 'P9' AS province"))


def _rates() -> list[Column]:
    return [F.col(f"{m}.value") for m in indicators.RATES]


@query("indicators", "SELECT province, CASE WHEN value IS NOT NULL THEN round(greatest(0, 0.95 - value), 4) END AS gap, source_level FROM (" + _LATEST.format("contact_followup_rate") + ")")
def j12_contact_gap(t: Source) -> DataFrame:
    rate = "contact_followup_rate"
    return _by_province(t).select("province", F.round(indicators.contact_gap(F.col(f"{rate}.value")), 4).alias("gap"), f"{rate}.source_level")


@query("indicators", f"SELECT province, round(value, 4) AS intensity FROM ({_INTENSITY})")
def j13_response_intensity(t: Source) -> DataFrame:
    """Mean of contact follow-up, alert investigation and screening, each with its own fallback."""
    return _by_province(t).select("province", F.round(indicators.intensity(_rates()), 4).alias("intensity")).where("intensity is not null")


@query("indicators", " UNION ALL ".join(_TIMELINE.format(*m) for m in _METRICS) + " UNION ALL SELECT 'contact_gap', date, round(greatest(0, 0.95 - v), 4) FROM (SELECT date, coalesce(max_by(contact_followup_rate, pos) FILTER (WHERE admin_level = 'national' AND contact_followup_rate IS NOT NULL), avg(contact_followup_rate) FILTER (WHERE admin_level <> 'national')) AS v FROM indicators WHERE contact_followup_rate IS NOT NULL GROUP BY date)")
def k8_response_timeline(t: Source) -> DataFrame:
    gap = indicators.timeline(t.indicators, "contact_followup_rate").select(F.lit("contact_gap").alias("metric"), "date", F.round(indicators.contact_gap(F.col("value")), 4).alias("value"))
    return d14_metric_by_date(t).unionByName(gap)


@query("wealth", "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part")
def e1_average_rank(t: Source) -> DataFrame:
    return stats.average_rank(t.part, "p_size").select("p_partkey", "p_size", F.col("rank").cast("double").alias("rank"))


_PERCENTILE = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 - 1) / nullif(count(*) OVER () - 1, 0) * 100"


@query("wealth", f"SELECT p_partkey, round({_PERCENTILE.format('p_size')}, 4) AS percentile FROM part")
def e2_percentile_rank(t: Source) -> DataFrame:
    return stats.percentile_rank(t.part, "p_size").select("p_partkey", r("percentile"))


@query("wealth", f"w AS (SELECT zone_id, rwi, {_PERCENTILE.format('rwi')} AS p FROM wealth) SELECT zone_id, rwi, round(p, 4) AS percentile, CASE WHEN p < 20 THEN 'lowest' WHEN p < 40 THEN 'lower' WHEN p < 60 THEN 'middle' WHEN p < 80 THEN 'higher' ELSE 'highest' END AS quintile FROM w")
def j11_relative_wealth(t: Source) -> DataFrame:
    rows = stats.percentile_rank(t.wealth, "rwi")
    return rows.select("zone_id", "rwi", r("percentile"), quintile_label(F.col("percentile")).alias("quintile"))


@query("wealth", f"w AS (SELECT zone_id, {_PERCENTILE.format('rwi')} AS p FROM wealth) SELECT CASE WHEN p < 20 THEN 'lowest' WHEN p < 40 THEN 'lower' WHEN p < 60 THEN 'middle' WHEN p < 80 THEN 'higher' ELSE 'highest' END AS quintile, count(*) AS zones FROM w GROUP BY 1")
def b11_wealth_quintiles(t: Source) -> DataFrame:
    return stats.percentile_rank(t.wealth, "rwi").groupBy(quintile_label(F.col("percentile")).alias("quintile")).agg(F.count(F.lit(1)).alias("zones"))


_PAIRS = f"pairs AS (SELECT CAST(z.n_nationkey AS VARCHAR) AS zone_id, w.rwi, c.confirmed_cases AS cases, ln(1 + c.confirmed_cases) AS log_cases FROM cases c JOIN nation z ON c.health_zone = z.n_name JOIN wealth w ON w.zone_id = CAST(z.n_nationkey AS VARCHAR) WHERE c.date = DATE '{DAY}')"


def _pairs(t: Source) -> DataFrame:
    names = t.nation.select(F.col("n_name").alias("health_zone"), F.col("n_nationkey").cast("string").alias("zid"))
    today = t.cases.where(F.col("date") == F.lit(DAY).cast("date")).select("health_zone", F.col("confirmed_cases").alias("cases")).join(names, "health_zone")
    return today.join(t.wealth.withColumnRenamed("zone_id", "zid"), "zid").select(F.col("zid").alias("zone_id"), "rwi", "cases", F.log1p("cases").alias("log_cases"))


@query("cases wealth", _PAIRS + " SELECT CASE WHEN count(*) >= 3 AND NOT isnan(corr(rwi, cases)) THEN round(corr(rwi, cases), 4) END AS pearson, CAST(NULL AS DOUBLE) AS constant, CAST(NULL AS DOUBLE) AS two FROM pairs")
def d12_pearson(t: Source) -> DataFrame:
    rows = _pairs(t).withColumn("one", F.lit(1.0))
    two = rows.orderBy("zone_id").limit(2).agg(stats.pearson("rwi", "cases").alias("two"))
    return rows.agg(F.round(stats.pearson("rwi", "cases"), 4).alias("pearson"), stats.pearson("rwi", "one").alias("constant")).crossJoin(F.broadcast(two))


_RANKS = "ranks AS (SELECT rank() OVER (ORDER BY rwi) + (count(*) OVER (PARTITION BY rwi) - 1) / 2.0 AS a, rank() OVER (ORDER BY cases) + (count(*) OVER (PARTITION BY cases) - 1) / 2.0 AS b FROM pairs)"


@query("cases wealth", _PAIRS + f", {_RANKS} SELECT CASE WHEN count(*) >= 3 AND NOT isnan(corr(a, b)) THEN round(corr(a, b), 4) END AS spearman FROM ranks")
def d13_spearman(t: Source) -> DataFrame:
    return stats.spearman(_pairs(t), "rwi", "cases").select(r("spearman"))


def _guarded(a: str, b: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND NOT isnan(corr({a}, {b})) THEN round(corr({a}, {b}), 4) END"


_SCATTER = (
    f"""
c AS (SELECT * FROM cases WHERE date = DATE '{DAY}'), w AS (SELECT zone_id, rwi, {_PERCENTILE.format('rwi')} AS p FROM wealth),
z AS (SELECT w.zone_id, p AS x, coalesce(i.confirmed_cases, n.confirmed_cases, 0) AS cases, coalesce(population, 0) AS population, coalesce(coalesce(i.province, n.province), 'Unknown') AS province
  FROM w LEFT JOIN c i ON i.zone_id = w.zone_id LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = w.zone_id LEFT JOIN c n ON lower(n.health_zone) = lower(n_name) LEFT JOIN population u ON u.zone_id = w.zone_id),
o AS (SELECT 'cases' AS outcome, *, CAST(cases AS DOUBLE) AS v FROM z UNION ALL SELECT 'per100k', *, cases * 100000.0 / population FROM z WHERE population > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY outcome, cases > 0 ORDER BY v DESC, zone_id) AS place FROM o),
e AS (SELECT 'all' AS display, * FROM d UNION ALL SELECT 'affected', * FROM d WHERE cases > 0 UNION ALL SELECT 'top25', * FROM d WHERE cases > 0 AND place <= 25),
f AS (SELECT 'linear' AS scale, *, v AS y FROM e UNION ALL SELECT 'log1p', *, ln(1 + greatest(0, v)) FROM e),
g AS (SELECT *, rank() OVER (PARTITION BY outcome, display, scale ORDER BY x) + (count(*) OVER (PARTITION BY outcome, display, scale, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY outcome, display, scale ORDER BY y) + (count(*) OVER (PARTITION BY outcome, display, scale, y) - 1) / 2.0 AS b FROM f)
SELECT outcome, display, scale, count(*) AS n, count(*) FILTER (WHERE cases <= 0) AS zero_points, count(DISTINCT province) FILTER (WHERE cases > 0) AS provinces, """
    + f"{_guarded('x', 'y')} AS pearson, {_guarded('a', 'b')} AS spearman FROM g GROUP BY 1, 2, 3"
)


@query("cases wealth population", _SCATTER)
def k9_wealth_scatter(t: Source) -> DataFrame:
    """Both outcomes, three displays and two scales; points, provinces and correlations of each."""
    from zonepulse.operators.keys import two_key

    today = t.cases.where(F.col("date") == F.lit(DAY).cast("date")).select("zone_id", F.col("health_zone").alias("zone_name"), "province", "confirmed_cases")
    names = t.nation.select(F.col("n_nationkey").cast("string").alias("zone_id"), F.col("n_name").alias("zone_name"))
    rows = two_key(stats.percentile_rank(t.wealth, "rwi").join(names, "zone_id", "left"), today).join(t.population, "zone_id", "left")
    points = rows.select("zone_id", F.col("percentile").alias("x"), F.coalesce("zone.confirmed_cases", F.lit(0)).alias("cases"), F.coalesce("population", F.lit(0)).alias("population"), F.coalesce("zone.province", F.lit("Unknown")).alias("province"))
    return stats.scatter_summary(points).select("outcome", "display", "scale", "n", "zero_points", "provinces", r("pearson"), r("spearman"))


@query("cases", f"SELECT province, CAST(sum(confirmed_cases) AS BIGINT) AS cases, CAST(sum(confirmed_deaths) AS BIGINT) AS deaths, round(sum(confirmed_deaths) / CAST(greatest(sum(confirmed_cases), 1) AS DOUBLE), 4) AS cfr FROM cases WHERE date = DATE '{DAY}' GROUP BY 1")
def d17_fatality(t: Source) -> DataFrame:
    today = t.cases.where(F.col("date") == F.lit(DAY).cast("date")).groupBy("province").agg(F.sum("confirmed_cases").alias("cases"), F.sum("confirmed_deaths").alias("deaths"))
    return today.withColumn("cfr", F.round(F.col("deaths") / F.greatest("cases", F.lit(1)), 4))


@query("reports", "SELECT round(quantile_cont(cumulative, 0.5), 4) AS median, CAST(0 AS DOUBLE) AS empty FROM reports")
def d10_median_or_zero(t: Source) -> DataFrame:
    none = t.reports.where("cumulative < 0").agg(stats.quantile("cumulative", 0.5, 0.0).alias("empty"))
    return t.reports.agg(F.round(stats.quantile("cumulative", 0.5, 0.0), 4).alias("median")).crossJoin(F.broadcast(none))


_ERRORS = "e AS (SELECT user_id % 10 AS k, CAST(ts AS DATE) AS date, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS increase FROM events GROUP BY 1, 2)"


def _errors(t: Source) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 10).alias("k"), F.to_date("ts").alias("date")).agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("increase"))


@query(
    "reports",
    _ERRORS
    + ", h AS (SELECT k, date, sum(increase) OVER (PARTITION BY k ORDER BY date) AS c FROM e), p AS (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY date) AS pc FROM h) SELECT k, CAST(DATE '2024-01-30' - coalesce(max(i), max(r), min(f)) AS INT) AS days, CASE WHEN max(i) IS NOT NULL THEN 'daily' WHEN max(r) IS NOT NULL THEN 'history' ELSE 'span' END AS basis FROM (SELECT k, max(CASE WHEN increase > 0 AND k < 5 THEN date END) AS i, CAST(NULL AS DATE) AS r, CAST(NULL AS DATE) AS f FROM e WHERE date <= DATE '2024-01-30' GROUP BY 1 UNION ALL SELECT k, NULL, max(CASE WHEN c > pc THEN date END), min(date) FROM p WHERE date <= DATE '2024-01-30' GROUP BY 1) GROUP BY k",
)
def e6_days_without_increase(t: Source) -> DataFrame:
    e = _errors(t)
    history = e.withColumn("cumulative", F.sum("increase").over(W.partitionBy("k").orderBy("date"))).select("k", "date", "cumulative")
    daily = e.withColumn("increase", F.when(F.col("k") < 5, F.col("increase")).otherwise(0))
    return series.days_without_increase(daily, history, "2024-01-30", ("k",))


def _zero_runs(events: DataFrame) -> DataFrame:
    users = events.select(F.col("user_id").alias("k")).distinct()
    grid = users.select("k", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))).alias("date"))
    n = events.where("event_type = 'error'").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return series.zero_run(grid.join(n, ["k", "date"], "left").withColumn("incidence", F.coalesce("n", F.lit(0))), 4, ("k",))


@query("reports", "d AS (SELECT user_id AS k, CAST(d AS DATE) AS date FROM (SELECT DISTINCT user_id FROM events) u, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) AS g(d)), f AS (SELECT k, d.date, count(e.event_id) AS n FROM d LEFT JOIN events e ON e.user_id = k AND CAST(ts AS DATE) = d.date AND event_type = 'error' GROUP BY 1, 2), g AS (SELECT *, sum(CASE WHEN n <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY date) AS grp FROM f) SELECT k, min(s) AS start FROM (SELECT k, grp, min(date) AS s, count(*) AS len FROM g WHERE n = 0 GROUP BY 1, 2) WHERE len >= 4 GROUP BY 1")
def e9_zero_run(t: Source) -> DataFrame:
    return _zero_runs(t.events)


@query("reports", "SELECT date, cumulative, max(cumulative) OVER (ORDER BY date) AS running_max, first_value(report_no) OVER (ORDER BY date) AS first_no, date = (SELECT max(date) FROM reports WHERE date <= DATE '2024-01-20') AS is_selected FROM reports")
def e10_running_max(t: Source) -> DataFrame:
    w = W.orderBy("date")
    rows = t.reports.select("date", "cumulative", F.max("cumulative").over(w).alias("running_max"), F.first("report_no").over(w).alias("first_no"))
    return series.selected(rows, "2024-01-20")


@query("reports", "SELECT date, report_no, cumulative, deaths, date = (SELECT max(date) FROM reports WHERE date <= DATE '2024-01-25') AS is_selected FROM reports")
def k5_epidemic_curve(t: Source) -> DataFrame:
    return series.selected(t.reports.select("date", "report_no", "cumulative", "deaths"), "2024-01-25").orderBy("date")


@query("reports", "SELECT min_by(report_no, date) AS first_no, min(date) AS first_date, max_by(report_no, date) AS last_no, max(date) AS last_date FROM reports")
def k16_freshness(t: Source) -> DataFrame:
    return t.reports.agg(F.min_by("report_no", "date").alias("first_no"), F.min("date").alias("first_date"), F.max_by("report_no", "date").alias("last_no"), F.max("date").alias("last_date"))


_HEADLINE = _TWO + f""",
l AS (SELECT max_by(cumulative, date) AS cases, max_by(deaths, date) AS deaths, max_by(neighbour_cases, date) AS neighbour FROM reports),
t AS (SELECT CAST(sum(confirmed_cases) AS BIGINT) AS cases, CAST(sum(confirmed_deaths) AS BIGINT) AS deaths FROM cases WHERE date = DATE '{DAY}'),
m AS (SELECT CAST(sum(recent_cases) AS BIGINT) AS cases, CAST(sum(recent_deaths) AS BIGINT) AS deaths FROM recent),
v AS (SELECT 'report' AS source, l.cases, l.deaths, l.neighbour AS neighbour_cases, 1 AS neighbour_deaths FROM l UNION ALL SELECT 'zones', t.cases, t.deaths, 7, 1 FROM t UNION ALL SELECT 'neighbour', l.cases, l.deaths, 21, 4 FROM l)
SELECT source, 'cumulative' AS mode, cases, deaths, round(deaths / CAST(greatest(cases, 1) AS DOUBLE), 4) AS cfr, CAST(neighbour_cases AS BIGINT) AS neighbour_cases, CAST(neighbour_deaths AS BIGINT) AS neighbour_deaths FROM v
UNION ALL SELECT source, 'recent', m.cases, m.deaths, NULL, CAST(neighbour_cases AS BIGINT), CAST(neighbour_deaths AS BIGINT) FROM v, m"""


@query("reports cases", _HEADLINE)
def k1_headline_kpis(t: Source) -> DataFrame:
    """With a report, without one (zone sums and the fixed neighbour counts), and with a neighbour's own snapshot."""
    day = t.cases.where(F.col("date") == F.lit(DAY).cast("date"))
    total = day.agg(F.sum("confirmed_cases").alias("cases"), F.sum("confirmed_deaths").alias("deaths"))
    recent = asof.increase(t.cases, DAY).agg(F.sum("recent_cases").alias("cases"), F.sum("recent_deaths").alias("deaths"))
    last = t.reports.agg(F.max_by(F.struct("cumulative", "deaths", "neighbour_cases"), "date").alias("r")).select(F.col("r.cumulative").alias("cases"), "r.deaths", "r.neighbour_cases", F.lit(None).cast("long").alias("neighbour_deaths"))
    other, out = t.spark.sql("SELECT 21L AS cases, 4L AS deaths"), None
    for source, meta, neighbour in (("report", last, other.limit(0)), ("zones", last.limit(0), other.limit(0)), ("neighbour", last, other)):
        part = assess.headline(meta, total, recent, neighbour).select(F.lit(source).alias("source"), "mode", "cases", "deaths", r("cfr"), "neighbour_cases", "neighbour_deaths")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def k6_forecast_chart(t: Source) -> DataFrame:
    """The last 21 observed days and the forecast bands in one table."""
    days = series.daily(t.reports).where(F.col("date") <= F.lit(REPORT_DAY).cast("date"))
    seen = days.orderBy(F.desc("date")).limit(21).select(F.lit("observed").alias("kind"), "date", F.col("incidence").alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    ahead = models.forecast(days, REPORT_DAY).select(F.lit("forecast").alias("kind"), F.date_add(F.lit(REPORT_DAY).cast("date"), F.col("h")).alias("date"), F.col("q50").alias("value"), F.col("q05").alias("low"), F.col("q95").alias("high"))
    return seen.unionByName(ahead)


@query("reports", "d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM reports WHERE date <= DATE '2024-01-28'), o AS (SELECT date FROM d ORDER BY date DESC LIMIT 21) SELECT 'observed' AS kind, count(*) AS days, min(date) AS first_day, max(date) AS last_day, true AS ordered FROM o UNION ALL SELECT 'forecast', 14, DATE '2024-01-29', DATE '2024-02-11', true")
def k6_forecast_chart_shape(t: Source) -> DataFrame:
    return k6_forecast_chart(t).groupBy("kind").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.bool_and(F.expr("coalesce(low <= value and value <= high, kind = 'observed')")).alias("ordered"))


@query()
def k7_final_size_chart(t: Source) -> DataFrame:
    """Observed cumulative cases, the projected path with its bands, and the end marker within the chart."""
    days = series.daily(t.reports)
    none = [F.lit(None).cast("double").alias(c) for c in ("q05", "q25", "q75", "q95")]
    seen = days.where(F.col("date") <= F.lit(REPORT_DAY).cast("date")).select(F.lit("observed").alias("kind"), "date", F.col("cumulative").cast("double").alias("q50"), *none)
    path = models.projected_path(days, REPORT_DAY)
    ahead = path.where("kind = 'path'").select(F.lit("projected").alias("kind"), "date", "q50", "q05", "q25", "q75", "q95")
    end = path.where("kind = 'end'").select(F.lit("end").alias("kind"), "date", F.lit(None).cast("double").alias("q50"), *none)
    return seen.unionByName(ahead).unionByName(end)


@query("reports", "d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM reports WHERE date <= DATE '2024-01-28'), n AS (SELECT max(cumulative) AS now FROM reports WHERE date <= DATE '2024-01-28') SELECT 'observed' AS kind, count(*) AS days, min(date) AS first_day, max(date) AS last_day, true AS ordered, CAST(NULL AS DOUBLE) AS starts_at FROM d UNION ALL SELECT 'projected', 261, DATE '2024-01-28', DATE '2024-01-28' + 260, true, CAST(now AS DOUBLE) FROM n")
def k7_final_size_chart_shape(t: Source) -> DataFrame:
    """Days of both parts, bands in order, and the path from the cases so far."""
    rows = k7_final_size_chart(t).where("kind <> 'end'")
    start = F.min(F.when(F.col("kind") == "projected", F.col("q05"))).alias("starts_at")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.bool_and(F.expr("coalesce(q05 <= q25 and q25 <= q50 and q50 <= q75 and q75 <= q95, kind = 'observed')")).alias("ordered"), start)


_ASSESS = ", x AS (SELECT CASE WHEN n % 7 <> 0 THEN 0.5 + n % 5 * 0.25 END AS rt, (n % 11) / 10.0 AS p, 0.6 + n % 9 * 0.1 AS ratio, n % 6 * 0.1 AS gap, (n % 13) / 20.0 AS share, n % 10 * 60 AS local, CASE WHEN n % 4 <> 0 THEN 0.85 + n % 4 * 0.05 END AS screening, n FROM (SELECT number AS n FROM reports))"


def _assess(t: Source) -> DataFrame:
    n = F.col("number")
    return t.reports.select(
        n.alias("n"), F.when(n % 7 != 0, F.expr("0.5 + number % 5 * 0.25")).alias("rt"), F.expr("(number % 11) / 10.0").alias("p"), F.expr("0.6 + number % 9 * 0.1").alias("ratio"), F.expr("number % 6 * 0.1").alias("gap"), F.expr("(number % 13) / 20.0").alias("share"), (n % 10 * 60).alias("local"), F.when(n % 4 != 0, F.expr("0.85 + number % 4 * 0.05")).alias("screening")
    )


@query("reports", _ASSESS.removeprefix(", ") + " SELECT n, CASE WHEN rt IS NULL THEN 'uncertain' WHEN (rt > 1.2 AND p > 0.65) OR p > 0.8 OR ratio > 1.25 THEN 'high' WHEN gap >= 0.3 THEN 'moderate_high' WHEN rt < 0.8 AND p < 0.3 AND ratio < 0.85 THEN 'low' ELSE 'moderate' END AS level FROM x")
def k13_local_assessment(t: Source) -> DataFrame:
    return _assess(t).select("n", assess.local_level(F.col("rt"), F.col("p"), F.col("ratio"), F.col("gap")).alias("level"))


@query("reports", _ASSESS.removeprefix(", ") + " SELECT n, CASE WHEN share < 0.08 AND screening >= 0.95 THEN 'low' WHEN share >= 0.4 AND (screening IS NULL OR screening < 0.9) THEN 'high' WHEN share >= 0.25 OR local >= 400 THEN 'moderate_high' ELSE 'moderate' END AS level FROM x")
def k15_border_assessment(t: Source) -> DataFrame:
    return _assess(t).select("n", assess.border_level(F.col("share"), F.col("local"), F.col("screening")).alias("level"))


# every third zone has no coordinates of its own, one says that it is unknown, and polygons know one name in another province
_MAP = f"""
c AS (SELECT CASE WHEN c.health_zone = 'NATION_6' THEN 'Autres ZS' ELSE c.health_zone END AS zone_name, c.zone_id, c.province, confirmed_cases AS cases, CASE WHEN CAST(z.zone_id AS INT) % 3 <> 0 THEN lat END AS lat, CASE WHEN CAST(z.zone_id AS INT) % 3 <> 0 THEN lon END AS lon
  FROM cases c LEFT JOIN zones z ON c.zone_id = z.zone_id WHERE date = DATE '{DAY}'),
g AS (SELECT zone_id, zone_name, CASE WHEN zone_id = '11' THEN 'ELSEWHERE' ELSE province END AS province, lat + 0.5 AS lat, lon + 0.5 AS lon FROM zones),
u AS (SELECT c.*, regexp_matches(lower(concat_ws(' ', c.zone_name, c.zone_id)), 'unventilated|unknown|autres zs|non ventil|sans fiche|non identifie') AS unknown, c.lat BETWEEN -14 AND 6 AND c.lon BETWEEN 11 AND 32 AS direct, coalesce(i.lat, n.lat) AS glat, coalesce(i.lon, n.lon) AS glon
  FROM c LEFT JOIN g i ON c.zone_id = i.zone_id LEFT JOIN g n ON lower(c.zone_name) = lower(n.zone_name) AND lower(c.province) = lower(n.province)),
k AS (SELECT zone_name, province, cases, CASE WHEN coalesce(direct, false) THEN lat ELSE glat END AS lat, CASE WHEN coalesce(direct, false) THEN lon ELSE glon END AS lon, unknown FROM u),
m AS (SELECT *, NOT unknown AND coalesce(lat BETWEEN -14 AND 6 AND lon BETWEEN 11 AND 32, false) AS known, greatest(1, max(cases) OVER ()) AS most FROM k)
SELECT zone_name, province, cases, CASE WHEN known THEN lat END AS lat, CASE WHEN known THEN lon END AS lon, known, known AND cases > 0 AND cases >= greatest(10, 0.12 * most) AS labelled, CASE WHEN known AND cases > 0 THEN round(5 + 31 * sqrt(cases / CAST(most AS DOUBLE)), 4) END AS radius,
  CAST(coalesce(sum(cases) FILTER (WHERE cases > 0 AND NOT known) OVER (), 0) AS BIGINT) AS hidden FROM m"""


@query("cases zones", _MAP)
def j1_case_map(t: Source) -> DataFrame:
    z = t.zones.select(F.col("zone_id").alias("__z"), *[F.when(F.col("zone_id").cast("int") % 3 != 0, F.col(c)).alias(c) for c in ("lat", "lon")])
    today = t.cases.where(F.col("date") == F.lit(DAY).cast("date")).withColumn("zone_name", F.when(F.col("health_zone") == "NATION_6", "Autres ZS").otherwise(F.col("health_zone")))
    rows = today.join(z, F.col("zone_id") == F.col("__z"), "left").select("zone_name", "zone_id", "province", F.col("confirmed_cases").alias("cases"), "lat", "lon")
    polygons = t.zones.select("zone_id", "zone_name", F.when(F.col("zone_id") == "11", "ELSEWHERE").otherwise(F.col("province")).alias("province"), (F.col("lat") + 0.5).alias("lat"), (F.col("lon") + 0.5).alias("lon"))
    return mobility.case_map(rows, polygons).select("zone_name", "province", "cases", "lat", "lon", "known", "labelled", F.round("radius", 4).alias("radius"), "hidden")
