"""Upserts, normalisers, validation, deltas and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.functions.numbers import half_even, to_number
from zonepulse.functions.text import grouped_number, percent


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in new, and new. Columns of both; blank and null keys are equal."""
    same = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("\0"))
    marked = old.withColumns({f"__k{i}": same(c) for i, c in enumerate(keys)})
    replaced = new.select(*[same(c).alias(f"__k{i}") for i, c in enumerate(keys)]).distinct()
    held = marked.join(replaced, [f"__k{i}" for i in range(len(keys))], "left_anti").drop(*[f"__k{i}" for i in range(len(keys))])
    return held.unionByName(new, allowMissingColumns=True)


def replace_partition(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by whole partitions: a corrected report also withdraws rows it no longer has."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; new rows win over old ones, later positions over earlier (column ``pos``)."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__v")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__v", "pos")).alias("r")).select(*keys, "r.*")


#: Other names of the flow columns. Fixed values.
FLOW_NAMES = {"origin_hz_id": "origin_id", "destination_hz_id": "destination_id", "date_month": "month", "estimated_movement": "movement"}
FLOW_COLUMNS = ["month", "origin_id", "destination_id", "movement"]


def normalise_flows(rows: DataFrame) -> DataFrame:
    """Rename known columns, require four, count text and blanks as 0, round half to even."""
    rows = rows.withColumnsRenamed({k: v for k, v in FLOW_NAMES.items() if k in rows.columns and v not in rows.columns})
    missing = [c for c in FLOW_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"flow table lacks {', '.join(missing)}")
    return rows.select(*[F.col(c).cast("string").alias(c) for c in FLOW_COLUMNS[:3]], half_even(to_number(F.col("movement"))).alias("movement"))


def wide_to_long(rows: DataFrame, ids: list[str], prefix: str, out: str, redacted: float | None = 7.5, imputed: float = 8.0) -> DataFrame:
    """(ids, month, out) from columns prefix_YYYY_MM; blanks go, the redaction value is imputed."""
    held = [c for c in rows.columns if c.startswith(prefix) and len(c) == len(prefix) + 8]
    tall = rows.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in held]).unpivot(ids, held, "__c", "__v").where("__v is not null")
    month = F.replace(F.substring("__c", len(prefix) + 2, 7), F.lit("_"), F.lit("-"))
    value = F.col("__v") if redacted is None else F.when(F.col("__v") == redacted, imputed).otherwise(F.col("__v"))
    return tall.select(*ids, month.alias("month"), value.alias(out))


def validated(rows: DataFrame, totals: DataFrame, key: str, value: str) -> DataFrame:
    """Per report: zones' sum, unassigned, stated total, and whether they agree (else it is quarantined)."""
    sums = rows.groupBy(key).agg(F.sum(F.when(F.col("kind") == "zone", F.col(value)).otherwise(0)).alias("zones"), F.sum(F.when(F.col("kind") == "unassigned", F.col(value)).otherwise(0)).alias("unassigned"))
    out = totals.join(sums, key, "left").select(key, F.coalesce("zones", F.lit(0)).alias("zones"), F.coalesce("unassigned", F.lit(0)).alias("unassigned"), "total")
    return out.withColumn("accepted", F.coalesce((F.col("zones") > 0) & (F.col("zones") + F.col("unassigned") == F.col("total")), F.lit(False)))


def zone_changes(now: DataFrame, before: DataFrame, key: str = "zone", value: str = "cases") -> DataFrame:
    """(key, previous, latest, change, is_new) over both reports; absent counts 0."""
    a, b = now.select(F.col(key), F.col(value).alias("latest")), before.select(F.col(key), F.col(value).alias("previous"))
    rows = a.join(b, key, "full_outer").select(key, F.coalesce("previous", F.lit(0)).alias("previous"), F.coalesce("latest", F.lit(0)).alias("latest"))
    return rows.withColumn("change", F.col("latest") - F.col("previous")).withColumn("is_new", (F.col("latest") > 0) & (F.col("previous") <= 0))


#: Response fields of a delta whose latest values are told. Fixed values.
RESPONSE_FIELDS = "contact_followup_rate contacts_under_followup contacts_seen alerts_reported alerts_investigated alert_investigation_rate samples_analysed positive_samples travellers_total travellers_screened poe_screening_coverage".split()


def _one(rows: DataFrame, name: str) -> DataFrame:
    """One row with the first row of ``rows`` as a struct, null if there is none."""
    return rows.agg(F.first(F.struct(*rows.columns)).alias(name))


def zone_delta(changes: DataFrame, key: str = "zone", most: int = 8) -> DataFrame:
    """One row: zones with cases before and now, the new ones by name, the ``most`` largest increases in order.

    Only new zones and the largest increases are gathered, after they are chosen.
    """
    counts = changes.agg(F.count_if(F.col("previous") > 0).alias("previous_count"), F.count_if(F.col("latest") > 0).alias("latest_count"))
    fresh = changes.where("is_new").agg(F.array_sort(F.collect_list(key)).alias("new_zones"))
    up = changes.where("change > 0").orderBy(F.desc("change"), key).limit(most)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("change")).alias("o"), F.col(key).alias("zone"), "change", "latest")))
    top = up.agg(F.transform(listed, lambda x: F.struct(x["zone"].alias("zone"), x["change"].alias("change"), x["latest"].alias("latest"))).alias("largest_increases"))
    return counts.crossJoin(F.broadcast(fresh)).crossJoin(F.broadcast(top))


def delta(now: DataFrame, before: DataFrame, changes: DataFrame, response_now: DataFrame, response_before: DataFrame, neighbour: DataFrame) -> DataFrame:
    """One row (cases, deaths, health_zones, response, neighbour): a report against the one before.

    now and before have report_no, date, cases and deaths; before, the responses and the
    neighbour may be empty. cases and deaths are structs of previous, latest and change,
    which is null without a previous report; so is the previous count of zones.
    """
    parts = [_one(now, "n"), _one(before, "p"), zone_delta(changes).select(F.struct("*").alias("z")), _one(response_now, "r"), _one(response_before, "q"), _one(neighbour, "neighbour")]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))
    moved = lambda c: F.struct(F.col(f"p.{c}").alias("previous"), F.col(f"n.{c}").alias("latest"), (F.col(f"n.{c}") - F.col(f"p.{c}")).alias("change")).alias(c)
    held = set(response_now.columns)
    said = [F.col(f"r.{c}").alias(f"{c}_latest") if c in held else F.lit(None).alias(f"{c}_latest") for c in RESPONSE_FIELDS]
    zones = F.struct(F.when(F.col("p").isNotNull(), F.col("z.previous_count")).alias("previous_count"), "z.latest_count", "z.new_zones", "z.largest_increases")
    return row.select(F.col("p.report_no").alias("from_report"), F.col("n.report_no").alias("to_report"), moved("cases"), moved("deaths"), zones.alias("health_zones"), F.struct(F.col("q.contact_followup_rate").alias("contact_followup_rate_previous"), *said).alias("response"), "neighbour")


def summary(payload: DataFrame) -> DataFrame:
    """(local, neighbour): the delta told in Japanese sentences; parts without data are left out.

    payload is the row of ``delta``; its neighbour has cases, deaths, imported, local,
    new_last_day, quiet_days and last_increase.
    """
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pct = lambda c: percent(F.col(c), "ja")
    cat = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    known = F.col("cases.change").isNotNull() & F.col("deaths.change").isNotNull()
    totals = F.when(known, cat(s("from_report"), "から", s("to_report"), "まで：確定例", s("cases.previous"), "例→", s("cases.latest"), "例（", s("cases.change"), "例増）、死亡", s("deaths.previous"), "例→", s("deaths.latest"), "例（", s("deaths.change"), "例増）。")).otherwise(
        cat(s("to_report"), "：確定例", s("cases.latest"), "例、死亡", s("deaths.latest"), "例。")
    )
    fresh = F.when(F.size("health_zones.new_zones") > 0, cat("新規：", F.array_join("health_zones.new_zones", "、"), "（計", s("health_zones.latest_count"), "区域）。")).otherwise("新規区域なし。")
    four = F.transform(F.slice("health_zones.largest_increases", 1, 4), lambda x: F.concat(x["zone"], F.lit("+"), x["change"].cast("string")))
    rising = F.when(F.size("health_zones.largest_increases") > 0, cat("増加：", F.array_join(four, "、"), "。"))
    before, now = "response.contact_followup_rate_previous", "response.contact_followup_rate_latest"
    followed = F.when(F.col(now).isNotNull(), F.when(F.col(before).isNotNull(), cat("追跡率", pct(before), "→", pct(now), "。")).otherwise(cat("追跡率", pct(now), "。")))
    alerts = F.when(F.col("response.alert_investigation_rate_latest").isNotNull(), cat("警報調査率", pct("response.alert_investigation_rate_latest"), "、陽性", s("response.positive_samples_latest"), "件。"))
    cover, passed = "response.poe_screening_coverage_latest", "response.travellers_total_latest"
    screened = F.when(F.col(cover).isNotNull(), F.when(F.col(passed) > 0, cat("通過", grouped_number(F.col(passed), "ja"), "人、検査率", pct(cover), "。")).otherwise(cat("検査率", pct(cover), "。")))
    local = F.concat_ws("", totals, fresh, rising, followed, alerts, screened)
    beside = cat("確定例", s("neighbour.cases"), "例、死亡", s("neighbour.deaths"), "例（輸入", s("neighbour.imported"), "、国内", s("neighbour.local"), "）。")
    today = F.when(F.col("neighbour.new_last_day").isNotNull(), cat("24時間の新規", s("neighbour.new_last_day"), "例。"))
    quiet = F.when(F.col("neighbour.quiet_days") > 0, F.when(F.col("neighbour.last_increase").isNotNull(), cat(s("neighbour.last_increase"), "以後", s("neighbour.quiet_days"), "日間増加なし。")).otherwise(cat(s("neighbour.quiet_days"), "日間増加なし。")))
    return payload.select(local.alias("local"), F.when(F.col("neighbour.cases").isNotNull(), F.concat_ws("", beside, today, quiet)).alias("neighbour"))


def count_words(change: Column, noun: str) -> Column:
    """'+3 cases', 'no change in cases', '-2 cases'."""
    return F.when(change > 0, F.concat(F.lit("+"), change.cast("string"), F.lit(f" {noun}"))).when(change < 0, F.concat(change.cast("string"), F.lit(f" {noun}"))).otherwise(F.lit(f"no change in {noun}"))


def narrative(label: Column, cases: Column, deaths: Column, case_change: Column, death_change: Column, lang: str = "en") -> Column:
    """One sentence on a report against the one before; without one, totals only."""
    words = {"en": ("cases", "deaths", "Report", "total"), "fr": ("cas", "décès", "Rapport", "total")}[lang]
    totals = F.concat_ws(" ", F.lit(words[2]), label, F.lit(":"), cases.cast("string"), F.lit(words[0] + ","), deaths.cast("string"), F.lit(words[1]))
    if lang == "en":
        moved = F.concat(F.lit(" ("), count_words(case_change, words[0]), F.lit("; "), count_words(death_change, words[1]), F.lit(")."))
    else:
        signed = lambda c: F.concat(F.when(c > 0, "+").otherwise(""), c.cast("string"))
        moved = F.concat(F.lit(" ("), signed(case_change), F.lit(f" {words[0]} ; "), signed(death_change), F.lit(f" {words[1]})."))
    return F.concat(totals, F.when(case_change.isNull(), F.lit(".")).otherwise(moved))


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with ``status`` and ``reasons``: the names of the checks that do not hold, in order.

    A check that is null does not hold.
    """
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.withColumn("reasons", F.array_join(failed, ",")).withColumn("status", F.when(F.col("reasons") == "", "published").otherwise("needs review"))


def audit_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def merged_json(own: Column, over: Column, schema: str) -> Column:
    """Fields of ``over`` that are not null laid over those of ``own``, as JSON; null fields are left out."""
    a, b = F.from_json(own, schema), F.from_json(over, schema)
    names = [field.split()[0].strip(":`") for field in schema.split(",")]
    return F.to_json(F.struct(*[F.coalesce(b[n], a[n]).alias(n) for n in names]))


def merged_fields(rows: DataFrame, id_col: str, own: str, over: str) -> DataFrame:
    """(id, key, value) of two JSON documents a row, merged over the fields that they turn out to have.

    A field of ``over`` wins unless it is null; nested values are kept as JSON. Documents
    that are no objects, or no JSON, have no fields. Each row is taken apart by itself.
    """
    parsed = rows.select(F.col(id_col).alias("id"), F.try_parse_json(own).alias("__own"), F.try_parse_json(over).alias("__over"))
    field = "select id, e.key, {0} as place, cast(e.value as string) as value, not coalesce(is_variant_null(e.value), true) as stated from {{rows}}, lateral variant_explode({1}) as e where schema_of_variant({1}) like 'OBJECT%'"
    spark = rows.sparkSession
    tall = spark.sql(field.format(0, "__own"), rows=parsed).unionByName(spark.sql(field.format(1, "__over"), rows=parsed))
    best = F.max_by("value", F.struct("stated", "place"))
    return tall.groupBy("id", "key").agg(best.alias("value")).withColumnRenamed("id", id_col)
