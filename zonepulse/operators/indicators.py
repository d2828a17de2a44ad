"""Response indicators: fallbacks, gaps and intensity."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.functions.numbers import clamp

TARGET = 0.95
#: Metrics that are averaged over provinces; all others are summed. Fixed values.
RATES = ["contact_followup_rate", "alert_investigation_rate", "poe_screening_coverage"]


def latest_values(rows: DataFrame, metrics: list[str], day: datetime.date | str, places: DataFrame | None = None) -> DataFrame:
    """(province, then a struct of value and source_level for each metric) up to the day.

    A province's value is the latest of its own rows of level province, else the latest of
    any row; ties go to the last in file order; no value is a null struct. One pass gives
    all metrics. places (province) adds provinces that have no rows.
    """
    held = rows.where(F.col("date") <= F.lit(day).cast("date"))
    told = lambda m: F.struct("date", "pos", F.col(m).cast("double").alias("value"), F.col("admin_level").alias("source_level"))
    latest = held.groupBy("province", (F.col("admin_level") == "province").alias("__own")).agg(*[F.max(F.when(F.col(m).isNotNull(), told(m))).alias(m) for m in metrics])
    own = latest.where("__own").drop("__own")
    # one row: the latest of all provinces
    anyone = latest.agg(*[F.max(m).alias(f"__{m}") for m in metrics])
    names = rows.select("province") if places is None else rows.select("province").unionByName(places.select("province"))
    found = names.distinct().join(own, "province", "left").crossJoin(F.broadcast(anyone))
    return found.select("province", *[F.coalesce(m, f"__{m}").alias(m) for m in metrics])


def timeline(rows: DataFrame, metric: str) -> DataFrame:
    """Per date the national value, else the mean (rates) or sum (counts) over provinces."""
    held = rows.where(F.col(metric).isNotNull())
    value = F.col(metric).cast("double")
    national = F.max_by(F.when(F.col("admin_level") == "national", value), F.when(F.col("admin_level") == "national", F.col("pos")))
    local = F.when(F.col("admin_level") != "national", value)
    rest = F.avg(local) if metric in RATES else F.sum(local)
    return held.groupBy("date").agg(F.coalesce(national, rest).alias("value"))


def contact_gap(value, target: float = TARGET):
    """Shortfall from the target, never below 0; no rate, no gap."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), target - value))


def intensity(columns: list[Column | str]):
    """Mean of the available indicators, each clamped to 0..1; null if there are none."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    held = F.filter(F.array(*[clamp(column(c).cast("double"), 0.0, 1.0) for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(held), F.lit(0)))
