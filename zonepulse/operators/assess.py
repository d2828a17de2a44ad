"""Rule-based situation assessments as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_level(rt: Column, p_above: Column, ratio: Column, gap: Column) -> Column:
    """Outlook from the reproduction number, its probability above 1 and the weekly ratio.

    Null rt means no forecast. A contact gap of 0.30 or more lifts all but high.
    """
    high = ((rt > 1.2) & (p_above > 0.65)) | (p_above > 0.80) | F.coalesce(ratio > 1.25, F.lit(False))
    low = (rt < 0.8) & (p_above < 0.30) & F.coalesce(ratio < 0.85, F.lit(False))
    level = F.when(high, "high").when(low, "low").otherwise("moderate")
    lifted = F.when((level != "high") & F.coalesce(gap >= 0.30, F.lit(False)), "moderate_high").otherwise(level)
    return F.when(rt.isNull(), "uncertain").otherwise(lifted)


def capital_level(cases: Column, share: Column) -> Column:
    return F.when(cases > 0, "high").when(share >= 0.15, "moderate_high").when(share >= 0.05, "moderate").when(share < 0.01, "very_low").otherwise("low")


def capital_assessment(scored: DataFrame, cases: DataFrame, capital: str = "kinshasa") -> DataFrame:
    """One row (cases, share, destinations, level): local cases, and the capital's share of the air-adjusted score.

    scored: air_score above 0 counts; a destination is the capital's by its flag, its
    category or its name. cases: rows of the day, the capital's by province or zone.
    """
    named = lambda *columns: F.coalesce(F.lower(F.concat_ws(" ", *columns)).contains(capital), F.lit(False))
    held, own = F.col("air_score") > 0, F.coalesce(F.col("is_kinshasa") == 1, F.lit(False)) | named("category", "zone_name")
    share = F.coalesce(F.try_divide(F.sum(F.when(held & own, F.col("air_score"))), F.sum(F.when(held, F.col("air_score")))), F.lit(0.0))
    local = cases.where(named("province", "health_zone")).agg(F.coalesce(F.sum("confirmed_cases"), F.lit(0)).cast("long").alias("cases"))
    rows = scored.agg(share.alias("share"), F.count_if(held & own).alias("destinations")).crossJoin(F.broadcast(local))
    return rows.select("cases", "share", "destinations", capital_level(F.col("cases"), F.col("share")).alias("level"))


def border_level(share: Column, local_cases: Column, screening: Column) -> Column:
    """Later rules override earlier ones, so the last is asked first; null screening is unknown."""
    low = (share < 0.08) & F.coalesce(screening >= 0.95, F.lit(False))
    high = (share >= 0.40) & F.coalesce(screening < 0.90, F.lit(True))
    lifted = (share >= 0.25) | (local_cases >= 400)
    return F.when(low, "low").when(high, "high").when(lifted, "moderate_high").otherwise("moderate")


#: Neighbour's cases and deaths where no report says them. Fixed values.
NEIGHBOUR = (7, 1)


def headline(report: DataFrame, zones: DataFrame, recent: DataFrame, neighbour: DataFrame) -> DataFrame:
    """Headline numbers (mode cumulative and recent): cases, deaths, cfr, neighbour_cases, neighbour_deaths.

    Each argument has one row or none: the day's report, the sums over zones, those of
    the recent increase, and the neighbour's own snapshot. A count that is missing or 0
    falls back: report to zones; neighbour to report to NEIGHBOUR. Recent has no cfr.
    """
    names = ("report", "zones", "recent", "neighbour")
    one = None
    for name, rows in zip(names, (report, zones, recent, neighbour), strict=True):
        held = rows.agg(F.first(F.struct(*rows.columns)).alias(name))
        one = held if one is None else one.crossJoin(F.broadcast(held))
    some = lambda *columns: F.coalesce(*[F.nullif(F.col(c), F.lit(0)) if isinstance(c, str) else F.lit(c) for c in columns]).cast("long")
    cases, deaths = some("report.cases", "zones.cases", 0), some("report.deaths", "zones.deaths", 0)
    beside = (some("neighbour.cases", "report.neighbour_cases", NEIGHBOUR[0]).alias("neighbour_cases"), some("neighbour.deaths", "report.neighbour_deaths", NEIGHBOUR[1]).alias("neighbour_deaths"))
    total = one.select(F.lit("cumulative").alias("mode"), cases.alias("cases"), deaths.alias("deaths"), (deaths / F.greatest(cases, F.lit(1))).alias("cfr"), *beside)
    return total.unionByName(one.select(F.lit("recent").alias("mode"), some("recent.cases", 0).alias("cases"), some("recent.deaths", 0).alias("deaths"), F.lit(None).cast("double").alias("cfr"), *beside))
