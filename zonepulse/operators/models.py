"""Reproduction numbers, forecasts, final sizes, analogs and their ensemble.

What has a closed form is plain DataFrame code. Only the path simulations are
numpy, in mapInPandas over blocks of paths with a seed of their own each, so any
number of tasks gives the same paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonepulse.operators import series
from zonepulse.operators.stats import weighted_quantile


@dataclass(frozen=True)
class Preset:
    """Prior, dispersion and generation interval of a model."""

    prior: float = 1.0
    dispersion: float = 0.4
    mean: float = 12.0
    sd_share: float = 5 / 12
    window: int = 10
    lags: int = 40


SHORT_TERM = Preset()
FINAL_SIZE = Preset(prior=1.2, dispersion=0.35)
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
BLOCK = 100


def rt_posterior(days: DataFrame, preset: Preset = SHORT_TERM, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gamma posterior of the reproduction number over the last days: shape, rate, rt."""
    weights = series.generation_weights(days.sparkSession, preset.mean, preset.mean * preset.sd_share, preset.lags)
    last = series.trailing(series.renewal(days, weights, keys), preset.window, keys)
    sums = last.groupBy(*keys).agg((preset.prior + F.sum("incidence")).alias("shape"), (preset.prior + F.sum("pressure")).alias("rate"))
    return sums.withColumn("rt", F.col("shape") / F.col("rate"))


def weights_array(preset: Preset) -> np.ndarray:
    sd = preset.mean * preset.sd_share
    shape, scale = (preset.mean / sd) ** 2, sd * sd / preset.mean
    x = np.arange(1, preset.lags + 1) - 0.5
    raw = np.exp((shape - 1) * np.log(x) - x / scale)
    return raw / raw.sum()


def _paths(history: np.ndarray, rt: np.ndarray, horizon: int, preset: Preset, rng: np.random.Generator, fade: float | None) -> np.ndarray:
    """(paths, horizon) new cases; rt is constant, or decays towards 0.75 over ``fade`` days."""
    w = weights_array(preset)[::-1]
    n, past = len(rt), max(len(history), preset.lags)
    track = np.zeros((n, past + horizon))
    if len(history):
        track[:, past - len(history) : past] = np.maximum(history, 0)
    start = np.clip(rt, 0.05, 4) if fade else rt
    for h in range(horizon):
        now = 0.75 + (start - 0.75) * np.exp(-h / fade) if fade else start
        mean = np.maximum(now * (track[:, past + h - preset.lags : past + h] @ w), 0)
        rate = np.where(mean > 0, rng.gamma(preset.dispersion, np.maximum(mean, 1e-12) / preset.dispersion), 0)
        track[:, past + h] = rng.poisson(np.minimum(rate, 1e9))
    return track[:, past:]


def simulate(days: DataFrame, day: str, horizon: int, sims: int, preset: Preset, fade: float | None = None, least: int = 4) -> DataFrame:
    """(day, sim, h, cases): simulated new cases; nothing if the series has fewer than ``least`` days.

    The series travels as one array row per as-of day; blocks of paths fan out.
    """
    held = days.where(F.col("date") <= F.lit(day).cast("date"))
    packed = held.agg(F.array_sort(F.collect_list(F.struct("date", "incidence"))).alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    posterior = rt_posterior(held, preset)
    blocks = packed.crossJoin(posterior).select(F.lit(day).alias("day"), F.col("d.incidence").alias("history"), "shape", "rate", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // BLOCK))).alias("block"))
    spread = max(1, (sims - 1) // BLOCK + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                n = min(BLOCK, sims - row.block * BLOCK)
                rng = np.random.default_rng([zlib.crc32(row.day.encode()), row.block])
                rt = rng.gamma(row.shape, 1 / row.rate, n)
                new = _paths(np.asarray(row.history, dtype=float), rt, horizon, preset, rng, fade)
                yield pd.DataFrame({"day": row.day, "sim": np.repeat(row.block * BLOCK + np.arange(n), horizon), "h": np.tile(np.arange(1, horizon + 1), n), "cases": new.ravel(), "rt": np.repeat(rt, horizon)})

    return blocks.repartition(spread, "block").mapInPandas(run, "day string, sim long, h int, cases double, rt double")


def forecast(days: DataFrame, day: str, horizon: int = 14, sims: int = 1000, preset: Preset = SHORT_TERM) -> DataFrame:
    """(h, q05..q95) of new cases for each day ahead."""
    paths = simulate(days, day, horizon, sims, preset)
    return paths.groupBy("h").agg(*[F.percentile("cases", q).alias(f"q{int(q * 100):02d}") for q in QUANTILES])


def rt_summary(days: DataFrame, day: str, sims: int = 1000, preset: Preset = SHORT_TERM) -> DataFrame:
    """One row: quantiles of the drawn reproduction number and P(Rt > 1)."""
    drawn = simulate(days, day, 1, sims, preset)
    return drawn.agg(F.percentile("rt", 0.025).alias("rt_low"), F.percentile("rt", 0.5).alias("rt_median"), F.percentile("rt", 0.975).alias("rt_high"), F.avg((F.col("rt") > 1).cast("double")).alias("p_above"))


def final_size(days: DataFrame, day: str, cumulative: float | None = None, sims: int = 800, horizon: int = 260, preset: Preset = FINAL_SIZE, quiet: int = 42, fade: float = 35.0) -> DataFrame:
    """(sim, final_size, end_h): the last day is the first of a run of ``quiet`` days without cases."""
    paths = simulate(days, day, horizon, sims, preset, fade, least=8)
    reached = days.where(F.col("date") <= F.lit(day).cast("date")).agg(F.max("cumulative").alias("__c"))
    runs = series.zero_run(paths.select("sim", F.col("h").alias("date"), F.col("cases").alias("incidence")), quiet, ("sim",))
    sums = paths.groupBy("sim").agg(F.sum("cases").alias("new"))
    return sums.join(runs, "sim", "left").crossJoin(F.broadcast(reached)).select("sim", (F.col("__c") + F.col("new")).alias("final_size"), F.coalesce("start", F.lit(horizon)).alias("end_h"))


def projected_path(days: DataFrame, day: str, sims: int = 800, horizon: int = 260, preset: Preset = FINAL_SIZE, quiet: int = 42, fade: float = 35.0) -> DataFrame:
    """(kind, date, q05..q95): cumulative cases from the day on, day by day, and one row ``end`` with the median last day.

    The end is left out if it lies beyond the horizon's last day.
    """
    paths = simulate(days, day, horizon, sims, preset, fade, least=8)
    now = days.where(F.col("date") <= F.lit(day).cast("date")).agg(F.max("cumulative").alias("__c"))
    total = paths.withColumn("new", F.sum("cases").over(W.partitionBy("sim").orderBy("h")))
    names = [f"q{int(q * 100):02d}" for q in QUANTILES]
    start = F.lit(day).cast("date")
    bands = total.groupBy("h").agg(*[F.percentile("new", q).alias(n) for q, n in zip(QUANTILES, names, strict=True)])
    ahead = bands.crossJoin(F.broadcast(now)).select(F.lit("path").alias("kind"), F.date_add(start, F.col("h")).alias("date"), *[(F.col("__c") + F.col(n)).alias(n) for n in names])
    first = now.select(F.lit("path").alias("kind"), start.alias("date"), *[F.col("__c").cast("double").alias(n) for n in names])
    runs = series.zero_run(paths.select("sim", F.col("h").alias("date"), F.col("cases").alias("incidence")), quiet, ("sim",))
    ends = paths.select("sim").distinct().join(runs, "sim", "left").agg(F.percentile(F.coalesce("start", F.lit(horizon)), 0.5).cast("int").alias("h"))
    end = ends.where(F.col("h") <= horizon).select(F.lit("end").alias("kind"), F.date_add(start, F.col("h")).alias("date"), *[F.lit(None).cast("double").alias(n) for n in names])
    return first.unionByName(ahead).unionByName(end)


def analogs(observed: DataFrame, curves: DataFrame, features: DataFrame, sigma: float = 0.45, least: float = 0.05, most: float = 80.0) -> DataFrame:
    """Historical outbreaks scaled to the observed curve.

    observed: (day, cases) cumulative by day index from 0; curves: (outbreak_id,
    day, cases); features: (outbreak_id, final_size, duration, base_weight). The
    scale is the clipped least-squares fit; the error is the weighted RMSE of
    log1p, with weights rising linearly from 0.65 to 1.35. Curves that end early
    keep their last value.
    """
    size = observed.agg(F.max("day").alias("__last"))
    ends = curves.groupBy("outbreak_id").agg(F.max_by("cases", "day").alias("__final"), F.max("day").alias("__end"))
    seen = observed.withColumnRenamed("cases", "__o")
    days = ends.crossJoin(F.broadcast(size)).select("outbreak_id", "__final", "__end", F.explode(F.sequence(F.lit(0), F.col("__last"))).alias("day"))
    grid = days.join(seen, "day").join(curves.withColumnRenamed("cases", "__c"), ["outbreak_id", "day"], "left")
    grid = grid.withColumn("__c", F.coalesce("__c", F.when(F.col("day") > F.col("__end"), F.col("__final")), F.lit(0)).cast("double"))
    fit = grid.groupBy("outbreak_id").agg((F.sum(F.col("__o") * F.col("__c")) / F.nullif(F.sum(F.col("__c") * F.col("__c")), F.lit(0.0))).alias("__s"))
    fit = fit.withColumn("scale", F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce("__s", F.lit(1.0))))).select("outbreak_id", "scale")
    w = 0.65 + 0.7 * F.when(F.col("__last") > 0, F.col("day") / F.col("__last")).otherwise(0)
    miss = F.log1p(F.col("__c") * F.col("scale")) - F.log1p(F.col("__o"))
    scored = grid.join(fit, "outbreak_id").crossJoin(F.broadcast(size)).groupBy("outbreak_id", "scale").agg(F.sqrt(F.sum(w * miss * miss) / F.sum(w)).alias("rmse"))
    out = scored.join(features, "outbreak_id").crossJoin(F.broadcast(size))
    weight = F.coalesce("base_weight", F.lit(0.7)) * F.exp(-F.col("rmse") * F.col("rmse") / (2 * sigma * sigma))
    return out.select("outbreak_id", "scale", "rmse", weight.alias("weight"), (F.col("scale") * F.col("final_size")).alias("final_size"), F.greatest(F.lit(0), F.col("duration") - F.col("__last")).alias("remaining"))


def analog_quantiles(matched: DataFrame, value: str = "final_size", shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    return weighted_quantile(matched, value, "weight", list(shares))


def history_weight(rt, cumulative):
    """Share of the analog model in the ensemble."""
    return F.when((rt < 1) & (cumulative >= 100), 0.20).when(cumulative < 100, 0.60).when(cumulative <= 500, 0.40).otherwise(0.30)


def ensemble(branching: DataFrame, history: DataFrame, state: DataFrame) -> DataFrame:
    """Convex mix of two models with (day, low, median, high, end_low, end_median, end_high).

    state has (day, rt, cumulative). The end comes from the heavier model, its
    interval is the envelope of both. A day with one model keeps it alone.
    """
    b, h = branching.alias("b"), history.alias("h")
    both = b.join(h, F.col("b.day") == F.col("h.day"), "full_outer")
    day = F.coalesce("b.day", "h.day")
    rows = both.withColumn("__day", day).join(state.withColumnRenamed("day", "__day"), "__day", "left")
    wh = F.when(F.col("b.day").isNull(), 1.0).when(F.col("h.day").isNull(), 0.0).otherwise(history_weight(F.col("rt"), F.col("cumulative")))
    mix = lambda c: (F.col("__w") * F.coalesce(f"h.{c}", F.lit(0.0)) + (1 - F.col("__w")) * F.coalesce(f"b.{c}", F.lit(0.0))).alias(c)
    end = F.when(F.col("__w") >= 0.5, F.col("h.end_median")).otherwise(F.col("b.end_median"))
    return rows.withColumn("__w", wh).select(
        F.col("__day").alias("day"), F.col("__w").alias("history_weight"), mix("low"), mix("median"), mix("high"), end.alias("end_median"), F.least("b.end_low", "h.end_low").alias("end_low"), F.greatest("b.end_high", "h.end_high").alias("end_high")
    )


def scenario_multiplier(kind: str, h, horizon: int):
    """Linear ramp of Rt: baseline 1, improved down to 0.7, delayed first up to 1.1."""
    share = h / horizon
    return {"baseline": F.lit(1.0) + 0 * share, "improved": 1 - 0.3 * share, "delayed": F.when(share < 0.5, 1 + 0.2 * share).otherwise(1.1 - 0.4 * (share - 0.5))}[kind]


def replay(reports: DataFrame, least_reports: int = 5, least_days: int = 8, sims: int = 800, horizon: int = 260, preset: Preset = FINAL_SIZE, quiet: int = 42, fade: float = 35.0) -> DataFrame:
    """(as_of, reports, rt, median, low, high, end_median) for every report date with enough reports.

    Each report joins the dates that see it; one group per date runs its paths with
    the seed of its own date, so order and partitioning do not matter.
    """
    seen = reports.select("date", "cumulative")
    dates = reports.select(F.col("date").alias("as_of")).distinct()
    pairs = dates.join(seen, F.col("date") <= F.col("as_of"))
    days = series.daily(pairs.withColumn("report_no", F.lit(None).cast("string")), ("as_of",))
    enough = pairs.groupBy("as_of").agg(F.count(F.lit(1)).alias("reports")).where(F.col("reports") >= least_reports)
    posterior = rt_posterior(days, preset, ("as_of",))
    rows = days.join(enough, "as_of").join(posterior, "as_of")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        if len(frame) < least_days:
            none = frame.iloc[:0][["as_of", "reports", "rt"]]
            return none.assign(median=0.0, low=0.0, high=0.0, end_median=0.0)
        first = frame.iloc[0]
        rng = np.random.default_rng(zlib.crc32(str(first["as_of"]).encode()))
        rt = rng.gamma(first["shape"], 1 / first["rate"], sims)
        new = _paths(frame["incidence"].to_numpy(float), rt, horizon, preset, rng, fade)
        total = frame["cumulative"].max() + new.sum(axis=1)
        blank = new == 0
        runs = np.lib.stride_tricks.sliding_window_view(blank, quiet, axis=1).all(axis=2)
        end = np.where(runs.any(axis=1), runs.argmax(axis=1) + 1, horizon)
        low, mid, high = np.quantile(total, [0.05, 0.5, 0.95])
        return pd.DataFrame({"as_of": [first["as_of"]], "reports": [first["reports"]], "rt": [first["rt"]], "median": [mid], "low": [low], "high": [high], "end_median": [float(np.median(end))]})

    return rows.groupBy("as_of").applyInPandas(run, "as_of date, reports long, rt double, median double, low double, high double, end_median double")


def draws(spark: SparkSession, seeds: list[str], n: int, mean: float, dispersion: float) -> DataFrame:
    """(seed, k, normal, gamma, poisson, negative_binomial): n draws of each kind per seed word.

    The stream of a seed depends on the word alone.
    """
    names = spark.createDataFrame([(s,) for s in seeds], "seed string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seed in frame["seed"]:
                rng = np.random.default_rng(zlib.crc32(seed.encode()))
                rate = rng.gamma(dispersion, mean / dispersion, n)
                yield pd.DataFrame({"seed": seed, "k": np.arange(n), "normal": rng.normal(size=n), "gamma": rate, "poisson": rng.poisson(mean, n), "negative_binomial": rng.poisson(rate)})

    return names.repartition(len(seeds), "seed").mapInPandas(run, "seed string, k long, normal double, gamma double, poisson long, negative_binomial long")
