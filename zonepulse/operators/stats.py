"""Ranks with averaged ties, percentiles, weighted quantiles and guarded correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonepulse.sources.shared import materialize


#: Ranges of values that running totals are cut into.
RANGES = 200


def running_total(rows: DataFrame, value: str, weight: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of weights up to each row's value, of the key; values are distinct within a key.

    Values are cut into ranges at approximate quantiles; each range is summed by
    itself and lies behind the totals of those before it, RANGES rows a key. So no task
    holds all values of a key. It is one plan; where ``rows`` come from an aggregation, as here,
    its exchange is read again and not made again.
    """
    cuts = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000))).alias("__cuts"))
    ranged = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    totals = ranged.groupBy(*keys, "__range").agg(F.sum(weight).alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inside = F.sum(weight).over(W.partitionBy(*keys, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn("__inside", inside).join(before, [*keys, "__range"]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def average_rank(rows: DataFrame, value: str, out: str = "rank", keys: tuple[str, ...] = ()) -> DataFrame:
    """1-based ranks, ties averaged; nulls get no rank.

    Ranks are made on distinct values with their counts, so a value that holds
    most rows is one row, and joined back.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(counted, value, "__n", "__below", keys)
    return rows.join(ranked.select(*keys, value, (F.col("__below") - (F.col("__n") - 1) / 2).alias(out)), [*keys, value], "left")


def percentile_rank(rows: DataFrame, value: str, out: str = "percentile", keys: tuple[str, ...] = ()) -> DataFrame:
    """0 to 100 from averaged ranks; a lone value gets 50."""
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("__size")) if keys else rows.agg(F.count(value).alias("__size"))
    ranked = average_rank(rows, value, "__rank", keys)
    joined = ranked.join(sizes, list(keys)) if keys else ranked.crossJoin(F.broadcast(sizes))
    share = F.when(F.col("__size") == 1, F.lit(50.0)).otherwise((F.col("__rank") - 1) / F.nullif(F.col("__size") - 1, F.lit(0)) * 100)
    return joined.withColumn(out, F.when(F.col("__rank").isNotNull(), share)).drop("__rank", "__size")


def pearson(x: str, y: str) -> Column:
    """Aggregate: null for fewer than three pairs or no variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 3) & (spread > 0), F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson of averaged ranks of the complete pairs."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    return average_rank(average_rank(both, "x", "rx"), "y", "ry").agg(pearson("rx", "ry").alias("spearman"))


def weighted_quantile(rows: DataFrame, value: str, weight: str, shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, q, value): the smallest value whose cumulative weight reaches the share of the total.

    Rows without value or positive weight do not count. Equal values are summed
    before the running total.
    """
    held = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    run = running_total(held, value, "__w", "__cum", keys)
    sums = held.groupBy(*keys).agg(F.sum("__w").alias("__total"))
    run = run.join(sums, list(keys)) if keys else run.crossJoin(F.broadcast(sums))
    wide = run.groupBy(*keys).agg(*[F.min(F.when(F.col("__cum") >= q * F.col("__total"), F.col(value))).alias(f"q{k}") for k, q in enumerate(shares)])
    names = {f"q{k}": q for k, q in enumerate(shares)}
    tall = wide.unpivot(list(keys), list(names), "__name", value)
    return tall.select(*keys, F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("__name")).alias("q"), value)


def quantile(value: str, share: float, empty: float | None = None) -> Column:
    """Aggregate: linear interpolation over non-null values; ``empty`` if there are none."""
    found = F.percentile(F.col(value), share)
    return found if empty is None else F.coalesce(found, F.lit(empty))


def scatter_summary(points: DataFrame, most: int = 25) -> DataFrame:
    """Counts and correlations of each outcome, display and scale: (outcome, display, scale, n, zero_points, provinces, pearson, spearman).

    points: zone_id, x, cases, population, province. Outcomes are cases and cases a
    100,000 people (zones with people only); displays are all zones, affected ones and
    the ``most`` affected with the largest outcome, ties by id; scales linear and log1p.
    """
    share = points.where("population > 0").withColumn("v", F.col("cases") * 100_000.0 / F.col("population")).withColumn("outcome", F.lit("per100k"))
    both = points.withColumn("v", F.col("cases").cast("double")).withColumn("outcome", F.lit("cases")).unionByName(share)
    hit = F.col("cases") > 0
    displays = F.filter(F.array(F.lit("all"), F.when(hit, "affected")), lambda d: d.isNotNull())
    # each task passes on its own largest ones only
    first = both.where(hit).withColumn("__place", F.row_number().over(W.partitionBy("outcome").orderBy(F.desc("v"), "zone_id"))).where(F.col("__place") <= most).drop("__place")
    shown = both.withColumn("display", F.explode(displays)).unionByName(first.withColumn("display", F.lit("top25")))
    scaled = shown.withColumn("s", F.explode(F.array(F.struct(F.lit("linear").alias("scale"), F.col("v").alias("y")), F.struct(F.lit("log1p").alias("scale"), F.log1p(F.greatest(F.lit(0.0), F.col("v"))).alias("y")))))
    keys = ("outcome", "display", "scale")
    rows = materialize(scaled.select(*keys[:2], "s.scale", "x", "s.y", "cases", "province"), "scatter")
    ranked = average_rank(average_rank(rows, "x", "rx", keys), "y", "ry", keys)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cases") <= 0).alias("zero_points"), F.count_distinct(F.when(F.col("cases") > 0, F.col("province"))).alias("provinces"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))
