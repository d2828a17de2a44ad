"""Number coercion and rounding with the rules of the input tables.

"No data" is null everywhere; NaN never enters a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def to_number(text: Column) -> Column:
    """Anything that is not a finite number counts as 0."""
    return F.coalesce(_finite(text.try_cast("double")), F.lit(0.0))


def metric(text: Column) -> Column:
    """Blank or non-numeric is no data; a real 0 stays 0."""
    return _finite(F.nullif(F.trim(text.cast("string")), F.lit("")).try_cast("double"))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def fr_int(text: Column) -> Column:
    """Spaces and dots group thousands, a comma starts decimals, ND, NA and - are no data."""
    clean = F.trim(F.regexp_replace(text, "[\\u00a0\\u202f\\t ]+", " "))
    digits = F.regexp_replace(_found(clean, r"-?[0-9][0-9\s,.]*"), r"[\s.]", "")
    value = F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.upper(clean).isin("", "ND", "NA", "-"), value.try_cast("long"))


def fr_float(text: Column) -> Column:
    """Decimal commas; a percent sign anywhere divides by 100."""
    clean = F.trim(F.regexp_replace(text, "[\\u00a0\\u202f\\t ]+", " "))
    value = F.replace(_found(F.replace(clean, F.lit(" "), F.lit("")), r"-?[0-9]+(?:[,.][0-9]+)?"), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.upper(clean).isin("", "ND", "NA", "-"), F.when(F.contains(clean, F.lit("%")), value / 100).otherwise(value))


def en_int(text: Column) -> Column:
    """Commas and white space group thousands, a dot starts decimals, which are cut off."""
    return F.regexp_replace(F.regexp_extract(text, r"-?[0-9][0-9,.\s]*", 0), r"[\s,]", "").try_cast("double").try_cast("long")


def half_up(value: Column) -> Column:
    """floor(x + 0.5), also below zero."""
    return F.floor(value + F.lit(0.5))


def half_even(value: Column) -> Column:
    return F.bround(value).cast("long")


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null, unlike greatest and least."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def bucket(value: Column, breaks: Column, positive: bool = True) -> Column:
    """1 + the breaks (an array column) that the value exceeds; 0 without data and, if positive, for 0 or less."""
    over = F.size(F.filter(F.coalesce(breaks, F.array().cast("array<double>")), lambda b: value > b))
    held = value > 0 if positive else value.isNotNull()
    return F.when(F.coalesce(held, F.lit(False)), 1 + over).otherwise(0)


#: Lower limits of the upper four of five classes of a response indicator. Fixed values.
GAP_CLASSES, RATE_CLASSES = (0.10, 0.25, 0.45, 0.65), (0.25, 0.50, 0.70, 0.90)


def response_class(value: Column, gap: bool = False) -> Column:
    """1 to 5 of a share clamped to 0..1, 0 without data; limits belong to the upper class."""
    held = clamp(value, 0.0, 1.0)
    steps = [F.when(held >= limit, 1).otherwise(0) for limit in (GAP_CLASSES if gap else RATE_CLASSES)]
    return F.when(held.isNotNull(), 1 + steps[0] + steps[1] + steps[2] + steps[3]).otherwise(0)


def quintile_label(percentile: Column) -> Column:
    """Wealth quintile with strict upper limits at 20, 40, 60 and 80."""
    return F.when(percentile < 20, "lowest").when(percentile < 40, "lower").when(percentile < 60, "middle").when(percentile < 80, "higher").when(percentile.isNotNull(), "highest")
