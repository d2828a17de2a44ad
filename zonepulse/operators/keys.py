"""Lookup joins by id and by name, name canonicalisation and fuzzy matching."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from zonepulse.functions.text import norm_name, strip_accents


def by_name(zones: DataFrame, name: str = "zone_name", order: str = "zone_id") -> DataFrame:
    """One zone per normalised name, the last duplicate by ``order``: (name_key, zone struct)."""
    return zones.withColumn("name_key", norm_name(F.col(name))).where("name_key <> ''").groupBy("name_key").agg(F.max_by(F.struct(*zones.columns), F.struct(order)).alias("named"))


def two_key(rows: DataFrame, zones: DataFrame, id_col: str = "zone_id", name_col: str = "zone_name", zone_name: str = "zone_name") -> DataFrame:
    """Adds ``zone``: the zone struct found by id, else by normalised name, else null."""
    ids = zones.select(F.col("zone_id").alias("__id"), F.struct(*zones.columns).alias("__by_id"))
    names = by_name(zones, zone_name).withColumnsRenamed({"name_key": "__name", "named": "__by_name"})
    found = rows.join(ids, rows[id_col] == ids["__id"], "left").join(names, norm_name(F.col(name_col)) == names["__name"], "left")
    return found.withColumn("zone", F.coalesce("__by_id", "__by_name")).drop("__id", "__name", "__by_id", "__by_name")


#: Names that differ in case or accents only are equal.
LOOSE = "UNICODE_CI_AI"


def collated(rows: DataFrame, *names: str, collation: str = LOOSE) -> DataFrame:
    """The columns with a collation: joins, groups and comparisons of them take it, no key column is made."""
    return rows.withColumns({n: F.collate(F.trim(F.col(n)), collation) for n in names})


def flagged(rows: DataFrame, listed: DataFrame, flag: str = "is_listed") -> DataFrame:
    """True where the row's id or its name is listed (semi-join as a flag)."""
    ids = listed.select(F.col("zone_id").alias("__lid")).where("__lid is not null").distinct().withColumn("__i", F.lit(True))
    names = listed.select(norm_name(F.col("zone_name")).alias("__ln")).where("__ln <> ''").distinct().withColumn("__n", F.lit(True))
    found = rows.join(ids, rows["zone_id"] == F.col("__lid"), "left").join(names, norm_name(rows["zone_name"]) == F.col("__ln"), "left")
    return found.withColumn(flag, F.coalesce("__i", "__n", F.lit(False))).drop("__lid", "__ln", "__i", "__n")


def canonical_names(rows: DataFrame, known: DataFrame, aliases: DataFrame, excluded: list[str], name_col: str = "raw", slack: int = 10) -> DataFrame:
    """Adds ``canonical``: alias, then accent-insensitive equality, then the longest known name inside.

    known: (name); aliases: (alias, name). Rows named in ``excluded`` get null.
    Containment needs word boundaries and a raw name of at most ``slack`` more
    characters. Blocks on the words of the raw name, so the join stays an equi-join.
    """
    key = lambda c: strip_accents(norm_name(c))
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__raw", key(F.col(name_col)))
    alias = aliases.select(key(F.col("alias")).alias("__raw"), F.col("name").alias("__alias")).dropDuplicates(["__raw"])
    names = known.select(F.col("name").alias("__known"), key(F.col("name")).alias("__key")).where("__key <> ''").dropDuplicates(["__key"])
    named = rows.join(alias, "__raw", "left").join(names.withColumnsRenamed({"__known": "__same", "__key": "__raw"}), "__raw", "left")
    words = rows.select("__row", "__raw", F.explode(F.array_distinct(F.split("__raw", " "))).alias("__word"))
    inside = words.join(names.withColumn("__word", F.element_at(F.split("__key", " "), 1)), "__word").where(F.contains(F.concat(F.lit(" "), "__raw", F.lit(" ")), F.concat(F.lit(" "), "__key", F.lit(" "))) & (F.length("__raw") <= F.length("__key") + slack))
    longest = inside.groupBy("__row").agg(F.max_by("__known", F.struct(F.length("__key"), "__key")).alias("__inside"))
    out = named.join(longest, "__row", "left")
    return out.withColumn("canonical", F.when(~F.col("__raw").isin([*excluded, ""]), F.coalesce("__alias", "__same", "__inside"))).drop("__row", "__raw", "__alias", "__same", "__inside")


@F.pandas_udf(DoubleType())
def match_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / (length of both), M the characters of matching blocks: the longest common piece, and so on left and right of it; 0 for two empty strings."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() if x or y else 0.0 for x, y in zip(a, b, strict=True)])


def gram_index(rows: DataFrame, id_col: str, block: str, name: str, q: int = 3) -> DataFrame:
    """(block, id, name, grams): the q-grams of each name, repeats numbered, in no order.

    Names are padded with q - 1 marks on both sides, so one of n characters has n + q - 1 grams.
    """
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col(name), F.lit("\x02" * (q - 1)))
    places = F.sequence(F.lit(1), F.length(name) + q - 1)
    grams = F.transform(places, lambda k: F.substring(padded, k, F.lit(q)))
    numbered = F.transform(grams, lambda g, k: F.concat(g, F.size(F.filter(F.slice(grams, 1, k + 1), lambda h: h == g)).cast("string")))
    return rows.select(F.col(block).alias("__block"), F.col(id_col).alias("__id"), F.col(name).alias("__name"), numbered.alias("__grams"))


def _prefix_length(n: Column, least: float, q: int) -> Column:
    """How many of its rarest grams a name of n characters needs, so that no partner of the score is missed.

    A partner keeps n - d characters and adds i, with 2 (n - d) >= least (2 n - d + i). A
    lost character costs at most q grams, an added one q - 1, so what is shared is least where
    nothing is added: d = 2 n (1 - least) / (2 - least), or nothing lost: i = 2 n (1 - least) / least.
    """
    lost, added = F.floor(2 * n * (1 - least) / (2 - least) + 1e-9), F.floor(2 * n * (1 - least) / least + 1e-9)
    # with d lost, (2 n (1 - least) - d (2 - least)) / least may be added: the worst of a sum linear in d stands at an end
    worst = F.greatest(lost * q + (q - 1), added * (q - 1) + q)
    return F.greatest(F.lit(1), F.least(n + q - 1, worst + 1)).cast("int")


def candidate_pairs(left: DataFrame, right: DataFrame, block: str, name: str, least: float = 5 / 6, q: int = 3) -> DataFrame:
    """(id, match_id, __ln, __rn): pairs of one block whose names may score ``least`` or more, from (id, block, name).

    A name meets only those that share one of its rarest q-grams and whose length allows
    the score; so a block of very many names is no product of all its rows. Rarity is
    counted over the right rows of the block, and both sides order their grams by it.
    Empty and null names have no partners.
    """
    a, b = (gram_index(x.where((F.col(name) != "") & F.col(block).isNotNull()), "id", block, name, q) for x in (left, right))
    rare = b.select("__block", F.explode("__grams").alias("__gram")).groupBy("__block", "__gram").agg(F.count(F.lit(1)).alias("__n"))

    def prefix(rows: DataFrame, known: bool) -> DataFrame:
        each = rows.select("__block", "__id", "__name", F.explode("__grams").alias("__gram")).join(rare, ["__block", "__gram"], "inner" if known else "left")
        order = W.partitionBy("__block", "__id", "__name").orderBy(F.coalesce("__n", F.lit(0)), "__gram")
        kept = each.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= _prefix_length(F.length("__name"), least, q))
        return kept.drop("__rank", "__n")

    l = prefix(a, False).withColumnsRenamed({"__id": "id", "__name": "__ln"})
    r = prefix(b, True).withColumnsRenamed({"__id": "match_id", "__name": "__rn"})
    short, both = F.least(F.length("__ln"), F.length("__rn")), F.length("__ln") + F.length("__rn")
    met = l.join(r, ["__block", "__gram"]).where(2 * short >= least * both - 1e-9).groupBy("id", "match_id", "__ln", "__rn").agg(F.count(F.lit(1)).alias("__shared"))
    # each lost or added character is an edit, or half of one that puts another in its place
    return met.where(F.levenshtein("__ln", "__rn") <= (1 - least) * (F.length("__ln") + F.length("__rn")) + 1e-9).drop("__shared")


def close_pairs(left: DataFrame, right: DataFrame, block: str, name: str, least: float = 5 / 6, q: int = 3) -> DataFrame:
    """(id, match_id, score) of all rows of one block whose names score ``least`` or more."""
    near = candidate_pairs(left, right, block, name, least, q)
    return near.withColumn("score", match_score("__ln", "__rn")).where(F.col("score") >= least - 1e-12).select("id", "match_id", "score")


def fuzzy_match(left: DataFrame, right: DataFrame, block: str, name: str, least: float = 5 / 6) -> DataFrame:
    """Best partner of each left row among right rows of its block: exact first, else by score.

    left and right have id, block and name; gives id, match_id, score, method.
    Ties go to the smaller right id. Rows without a partner keep nulls. Equal names
    meet by an equi-join, the others by ``close_pairs``.
    """
    own = left.select("id", F.col(block).alias("__block"), norm_name(F.col(name)).alias("__ln"))
    r = right.select(F.col("id").alias("__mid"), F.col(block).alias("__block"), norm_name(F.col(name)).alias("__rn"))
    same = own.join(r, (own["__block"] == r["__block"]) & (own["__ln"] == r["__rn"]) & (own["__ln"] != "")).groupBy("id").agg(F.min("__mid").alias("match_id"))
    rest = own.join(same, "id", "left_anti")
    pairs = close_pairs(rest.select("id", "__block", F.col("__ln").alias("__key")), r.select(F.col("__mid").alias("id"), "__block", F.col("__rn").alias("__key")), "__block", "__key", least)
    best = pairs.groupBy("id").agg(F.min_by(F.struct("match_id", "score"), F.struct(-F.col("score"), "match_id")).alias("m"))
    found = same.select("id", "match_id", F.lit(1.0).alias("score"), F.lit("exact").alias("method")).unionByName(best.select("id", "m.match_id", "m.score", F.lit("fuzzy").alias("method")))
    return left.select("id").join(found, "id", "left").withColumn("method", F.coalesce("method", F.lit("unmatched")))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (order-preserving dedupe when ordered by position)."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
