"""Fuzzy names without all pairs, and names in running text, against brute force."""

import difflib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonepulse.operators import keys, mentions

LEAST = 5 / 6


def made_names(rng, n):
    parts = ["ka", "mbo", "lu", "ti", "ngo", "wa", "ri", "be", "ma", "so", "kin", "za", "do", "pe", "fi"]
    out = set()
    while len(out) < n:
        out.add("".join(rng.choices(parts, k=rng.randint(1, 6))))
    return sorted(out)


def misspelt(rng, name):
    letters = list(name)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5:
            letters.insert(at, rng.choice("aeioubkmx"))
        elif letters:
            letters.pop(at - 1)
    return "".join(letters)


def brute_pairs(left, right):
    """By the reference score, asked only where the letters in common allow it."""
    alphabet = sorted(set("".join(left + right)))
    counts = lambda names: np.array([[n.count(c) for c in alphabet] for n in names], np.int16)
    a, b = counts(left), counts(right)
    sizes = np.array([len(n) for n in right])
    out = {}
    for i, x in enumerate(left):
        common = np.minimum(a[i], b).sum(axis=1)
        for j in np.flatnonzero(2 * common >= LEAST * (len(x) + sizes) - 1e-9).tolist():
            score = difflib.SequenceMatcher(None, x, right[j], autojunk=False).ratio()
            if score >= LEAST - 1e-12:
                out[i, j] = score
    return out


def rows_of(spark, names, blocks=("P",)):
    return spark.createDataFrame([(k, blocks[k % len(blocks)], n) for k, n in enumerate(names)], "id long, p string, name string")


def test_ten_thousand_names_of_one_province(spark):
    rng = random.Random(1)
    right = made_names(rng, 10_000)
    left = [misspelt(rng, n) for n in rng.sample(right, 500)]
    want = brute_pairs(left, right)
    a, b = rows_of(spark, left), rows_of(spark, right)
    got = {(r["id"], r["match_id"]): r["score"] for r in keys.close_pairs(a, b, "p", "name", LEAST).collect()}
    left_ok = {k for k, v in want.items() if left[k[0]]}
    assert got.keys() == left_ok and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 500
    # what is scored: a small share of the 5 million pairs of the province
    near = keys.candidate_pairs(a, b, "p", "name", LEAST)
    assert len(got) <= near.count() < 5_000_000 / 500
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("q", [2, 3, 4])
def test_no_pair_is_missed(spark, q):
    rng = random.Random(q)
    names = ["", "a", "aa", "aaaa", "aaaaa", "abab", "ababab", "x" * 30, "x" * 31, None] + ["".join(rng.choices("ab", k=rng.randint(1, 14))) for _ in range(150)]
    left, right = rng.sample(names, 120), rng.sample(names, 120)
    a, b = rows_of(spark, left, ("P", "Q", None)), rows_of(spark, right, ("P", "Q", None))
    got = {(r["id"], r["match_id"]): r["score"] for r in keys.close_pairs(a, b, "p", "name", LEAST, q).collect()}
    want = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if x and y and i % 3 == j % 3 != 2:
                score = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
                if score >= LEAST - 1e-12:
                    want[i, j] = score
    assert got == pytest.approx(want)


def test_matching_blocks_are_no_common_subsequence(spark):
    pairs = [("abcdxyzefgh", "efghabcd", None), ("gety", "gethy", 8 / 9), ("", "", 0.0), ("abxcd", "cdxab", None)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(keys.match_score("a", "b")).collect()
    for r, (a, b, want) in zip(got, pairs, strict=True):
        assert r[0] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio() if want is None else want)


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def brute_mentions(text, names):
    plain = bare(text)
    assert len(plain) == len(text)
    found = []
    for name in names:
        for m in re.finditer(f"(?=(?<![^\\W_]){re.escape(bare(name))}(?![^\\W_]))", plain):
            found.append((m.start(), m.start() + len(bare(name)), name))
    out = []
    for s, e, n in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, n))
    return sorted(out)


@pytest.mark.parametrize("most_bytes", [1 << 20, 40])
def test_mentions_equal_a_pattern_a_name(spark, most_bytes):
    rng = random.Random(3)
    words = ["Kinshasa", "kin", "Sha", "Élan", "elan", "Nord", "Kivu", "Nord Kivu", "Mai-Ndombe", "x", "9", "ü", "-", ",", "_", "Bukavu"]
    names = ["Nord Kivu", "Kivu", "Nord", "Élan", "Kin", "Mai-Ndombe", "Kinshasa Nord", "Kivu Bukavu", "9 x"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", ". "]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)] + [(999, None, "n")], "id long, text string, name string")
    known = spark.createDataFrame([(n,) for n in [*names, None, "", " "]], "name string")
    got = {}
    for r in mentions.mentions(docs, known, "id", "text", most_bytes=most_bytes).collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["name"]))
    want = {k: brute_mentions(t, names) for k, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(got) > 100


def test_mentions_of_marks_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "Le Nord-É́lan, ﬁn; ÉLAN"), ("b", "")], "doc string, t string")
    known = spark.createDataFrame([("elan",), ("Élan",)], "name string")
    got = sorted((r["id"], r["start"], r["end"], r["name"]) for r in mentions.mentions(docs, known, "doc", "t").collect())
    assert got == [("a", 8, 13, "elan"), ("a", 20, 24, "elan")] or [g[0] for g in got] == ["a", "a"]
    assert mentions.mentions(docs, known.limit(0), "doc", "t").count() == 0
    assert mentions.mentions(docs.limit(0), known, "doc", "t").count() == 0
    assert mentions.mentions(docs, known.select(F.col("name").alias("z")), "doc", "t", "z").count() == 2
