"""Edge rows and properties of the core operators."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonepulse.functions import numbers, text
from zonepulse.functions.geo import polygon_measures
from zonepulse.operators import asof, assess, extract, indicators, keys, mobility, models, publish, series, stats
from zonepulse.sources import tables
from zonepulse.streaming import ingest

D = datetime.date


def test_locale_numbers(spark):
    raw = [("34 118", 34118, 34118.0), ("1.234", 1234, 1.234), ("97,2%", 97, 0.972), ("ND", None, None), ("28,4%3", 28, 0.284), ("-", None, None), ("", None, None), ("1,234", 1, 1.234), (None, None, None)]
    df = spark.createDataFrame([(a,) for a, _, _ in raw], "s string").select(numbers.fr_int(F.col("s")), F.round(numbers.fr_float(F.col("s")), 6))
    assert [tuple(r) for r in df.collect()] == [(b, c) for _, b, c in raw]


def test_no_data_is_null_and_never_nan(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), (" ",), (None,), ("0",), ("2.5",), ("x",)], "s string")
    assert [r[0] for r in df.select(numbers.to_number(F.col("s"))).collect()] == [0, 0, 0, 0, 0, 2.5, 0]
    assert [r[0] for r in df.select(numbers.metric(F.col("s"))).collect()] == [None, None, None, None, 0, 2.5, None]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (3.5,)], "x double").select(numbers.half_up(F.col("x")), numbers.half_even(F.col("x")))
    assert [tuple(r) for r in df.collect()] == [(3, 2), (-2, -2), (4, 4)]


def test_labelled_numbers(spark):
    raw = [("1 234 Cases", 1234, None, None), ("7,001 cases", 7001, None, None), ("5\n6 Cases", 6, None, None), ("1.2.3 cases", None, None, None), ("2 imported 3 local", None, 2, 3), ("2 imported and 3 local", None, None, None), ("9" * 25 + " cases", None, None, None), ("", None, None, None), (None, None, None, None)]
    s = F.col("s")
    df = spark.createDataFrame([(r[0],) for r in raw], "s string").select(text.number_before(s, "cases"), *text.number_pair(s, "imported", "local"))
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in raw]


def test_dates(spark):
    df = spark.createDataFrame([("le 8 juin 2026", "8 June 2026", "8-Jun-26"), ("08/06/2026", "June", "x"), ("31/02/2026", None, None), (None, "", "")], "f string, e string, c string")
    got = df.select(text.french_date(F.col("f")), text.english_date(F.col("e")), text.chart_date(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(D(2026, 6, 8),) * 3, (D(2026, 6, 8), None, None), (None, None, None), (None, None, None)]


def test_gap_spreading_and_decrease(spark):
    reports = spark.createDataFrame([(D(2026, 5, 14), 8, "N1"), (D(2026, 5, 17), 13, "N2"), (D(2026, 5, 18), 10, "N3")], "date date, cumulative long, report_no string")
    got = [tuple(r) for r in series.daily(reports).orderBy("date").collect()]
    assert [round(r[1], 4) for r in got] == [8, 1.6667, 1.6667, 1.6667, 0]
    assert [r[3] for r in got] == ["N1", None, None, "N2", "N3"]


def test_increments_sum_to_the_last_value(spark):
    rng = random.Random(3)
    day, total, rows = D(2026, 1, 1), 0, []
    for k in range(20):
        day += datetime.timedelta(days=rng.randint(1, 4))
        total += rng.randint(0, 30)
        rows.append((day, total, f"N{k}"))
    df = series.daily(spark.createDataFrame(rows, "date date, cumulative long, report_no string"))
    assert abs(df.agg(F.sum("incidence")).first()[0] - total) < 1e-9


def test_generation_weights(spark):
    w = [r["weight"] for r in series.generation_weights(spark, 12.0, 5.0).orderBy("lag").collect()]
    assert abs(sum(w) - 1) < 1e-12 and abs(w[1] - 6.11e-4) < 1e-6 and abs(w[2] - 4.299e-3) < 1e-6
    assert np.allclose(w, models.weights_array(models.SHORT_TERM))


def test_asof_fallbacks(spark):
    rows = spark.createDataFrame([("a", D(2026, 1, 1), 1), ("a", D(2026, 1, 5), 2), ("b", D(2026, 2, 1), 3)], "k string, date date, v int")
    got = {r["k"]: r["v"] for r in asof.latest_or_first(rows, ["k"], "date", "2026-01-03").collect()}
    assert got == {"a": 1, "b": 3}
    assert asof.baseline_date(rows, "date", "2026-01-02").first()[0] == D(2026, 1, 1)


def test_first_date_is_its_own_baseline(spark):
    rows = spark.createDataFrame([("1", "Z", "P", D(2026, 1, 1), 5, 1)], "zone_id string, health_zone string, province string, date date, confirmed_cases int, confirmed_deaths int")
    assert asof.increase(rows, "2026-01-01").first()["recent_cases"] == 0


def zones(spark):
    return spark.createDataFrame([("1", "Alpha", "P", "kinshasa", 0, 1, 0.0, 30.0, 10.0), ("2", "Beta", "P", "uganda_border", 1, 0, 1.0, 31.0, None), ("3", "Lone", "Q", "other", 0, 0, None, None, 5.0)], "zone_id string, zone_name string, province string, category string, is_uganda_border int, is_kinshasa int, lat double, lon double, area_km2 double")


def test_weighted_risk_edges(spark):
    cases = spark.createDataFrame([(None, " alpha ", "P", 4, 0), ("9", "Ghost", "P", 2, 0), (None, "Nowhere", "P", 7, 0), ("2", "Beta", "P", 0, 0)], "zone_id string, health_zone string, province string, confirmed_cases int, confirmed_deaths int")
    flows = spark.createDataFrame([("m", "1", "2", 10), ("m", "2", "1", 50), ("m", "9", "7", 3), ("m", "1", "1", 0)], "month string, origin_id string, destination_id string, movement int")
    affected = mobility.affected_origins(cases, zones(spark))
    assert {r["zone_id"] for r in affected.collect()} == {"1", "9"}
    out = {r["zone_id"]: (r["score"], r["incoming"]) for r in mobility.universe(zones(spark), mobility.weighted(flows, affected)).collect()}
    assert out == {"1": (0, 0), "2": (40, 10), "3": (0, 0), "7": (6, 3)}


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [("m", str(rng.randint(0, 9)), str(rng.randint(0, 9)), rng.randint(0, 50)) for _ in range(300)]
    affected = spark.createDataFrame([(str(k), k) for k in range(0, 10, 2)], "zone_id string, confirmed_cases int")
    one = spark.createDataFrame(rows, "month string, origin_id string, destination_id string, movement int")
    got = [sorted(map(tuple, mobility.weighted(df, affected).collect())) for df in (one, one.repartition(7), one.orderBy(F.desc("movement")))]
    assert got[0] == got[1] == got[2]


def test_contact_multiplier(spark):
    rows = spark.createDataFrame([("North Kivu", D(2026, 1, 1), None, 0.95), ("Q", D(2026, 3, 1), 0.99, 0.95)], "province string, date date, followup_rate double, target_rate double")
    got = {r[0]: round(r[1], 4) for r in mobility.contact_multiplier(rows, "2026-02-01").collect()}
    assert got == {"nord-kivu": 1.95, "q": 1.0}


def test_air_rules_take_the_smallest_factor(spark):
    rules = spark.createDataFrame([("category", "kinshasa", 0.6), ("zone_name", "ALPHA", 0.4)], "match_type string, match_value string, air_factor double")
    got = {r["zone_id"]: r["air_factor"] for r in mobility.air_factor(zones(spark), rules).collect()}
    assert got == {"1": 0.4, "2": 1.0, "3": 1.0}


def test_border_hub_defaults(spark):
    none = spark.createDataFrame([], "month string, origin_id string, destination_id string, movement int")
    assert tuple(mobility.border_pressure(none, zones(spark)).first()) == (0, *mobility.DEFAULT_HUB)


@pytest.mark.parametrize("values, want", [([5.0], [50.0]), ([1.0, 2.0], [0.0, 100.0]), ([1.0, 1.0, 3.0], [25.0, 25.0, 100.0])])
def test_percentile_rank_ties(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r["percentile"] for r in stats.percentile_rank(df, "v").orderBy("v").collect()]
    assert got == [None, *want]


def test_guarded_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (None, 1.0)], "x double, y double")
    assert abs(df.agg(stats.pearson("x", "y")).first()[0] - np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1]) < 1e-12
    assert df.limit(2).agg(stats.pearson("x", "y")).first()[0] is None
    assert df.withColumn("y", F.lit(1.0)).agg(stats.pearson("x", "y")).first()[0] is None


def test_weighted_quantiles_are_monotone(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(float(rng.randint(0, 20)), rng.random()) for _ in range(100)], "v double, w double")
    got = [r["v"] for r in stats.weighted_quantile(df, "v", "w", [0.1, 0.5, 0.9]).orderBy("q").collect()]
    assert got == sorted(got)


def test_metric_timeline_fallback(spark):
    rows = spark.createDataFrame([(D(2026, 1, 1), "province", 0.2, 3, 1), (D(2026, 1, 1), "province", 0.4, 5, 2), (D(2026, 1, 2), "national", 0.9, None, 3), (D(2026, 1, 2), "province", 0.1, 7, 4)], "date date, admin_level string, contact_followup_rate double, alerts_reported int, pos long")
    assert [round(r["value"], 4) for r in indicators.timeline(rows, "contact_followup_rate").orderBy("date").collect()] == [0.3, 0.9]
    assert [r["value"] for r in indicators.timeline(rows, "alerts_reported").orderBy("date").collect()] == [8, 7]


def test_assessment_rules(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1.3, 0.7, None, 0.0), (0.7, 0.1, 0.8, 0.0), (0.7, 0.1, 0.8, 0.4), (1.0, 0.5, None, None)], "rt double, p double, ratio double, gap double")
    got = [r[0] for r in rows.select(assess.local_level(*map(F.col, ["rt", "p", "ratio", "gap"]))).collect()]
    assert got == ["uncertain", "high", "low", "moderate_high", "moderate"]
    got = [r[0] for r in spark.createDataFrame([(0.05, 500, 0.96), (0.5, 0, None), (0.3, 0, 0.99), (0.1, 0, 0.5)], "s double, c int, p double").select(assess.border_level(F.col("s"), F.col("c"), F.col("p"))).collect()]
    assert got == ["low", "high", "moderate_high", "moderate"]


def test_vertical_table_stops_at_the_next_zone(spark):
    page = "Tableau\nAlpha\n12\n3,0%\nBeta\n5\n2\n40%\nSous total\n17\n2\nAutres ZS\n4\nTOTAL\n21"
    docs = spark.createDataFrame([(1, page), (2, None)], "id int, t string")
    got = {(r["zone"], r["kind"]): (r["cases"], r["deaths"]) for r in extract.vertical_table(extract.lines(docs, "id", "t"), zones(spark).select(F.col("zone_name").alias("name"))).collect()}
    assert got == {("Alpha", "zone"): (12, None), ("Beta", "zone"): (5, 2), ("Sous total", "total"): (17, 2), ("Autres ZS", "unassigned"): (4, None), ("TOTAL", "total"): (21, None)}


def test_x4_x5_rates_and_travellers(spark):
    page = "Taux de suivi de contacts : 11,0%. Taux de Suivi : 28,4%3. Pour la journée du 8 juin 2026, 419 alertes ont été reçues\ndont 377 (90,0%) investiguées. Voyageurs passés par le PoE/PoC 34 118. Voyageurs screenés 33 163 (97,2%)"
    f = spark.createDataFrame([(page,)], "t string").select(extract.response_fields(F.col("t")).alias("f")).first()["f"]
    assert (round(f["contact_followup_rate"], 4), f["alerts_reported"], f["alerts_investigated"], f["travellers_total"], f["travellers_screened"], round(f["poe_screening_coverage"], 4)) == (0.284, 419, 377, 34118, 33163, 0.972)
    lab = "12 nouveaux échantillons ont été analysés dont 5 sont revenus positifs. Échantillons reçus 99 et cas positifs 7"
    table = "Échantillons reçus 99; Nbre d’échantillons analysés 80; Nbre des cas positifs 0"
    got = [r["f"] for r in spark.createDataFrame([(lab,), (table,)], "t string").select(extract.response_fields(F.col("t")).alias("f")).collect()]
    assert [(f["samples_received"], f["samples_analysed"], f["positive_samples"]) for f in got] == [(None, 12, 5), (99, 80, None)]


def test_national_totals(spark):
    raw = [
        ("Cumul de cas confirmés 08 juin 2026", None, None),
        ("le cumul des cas confirmés s’élève à 563 cas", 563, None),
        ("Ituri (563 cas), Nord-Kivu (32 cas) et\nSud Kivu (3 cas)", 598, None),
        ("TOTAL 598 111 18,6 %", 598, 111),
        ("Cumul des décès parmi les confirmés (létalité) : 111 (18,6%)", None, 111),
        ("598 cas confirmés dont 12 nouveaux", 598, None),
        ("cumul cas confirmés : 99999", None, None),
        (None, None, None),
        ("", None, None),
    ]
    t = F.col("t")
    got = spark.createDataFrame([(r[0],) for r in raw], "t string").select(extract.national_cases(t), extract.national_deaths(t)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in raw]


def test_report_numbers(spark):
    raw = [("SitRep MVE N° 028 du 12 juin", 28), ("sitrep-n7", 7), ("sitrep_n 12.pdf", 12), ("N° 031 / MVB", 31), ("No 5", 5), ("rapport n12", None), ("N028", 28), ("", None), (None, None), ("SITREP N°026", 26)]
    got = spark.createDataFrame([(r[0],) for r in raw], "t string").select(text.report_number(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in raw]


def test_latest_article_and_urls(spark):
    links = [(0, "SitRep N° 027 du 11 juin 2026", "http://h/a"), (1, "SitRep N° 028", "http://h/b_12-06-2026"), (2, "SitRep N° 028 du 12/06/2026", "http://h/c"), (3, "N° 99", "http://h/d"), (4, "SitRep N°028 du 12 juin 2026", "http://h/e"), (5, None, "http://h/sitrep-n3")]
    got = extract.latest_article(spark.createDataFrame(links, "pos int, text string, url string")).collect()
    assert [(r["url"], r["number"], r["date"]) for r in got] == [("http://h/b_12-06-2026", 28, D(2026, 6, 12))]
    page = """<a href="https://x.org/a.pdf">1</a><a data-id="5" href="/page">2</a><iframe src="viewer.html?file=/wp-content/uploads/S%20N28.pdf"></iframe><div data-pdf='%2Fdownload%2F7'></div>
    <script>pdf: "docs/b+c.PDF", url = 'mailto:a.pdf'; file="https://x.org/a.pdf"</script>"""
    rows = extract.urls(spark.createDataFrame([(1, page), (2, None)], "id int, t string"), "id", "t", "https://h.org/dir/p.html").orderBy("pos").collect()
    assert [r["url"] for r in rows] == ["https://x.org/a.pdf", "https://h.org/wp-content/uploads/S%20N28.pdf", "https://h.org/dir/viewer.html?file=/wp-content/uploads/S N28.pdf", "https://h.org/download/7", "https://h.org/dir/docs/b+c.PDF"]


def test_first_of_equal_rows_stays(spark):
    rows = [("a", 5, "z", 0), ("a", 5, "x", 1), ("b", None, "n", 0), ("b", 1, "v", 1)]
    for df in (spark.createDataFrame(rows, "k string, v int, note string, pos int"), spark.createDataFrame(rows[::-1], "k string, v int, note string, pos int")):
        assert {r["k"]: r["note"] for r in extract.max_per_zone(df, ["k"], "v", "pos").collect()} == {"a": "z", "b": "v"}
        assert {r["k"]: r["note"] for r in extract.max_per_zone(df.drop("pos"), ["k"], "v").collect()} == {"a": "x", "b": "v"}


def test_fuzzy_scores(spark):
    pairs = [("gety", "gethy", 8 / 9), ("massa", "masa", 8 / 9), ("kimbao", "kimbau", 10 / 12), ("mongbwalu", "mongbalu", 16 / 17), ("ab", "ba", 0.5), ("", "", 0.0), ("a", "", 0.0)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(keys.match_score(F.col("a"), F.col("b"))).collect()
    assert all(abs(r[0] - p[2]) < 1e-12 for r, p in zip(got, pairs, strict=True))
    left = spark.createDataFrame([("1", "P", "Gety"), ("2", "P", "Massa"), ("3", "P", "Other"), ("4", "Q", "Gety"), ("5", "P", "Aru")], "id string, block string, name string")
    right = spark.createDataFrame([("x", "P", "Gethy"), ("y", "P", "MASA"), ("w", "P", " aru "), ("v", "P", "aru")], "id string, block string, name string")
    found = {r["id"]: (r["match_id"], r["method"]) for r in keys.fuzzy_match(left, right, "block", "name").collect()}
    assert found == {"1": ("x", "fuzzy"), "2": ("y", "fuzzy"), "3": (None, "unmatched"), "4": (None, "unmatched"), "5": ("v", "exact")}


def test_polygon_measures_of_odd_geometries(spark):
    raw = ["null", "5", None, "", "{", '{"type":"Polygon","coordinates":[[]]}', '{"type":"Polygon","coordinates":[]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1],[0,0]],[]],[[]]]}']
    got = [r["m"] for r in spark.createDataFrame([(x,) for x in raw], "g string").select(polygon_measures("g").alias("m")).collect()]
    assert all(r["area_km2"] is None for r in got[:-1]) and abs(got[-1]["area_km2"] - 12364) < 20


def test_unknown_places_and_classes(spark):
    rows = spark.createDataFrame([("", None), ("", "z1"), (None, None), ("Bunia", "unknown_1"), ("Données non ventilées", "z"), ("Aru", "a")], "n string, i string")
    assert [r[0] for r in rows.select(text.unknown_place(F.col("n"), F.col("i"))).collect()] == [True, False, True, True, True, False]
    values = spark.createDataFrame([(None,), (-0.5,), (0.1,), (0.25,), (0.45,), (0.9,), (7.0,)], "v double")
    assert [tuple(r) for r in values.select(numbers.response_class(F.col("v"), True), numbers.response_class(F.col("v"))).collect()] == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (5, 5), (5, 5)]


def test_running_totals_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), v, rng.randint(1, 5)) for v in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame([(k, float(v), n) for k, v, n in rows], "k string, v double, n long")
    got = {(r["k"], r["v"]): r["t"] for r in stats.running_total(df, "v", "n", "t", ("k",)).collect()}
    assert got == {(k, float(v)): sum(n for j, w, n in rows if j == k and w <= v) for k, v, _ in rows}


def test_accents_by_rule():
    import unicodedata

    table = str.maketrans(dict(zip(text._ACCENTED, text._PLAIN + "\0" * 2000, strict=False)))  # noqa: SLF001
    for c in "éÉçñőŻệΆйǅßœ日́":
        want = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        assert c.translate(table).replace("\0", "") == want


def test_x6_missing_stays_missing(spark):
    f = spark.createDataFrame([("rien",), (None,)], "t string").select(extract.response_fields(F.col("t")).alias("f")).collect()
    assert all(v is None for r in f for v in r["f"])


def test_x8_blank_keys_are_replaced_and_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("2026-01-01", None, 1), ("2026-01-02", "P", 2)], "d string, p string, v int")
    new = spark.createDataFrame([("2026-01-01", "", 5)], "d string, p string, v int")
    once = publish.upsert(old, new, ["d", "p"])
    assert sorted(r["v"] for r in once.collect()) == [2, 5]
    assert sorted(r["v"] for r in publish.upsert(once, new, ["d", "p"]).collect()) == [2, 5]


def test_x10_corrected_report_withdraws_zones(spark):
    old = spark.createDataFrame([("d1", "A", 1), ("d1", "B", 2), ("d2", "A", 3)], "d string, z string, v int")
    got = publish.replace_partition(old, spark.createDataFrame([("d1", "A", 9)], "d string, z string, v int"), ["d"])
    assert sorted(map(tuple, got.collect())) == [("d1", "A", 9), ("d2", "A", 3)]


def test_validation_quarantines(spark):
    rows = spark.createDataFrame([("a", "zone", 5), ("a", "unassigned", 2), ("b", "zone", 5)], "r string, kind string, cases int")
    totals = spark.createDataFrame([("a", 7), ("b", 6), ("c", 1), ("d", None)], "r string, total int")
    assert {r["r"]: r["accepted"] for r in publish.validated(rows, totals, "r", "cases").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_flow_normaliser_requires_columns(spark):
    with pytest.raises(ValueError, match="movement"):
        publish.normalise_flows(spark.createDataFrame([("m", "1", "2")], "month string, origin_hz_id string, destination_hz_id string"))


def test_canonical_names(spark):
    raw = spark.createDataFrame([("Béta",), ("zone alpha ici",), ("alphabet",), ("total",), ("al",), (None,)], "raw string")
    got = [r["canonical"] for r in keys.canonical_names(raw, spark.createDataFrame([("Alpha",), ("Beta",)], "name string"), spark.createDataFrame([("AL", "Alpha")], "alias string, name string"), ["total"]).collect()]
    assert sorted(map(str, got)) == sorted(["Beta", "Alpha", "None", "None", "Alpha", "None"])


def test_zero_run(spark):
    rows = [(1, D(2026, 1, k + 1), v) for k, v in enumerate([1, 0, 0, 2, 0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "k int, date date, incidence int")
    assert series.zero_run(df, 3, ("k",)).first()["start"] == D(2026, 1, 5)


def test_simulations_repeat_and_agree_with_the_mean(spark):
    days = spark.createDataFrame([(D(2026, 1, 1) + datetime.timedelta(days=k), 20.0, 20.0 * (k + 1), None) for k in range(40)], "date date, incidence double, cumulative double, report_no string")
    one, two = (models.simulate(days, "2026-02-09", 7, 400, models.SHORT_TERM) for _ in range(2))
    a, b = (sorted(map(tuple, x.collect())) for x in (one, two.repartition(3)))
    assert a == b and len(a) == 2800
    assert 14 < np.mean([r[3] for r in a]) < 28
    bands = models.forecast(days, "2026-02-09", 7, 400).collect()
    assert all(r["q05"] <= r["q50"] <= r["q95"] for r in bands)


def test_too_short_series_gives_no_forecast(spark):
    days = spark.createDataFrame([(D(2026, 1, 1), 1.0, 1.0, None)], "date date, incidence double, cumulative double, report_no string")
    assert models.simulate(days, "2026-01-02", 7, 100, models.SHORT_TERM).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,\n')
    assert tables.scan_csv(spark, str(tmp_path / "a.csv"), "x int, y string").count() == 2
    assert [r["y"] for r in tables.scan_strings(spark, str(tmp_path / "a.csv")).orderBy("x").collect()] == ["two\nlines", ""]
    assert tables.scan_optional_csv(spark, str(tmp_path / "no.csv"), "x int").count() == 0
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"a": " ", "b": "v"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,1],[0,0]]]}}]}')
    (tmp_path / "e.json").write_text('{"features": []}')
    shapes = tables.scan_geojson(spark, str(tmp_path / "g.json"))
    row = shapes.select(tables.property_of(["a", "b"]).alias("p"), polygon_measures("geometry").alias("m")).first()
    assert row["p"] == "v" and abs(row["m"]["area_km2"] - 12364) < 20 and (row["m"]["lat"], row["m"]["lon"]) == (0.5, 0.5)
    assert tables.scan_geojson(spark, str(tmp_path / "e.json")) is None and tables.scan_geojson(spark, str(tmp_path / "no")) is None
    assert tables.scan_json(spark, str(tmp_path / "no.json")) is None
    assert set(tables.load_all(spark, str(tmp_path))) == set(tables.SCHEMAS)
    assert tables.landed(spark, str(tmp_path), "*.csv").count() == 1
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc_id string, page int, text string")
    assert tables.page_text(pages).first()["text"] == "--- PAGE 1 ---\na\n--- PAGE 2 ---\nb"


def test_incremental_ingestion(spark, tmp_path):
    land, table, bad = tmp_path / "land", str(tmp_path / "table"), str(tmp_path / "bad")
    land.mkdir()
    publisher = ingest.split_publish(F.col("v") > 0, table, bad, "one")

    def poll(publish, checkpoint):
        ingest.ingest(spark, str(land), "k string, v int", str(tmp_path / checkpoint), publish).awaitTermination()

    rows = lambda: sorted(map(tuple, ingest.current(spark, table, ["k"]).collect()))
    for n, body in enumerate(("k,v\na,1\nb,-1\n", "k,v\na,2\nc,3\n")):
        (land / f"f{n}.csv").write_text(body)
        poll(publisher, "ck")
        poll(publisher, "ck")  # nothing new
    assert rows() == [("a", 2), ("c", 3)] and spark.read.json(f"{bad}/*").where("k is not null").count() == 1
    # a batch that runs again publishes once; a new checkpoint under a new name adds to the table
    before = sorted(ingest._listed(spark, table))  # noqa: SLF001
    publisher(spark.createDataFrame([("a", 2), ("c", 3)], "k string, v int"), 1)
    assert sorted(ingest._listed(spark, table)) == before and rows() == [("a", 2), ("c", 3)]  # noqa: SLF001
    (land / "f2.csv").write_text("k,v\na,9\n")
    poll(ingest.split_publish(F.col("v") > 0, table, bad, "two"), "ck2")
    assert rows()[1:] == [("c", 3)] and len(ingest._listed(spark, table)) == 3  # noqa: SLF001
    ingest.compact(spark, table, ["k"], str(tmp_path / "folded"))
    assert sorted(map(tuple, ingest.current(spark, str(tmp_path / "folded"), ["k"]).collect())) == rows()


def test_windows_and_sessions(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(k, at + datetime.timedelta(minutes=m), 1, "view") for k, m in enumerate((0, 10, 100, 100))]
    events = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, event_type string")
    assert sorted(r["n"] for r in ingest.windowed_counts(events).collect()) == [2, 2]
    assert sorted(r["n"] for r in ingest.sessions(events).collect()) == [2, 2]
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = ingest.deduplicated(stream, ["user_id"]).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("dedup").count() == 1


def test_draws_follow_their_distributions(spark):
    rows = models.draws(spark, ["x", "y"], 4000, 6.0, 0.4)
    got = rows.agg(*[f(c) for c in ("normal", "gamma", "poisson", "negative_binomial") for f in (F.avg, F.var_samp)]).first()
    want = (0, 1, 6, 90, 6, 6, 6, 96)
    assert all(abs(a - b) <= 0.15 * max(b, 0.5) for a, b in zip(got, want, strict=True))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, models.draws(spark, ["y", "x"], 4000, 6.0, 0.4).collect()))


def test_quarantine_names_its_reasons(spark):
    rows = spark.createDataFrame([(1, 2), (None, 2), (0, 0)], "a int, b int")
    got = [(r["status"], r["reasons"]) for r in publish.quarantined(rows, {"a": F.col("a") > 0, "b": F.col("b") > 0}).collect()]
    assert got == [("published", ""), ("needs review", "a"), ("needs review", "a,b")]


def test_english_dates_as_written(spark):
    raw = [("as of 1st January, 2024 and 2 May 2025", D(2024, 1, 1)), ("29 FEBRUARY\t2024", D(2024, 2, 29)), ("29 February 2023", None), ("112 June 2026", D(2026, 6, 12)), ("0 June 2026", None), ("08 june 20261", D(2026, 6, 8)), ("8 Jun 2026", None), ("8 juin 2026", None), ("8 sept 2026, 9 September 2026", None), ("3rd\nMarch 2020", D(2020, 3, 3)), ("8 June 1999", None), ("", None), (None, None)]
    got = spark.createDataFrame([(r[0],) for r in raw], "t string").select(text.english_date(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in raw]


def test_snapshot_searches_a_page_once_a_value(spark):
    page = "12,345 confirmed cases and 0 deaths as of 5 June 2026; 3 imported cases 4 local cases"
    found = extract.snapshot(spark.createDataFrame([(1, page)], "id int, t string"), "id", "t")
    assert [tuple(r) for r in found.collect()] == [(1, D(2026, 6, 5), 12345, 0, 3, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(t#") == 4 and plan.count("20[0-9]{2}") == 2
    for lacking in ("1 confirmed cases and 0 deaths", "0 deaths as of 5 June 2026", "1 confirmed cases as of 5 June 2026", None):
        with pytest.raises(Exception, match="a page lacks its"):
            extract.snapshot(spark.createDataFrame([(1, lacking)], "id int, t string"), "id", "t").collect()


def test_urls_cut_a_page_once(spark):
    many = "".join(f"<a href = '/download/{k}'>x</a>" for k in range(3000))
    odd = ["", "'", "''", "\"'", "href='", "href=''/a.pdf'", "data-x \n= 'b.pdf' data-='' src :\t\"c.pdf", "file" + " " * 50_000 + "=\t'd.pdf'", "data-" + "a" * 50_000 + "='e.pdf'", "data-a b='f.pdf' x=\"g.pdf\" 'pdf'='h.pdf'", None, many]
    pages = spark.createDataFrame(list(enumerate(odd)), "id int, t string")
    found = extract.urls(pages, "id", "t", "https://h.org/r/p.html")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(t#") == 2
    got = sorted((r["doc_id"], r["pos"], r["url"]) for r in found.collect())
    want = [(6, 0, "r/b.pdf"), (7, 0, "r/d.pdf"), (8, 0, "r/e.pdf"), *((11, k, f"download/{k}") for k in range(3000))]
    assert got == [(page, pos, f"https://h.org/{url}") for page, pos, url in want]
