"""Every core query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from zonepulse.functions import text as functions_text
from zonepulse.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[k]) for k in at) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect()


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 12


def test_zero_runs_of_every_user(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_type").collect()
    found = {r["k"]: r["start"] for r in catalog.QUERIES["e9_zero_run"](spark, SF).collect()}
    errors = {(r["user_id"], r["ts"].date()) for r in events if r["event_type"] == "error"}
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(30)]
    want = {}
    for user in {r["user_id"] for r in events}:
        quiet = [(user, d) not in errors for d in days]
        start = next((k for k in range(27) if all(quiet[k : k + 4])), None)
        if start is not None:
            want[user] = days[start]
    assert found == want and len(want) > 0


def test_texts_whole_and_every_row(spark):
    import re
    import unicodedata

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    clean = {r["doc_id"]: r["clean"] for r in catalog.QUERIES["h2_normalise_text"](spark, SF).collect()}
    assert clean == {r["doc_id"]: re.sub("[ \t\u00a0\u202f]+", " ", r["text"] or "").strip(" ") for r in docs}
    assert any(len(x) > 200 for x in clean.values())
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    want = sorted((r["conv_id"], r["turn"], r["text"] and bare(r["text"])) for r in turns)
    assert sorted(map(tuple, catalog.QUERIES["h3_strip_accents"](spark, SF).collect())) == want
    assert len(catalog.QUERIES["h6_french_dates"](spark, SF).where("worded is null").head(1)) == 1


def test_accents_pass_through_and_late_spaces(spark):
    df = spark.createDataFrame([("Straße é 漢",), ("x" * 250 + " \u00a0\t y",)], "text string")
    got = df.select(functions_text.strip_accents(df.text).alias("a"), functions_text.norm_spaces(df.text).alias("b")).collect()
    assert got[0]["a"] == "Straße e 漢" and got[1]["b"] == "x" * 250 + " y"


def over_events(spark, folder, events, name):
    """A query's rows over the given events, and those of its SQL."""
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    for table in os.listdir(SF):
        held = f"{folder}/events.parquet/*.parquet" if table == "events.parquet" else f"{SF}/{table}"
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{held}'")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    found = catalog.QUERIES[name](spark, str(folder))
    return rows(found.columns, found.collect()), rows([d[0] for d in cursor.description], cursor.fetchall())


def test_number_pairs_of_large_ids(spark, tmp_path):
    events = [(0, 0), (1, 899), (2, 900), (3, 1499), (100_000, 89_999), (5_999_999, 987_901), (2**40, 2**33)]
    found, want = over_events(spark, tmp_path, events, "h9_number_pairs")
    assert found == want and len(found) == len(events)
