"""Report ETL: extraction from text and pages, validation, upserts, deltas, narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonepulse.functions import numbers, text
from zonepulse.operators import extract, keys, publish
from zonepulse.plans import tables
from zonepulse.plans.registry import Source, query

NOW, BEFORE = "2000-06-30", "2000-05-31"
HOST = "https://example.org"


# pages with links to documents: relative, absolute, encoded in a data attribute, and named in a script
_PAGE = r"""replace(replace(html, '">', '.pdf">'), 'href="/', 'href="/download/') || '<a href="https://x.org/download/' || page_id || '">' || '<div data-file="%2Fdownload%2Fa%20b+' || page_id || '"></div><script>f({file: "s/' || page_id % 7 || '.pdf", pdf: "mailto:x.pdf"})</script>'"""
_DOCUMENTS = f"""
p AS (SELECT page_id, {_PAGE} AS t FROM pages),
u AS (SELECT page_id, regexp_extract_all(t, '(?i)(https?://[^"''<>\\s)]+(?:\\.pdf|/download/)[^"''<>\\s)]*)', 1) AS absolute, regexp_extract_all(t, '(?i)((?:/?wp-content/|/?download/)[^"''<>\\s)]+\\.pdf[^"''<>\\s)]*)', 1) AS relative,
  list_transform(regexp_extract_all(t, '(?i)(?:file|src|pdf|source|url|href)\\s*[:=]\\s*["'']([^"'']+)["'']', 1), lambda x: url_decode(x)) AS named, list_transform(regexp_extract_all(t, '(?i)data-[a-z0-9_-]*\\s*=\\s*["'']([^"'']+)["'']', 1), lambda x: url_decode(x)) AS in_data FROM p),
l AS (SELECT page_id, absolute || list_transform(relative || list_filter(named || in_data, lambda x: contains(lower(x), '.pdf') OR contains(lower(x), '/download/')),
  lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x WHEN x LIKE '//%' THEN 'https:' || x WHEN x LIKE '/%' THEN 'https://example.org' || x ELSE 'https://example.org/r/' || x END) AS urls FROM u),
e AS (SELECT page_id, trim(regexp_replace(unnest(urls), '[ \\t\\x{{a0}}\\x{{202f}}]+', ' ', 'g'), '"'' ') AS url, unnest(range(len(urls))) AS pos FROM l)
SELECT page_id AS doc_id, CAST(min(pos) AS INT) AS pos, url FROM e WHERE url <> '' AND NOT regexp_matches(lower(url), '^(javascript|mailto|tel):') GROUP BY 1, 3"""


@query("zones", _DOCUMENTS)
def a9_urls(t: Source) -> DataFrame:
    return extract.urls(t.pages.select("page_id", F.expr(_PAGE).alias("t")), "page_id", "t", f"{HOST}/r/page.html").select("doc_id", "pos", "url")


@query("zones", "l AS (SELECT page_id AS pos, page_id % 97 AS n, 1 + page_id % 28 AS d, url || '/' || CASE page_id % 3 WHEN 0 THEN 'sitrep-n' || page_id % 97 WHEN 1 THEN 'a-' || page_id ELSE 'news-' || page_id END AS url, page_id % 3 AS k FROM pages) SELECT url, CAST(n AS INT) AS number, CASE WHEN k = 1 THEN make_date(2026, 6, CAST(d AS INT)) END AS date FROM l WHERE k < 2 ORDER BY n DESC, CASE WHEN k = 1 THEN d ELSE 0 END DESC, pos LIMIT 1")
def a8_latest_article(t: Source) -> DataFrame:
    k, n = F.col("page_id") % 3, (F.col("page_id") % 97).cast("string")
    day = (F.col("page_id") % 28 + 1).cast("string")
    said = F.when(k == 1, F.concat(F.lit("SitRep MVE N° 0"), n, F.lit(" du "), day, F.lit(" juin 2026"))).otherwise(F.concat(F.lit("News N"), n))
    url = F.concat("url", F.lit("/"), F.when(k == 0, F.concat(F.lit("sitrep-n"), n)).otherwise(F.concat(F.when(k == 1, "a-").otherwise("news-"), F.col("page_id").cast("string"))))
    return extract.latest_article(t.pages.select(F.col("page_id").alias("pos"), said.alias("text"), url.alias("url"))).select("url", "number", "date")


@query(None, "SELECT f AS folder, t AS template, e AS encoding, f || '/' || replace(replace(t, '{n}', '28'), ' ', s) AS url FROM (VALUES ('a'), ('b'), ('c')) AS x(f), (VALUES ('SitRep N{n}.pdf'), ('sitrep_{n}.pdf'), ('Sit Rep {n} final.pdf')) AS y(t), (VALUES ('plain', '-'), ('url', '%20')) AS z(e, s)")
def a10_candidates(t: Source) -> DataFrame:
    return extract.candidates(t.spark, 28, ["a", "b", "c"], ["SitRep N{n}.pdf", "sitrep_{n}.pdf", "Sit Rep {n} final.pdf"], {"plain": "-", "url": "%20"})


_SNAP = "concat(CAST(user_id AS STRING), ' confirmed cases and ', CAST(event_id % 40 AS STRING), ' deaths as of ', CAST(1 + event_id % 28 AS STRING), ' January 2024')"


@query("zones", f"s AS (SELECT event_id, {_SNAP.replace('AS STRING', 'AS VARCHAR')} AS t FROM events) SELECT event_id, make_date(2024, 1, CAST(regexp_extract(t, 'of (\\d+) Jan', 1) AS INT)) AS as_of, CAST(regexp_extract(t, '(\\d+) confirmed', 1) AS BIGINT) AS cases, CAST(regexp_extract(t, '(\\d+) deaths', 1) AS BIGINT) AS deaths FROM s")
def a14_snapshot(t: Source) -> DataFrame:
    rows = t.events.select("event_id", F.expr(_SNAP).alias("t"))
    return extract.snapshot(rows, "event_id", "t").select("event_id", "as_of", "cases", "deaths")


@query("cases", f"o AS (SELECT date, health_zone, confirmed_cases, NULL AS notes FROM cases WHERE date <= DATE '{NOW}'), n AS (SELECT date, health_zone, confirmed_cases + 1 AS confirmed_cases, 'new' AS notes FROM cases WHERE date BETWEEN DATE '{NOW}' AND DATE '2000-08-31') SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.date = o.date AND n.health_zone = o.health_zone) UNION ALL SELECT * FROM n")
def a15_upsert(t: Source) -> DataFrame:
    day = F.lit(NOW).cast("date")
    old = t.cases.where(F.col("date") <= day).select("date", "health_zone", "confirmed_cases")
    new = t.cases.where((F.col("date") >= day) & (F.col("date") <= F.lit("2000-08-31").cast("date"))).select("date", "health_zone", (F.col("confirmed_cases") + 1).alias("confirmed_cases"), F.lit("new").alias("notes"))
    return publish.upsert(old, new, ["date", "health_zone"]).orderBy("date", "health_zone")


@query("zones", "SELECT user_id AS k, max_by(value, event_id) AS value FROM events GROUP BY 1")
def a16_latest_wins(t: Source) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("k"), "value", F.col("event_id").alias("pos"))
    half = F.col("pos") < 4000
    return publish.latest_wins(rows.where(half), rows.where(~half), ["k"]).select("k", "value")


@query("flows", "SELECT month, origin_id, destination_id, CAST(round_even(CASE WHEN movement % 7 = 0 THEN 0 ELSE movement / 2.0 END, 0) AS BIGINT) AS movement FROM flows")
def a18_normalise_flows(t: Source) -> DataFrame:
    raw = t.flows.select("month", F.col("origin_id").alias("origin_hz_id"), F.col("destination_id").alias("destination_hz_id"), F.when(F.col("movement") % 7 == 0, "n/a").otherwise((F.col("movement") / 2).cast("string")).alias("estimated_movement"))
    return publish.normalise_flows(raw.withColumnRenamed("month", "date_month"))


@query("flows", "SELECT origin_id, replace(c, '_', '-') AS month, CAST(CASE WHEN v = 7.5 THEN 8 ELSE v END AS DOUBLE) AS movement FROM (SELECT origin_id, substr(month, 1, 4) || '_' || substr(month, 6, 2) AS c, CASE WHEN CAST(sum(movement) AS BIGINT) % 5 = 0 THEN 7.5 ELSE CAST(sum(movement) AS DOUBLE) END AS v FROM flows WHERE month IN ('2000-01', '2000-02', '2000-03') GROUP BY 1, 2)")
def a19_wide_to_long(t: Source) -> DataFrame:
    months = ["2000-01", "2000-02", "2000-03"]
    total = lambda m: F.sum(F.when(F.col("month") == m, F.col("movement")))
    wide = t.flows.groupBy("origin_id").agg(*[F.when(total(m) % 5 == 0, 7.5).otherwise(total(m).cast("double")).cast("string").alias("est_flows_" + m.replace("-", "_")) for m in months])
    return publish.wide_to_long(wide, ["origin_id"], "est_flows", "movement")


@query("population", "SELECT zone_id, '2001-01' AS month, CAST(population AS DOUBLE) AS population FROM population UNION ALL SELECT zone_id, '2001-02', CAST(population AS DOUBLE) + 1 FROM population WHERE population % 2 = 0")
def a20_population_long(t: Source) -> DataFrame:
    wide = t.population.select("zone_id", F.col("population").cast("string").alias("est_pop_2001_01"), F.when(F.col("population") % 2 == 0, (F.col("population") + 1).cast("string")).otherwise("").alias("est_pop_2001_02"))
    return publish.wide_to_long(wide, ["zone_id"], "est_pop", "population", redacted=None)


@query("zones", "SELECT zone_id, lat, lon, coalesce(lat BETWEEN -14 AND 6 AND lon BETWEEN 11 AND 32, false) AS plausible FROM (SELECT zone_id, CASE WHEN zone_id = '3' THEN NULL WHEN zone_id = '4' THEN 40 ELSE lat END AS lat, lon FROM zones)")
def b6_plausible(t: Source) -> DataFrame:
    lat = F.when(F.col("zone_id") == "3", None).when(F.col("zone_id") == "4", 40).otherwise(F.col("lat"))
    return t.zones.select("zone_id", lat.cast("double").alias("lat"), "lon").withColumn("plausible", text.plausible(F.col("lat"), F.col("lon")))




@query("zones", "SELECT p_partkey, p_partkey % 8 IN (0, 3, 4, 5, 7) AS unknown FROM part")
def b7_unknown_places(t: Source) -> DataFrame:
    """Names and ids together: a blank name with an id is a place, a known name with an unknown id is none."""
    names = F.element_at(F.array(*map(F.lit, ["Sans fiche", "Bunia", "", "ZS non identifiée", "Autres  ZS", "unknown zone", "Aru", ""])), (F.col("p_partkey") % 8 + 1).cast("int"))
    ids = F.element_at(F.array(*map(F.lit, ["z0", "z1", "z2", "z3", "z4", "z5", None, None])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", text.unknown_place(names, ids).alias("unknown"))


@query("zones", "SELECT event_id, coalesce(nullif(trim(CAST(props->>'x' AS VARCHAR)), ''), nullif(trim(CAST(props->>'k' AS VARCHAR)), '')) AS found FROM events")
def b8_property_coalesce(t: Source) -> DataFrame:
    from zonepulse.sources.tables import property_of

    rows = t.events.select("event_id", F.from_json("props", "map<string,string>").alias("properties"))
    return rows.select("event_id", property_of(["x", "k"]).alias("found"))


_GRIDS = [
    # header of two rows, of one, without a zone column, of three, without any, a case column in the first row and its zone in the third, one row only
    "array(array('Province / Zone de santé', 'Cas', 'Nouveaux cas', 'Décès', 'Nouveaux décès'), array('', 'confirmés', 'confirmés', 'confirmés', 'confirmés'), array('Bunia', '1', '2', '3', '4'))",
    "array(array('ZONE DE SANTE', 'Nbre confirmés', 'Deces parmi les confirmes'), array('Bunia', '3', '1'))",
    "array(array('Lieu', 'cas confirmés'), array('a', 'b'))",
    "array(array('Zone', 'Cumul', ''), array('de', 'de cas', 'Décès'), array('santé', 'confirmés', 'confirmés'), array('Aru', '5', '1'))",
    "array(array('Zone', 'confirmés'), array('a', 'b'))",
    "array(array('Zone', 'Cas confirmés'), array('de'), array('santé', ''))",
    "array(array('Zone de santé', 'Cas confirmés'))",
]
_COLUMNS = [(1, 2, 4, 2), (1, 2, 3, 1), (0, 2, 0, 2), (1, 2, 3, 3), (0, 0, 0, 0), (1, 2, 0, 3), (1, 2, 0, 1)]
_PICKED = ", ".join(f"CASE p_partkey % 7 {' '.join(f'WHEN {k} THEN {c[n]}' for k, c in enumerate(_COLUMNS))} END AS {name}" for n, name in enumerate(("zone", "cases", "deaths", "depth")))


@query("zones", f"SELECT p_partkey, {_PICKED} FROM part")
def b13_header_columns(t: Source) -> DataFrame:
    """Column positions in headers of one to three rows, the least depth that shows zone and cases."""
    grid = t.part.select("p_partkey", F.expr("CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {g}" for k, g in enumerate(_GRIDS)) + " END").alias("g"))
    return grid.select("p_partkey", extract.found_header(F.col("g")).alias("c")).select("p_partkey", "c.*")


@query("cases", f"a AS (SELECT health_zone, date FROM cases WHERE date = DATE '{NOW}'), b AS (SELECT health_zone FROM cases WHERE date = DATE '1995-02-28' AND confirmed_cases > 0) SELECT health_zone FROM a WHERE health_zone NOT IN (SELECT health_zone FROM b)")
def c8_anti_join(t: Source) -> DataFrame:
    a = t.cases.where(F.col("date") == F.lit(NOW).cast("date")).select("health_zone")
    b = t.cases.where((F.col("date") == F.lit("1995-02-28").cast("date")) & (F.col("confirmed_cases") > 0)).select(F.col("health_zone").alias("h"))
    return a.join(b, F.col("health_zone").eqNullSafe(F.col("h")), "left_anti")


@query(
    "zones",
    "names AS (SELECT DISTINCT regexp_extract(lower(strip_accents(text)), '[a-z]{5,}') AS name FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS name FROM documents) SELECT doc_id, name, count(*) AS n FROM w JOIN names USING (name) WHERE name <> '' GROUP BY ALL",
)
def c20_names_in_text(t: Source) -> DataFrame:
    """How often each document names a word of a dictionary, here the first long words of the benchmark items."""
    from zonepulse.operators.mentions import mentions

    first = F.regexp_extract(text.strip_accents(F.lower("text")), "[a-z]{5,}", 0)
    names = tables.base(t.spark, t.sf_dir, "benchmark").select(first.alias("name"))
    return mentions(t.documents, names, "doc_id", "text").groupBy(F.col("id").alias("doc_id"), "name").agg(F.count(F.lit(1)).alias("n"))


# names are nation_ and digits, the right ones with an x in places: 7 letters and what the ends share in order
_FUZZY = """
r AS (SELECT zone_id AS mid, province, lower(zone_name) || CASE WHEN CAST(zone_id AS INT) % 3 = 0 THEN 'x' ELSE '' END AS rn FROM zones),
p AS (SELECT z.zone_id AS id, mid, lower(z.zone_name) AS ln, rn, substr(z.zone_name, 8) AS a, substr(rn, 8) AS b FROM zones z JOIN r ON z.province = r.province),
m AS (SELECT id, mid, ln = rn AS same, 2.0 * (7 + CASE WHEN length(a) = 2 AND regexp_matches(b, a[1] || '.*' || a[2]) THEN 2 WHEN contains(b, a[1]) OR length(a) = 2 AND contains(b, a[2]) THEN 1 ELSE 0 END) / (length(ln) + length(rn)) AS score FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, mid) AS rn FROM m WHERE score >= 5.0 / 6)
SELECT zone_id AS id, mid AS match_id, CAST(round(score, 4) AS DOUBLE) AS score, CASE WHEN score IS NULL THEN 'unmatched' WHEN same THEN 'exact' ELSE 'fuzzy' END AS method FROM zones LEFT JOIN (SELECT * FROM k WHERE rn = 1) ON zone_id = id"""


@query("zones", _FUZZY)
def c19_fuzzy_match(t: Source) -> DataFrame:
    left = t.zones.select(F.col("zone_id").alias("id"), "province", "zone_name")
    right = left.withColumn("zone_name", F.concat("zone_name", F.when(F.col("id").cast("int") % 3 == 0, "x").otherwise("")))
    return keys.fuzzy_match(left, right, "province", "zone_name").withColumn("score", F.round("score", 4))


@query("zones", "p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Red Widgét' WHEN 1 THEN 'crimson' WHEN 2 THEN 'the red widget zone' WHEN 3 THEN 'total' ELSE 'a very long text with the red widget inside' END AS raw FROM part) SELECT p_partkey, raw, CASE WHEN p_partkey % 5 IN (0, 2) THEN 'red widget' WHEN p_partkey % 5 = 1 THEN 'red' END AS canonical FROM p")
def c20_canonical_names(t: Source) -> DataFrame:
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "Red Widgét").when(k == 1, "crimson").when(k == 2, "the red widget zone").when(k == 3, "total").otherwise("a very long text with the red widget inside")
    known = t.spark.sql("SELECT explode(array('red widget', 'red', 'blue bolt')) AS name")
    aliases = t.spark.sql("SELECT 'Crimson' AS alias, 'red' AS name")
    return keys.canonical_names(t.part.select("p_partkey", raw.alias("raw")), known, aliases, ["total", "provinces"])


@query("zones", "x AS (SELECT user_id % 40 AS zone, user_id AS cases, event_id AS pos, event_type AS note FROM events) SELECT zone, cases, pos, note FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY cases DESC, pos) AS rn FROM x) WHERE rn = 1")
def d18_max_dedupe(t: Source) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 40).alias("zone"), F.col("user_id").alias("cases"), F.col("event_id").alias("pos"), F.col("event_type").alias("note"))
    return extract.max_per_zone(rows, ["zone"], "cases", "pos")


_CHANGES = f"n AS (SELECT health_zone AS zone, confirmed_cases AS c FROM cases WHERE date = DATE '{NOW}'), p AS (SELECT health_zone AS zone, confirmed_cases AS c FROM cases WHERE date = DATE '{BEFORE}' AND health_zone <> 'NATION_2'), d AS (SELECT coalesce(n.zone, p.zone) AS zone, coalesce(p.c, 0) AS previous, coalesce(n.c, 0) AS latest, coalesce(n.c, 0) - coalesce(p.c, 0) AS change, coalesce(n.c, 0) > 0 AND coalesce(p.c, 0) <= 0 AS is_new FROM n FULL OUTER JOIN p USING (zone))"


def _changes(t: Source) -> DataFrame:
    at = lambda d: t.cases.where(F.col("date") == F.lit(d).cast("date")).select(F.col("health_zone").alias("zone"), F.col("confirmed_cases").alias("cases"))
    return publish.zone_changes(at(NOW), at(BEFORE).where("zone <> 'NATION_2'"))


@query("cases", _CHANGES + " SELECT zone, previous, latest, change, is_new FROM d")
def d19_zone_changes(t: Source) -> DataFrame:
    return _changes(t)


@query("cases", _CHANGES + " SELECT zone, change, latest FROM d WHERE change > 0 ORDER BY change DESC, zone LIMIT 8")
def f2_top_increases(t: Source) -> DataFrame:
    return _changes(t).where("change > 0").orderBy(F.desc("change"), "zone").limit(8).select("zone", "change", "latest")


# the last report, with and without the one before; responses and the neighbour are made from its numbers
_DELTA = _CHANGES + """,
l AS (SELECT *, row_number() OVER (ORDER BY number DESC) AS rn FROM reports), newest AS (SELECT * FROM l WHERE rn = 1), earlier AS (SELECT * FROM l WHERE rn = 2),
z AS (SELECT count(*) FILTER (WHERE previous > 0) AS previous_count, count(*) FILTER (WHERE latest > 0) AS latest_count, coalesce(string_agg('"' || zone || '"', ',' ORDER BY zone) FILTER (WHERE is_new), '') AS fresh, coalesce(string_agg(zone, '、' ORDER BY zone) FILTER (WHERE is_new), '') AS names FROM d),
i AS (SELECT coalesce(string_agg('{"zone":"' || zone || '","change":' || change || ',"latest":' || latest || '}', ',' ORDER BY change DESC, zone), '') AS up, coalesce(string_agg(zone || '+' || change, '、' ORDER BY change DESC, zone) FILTER (WHERE rn <= 4), '') AS four FROM (SELECT *, row_number() OVER (ORDER BY change DESC, zone) AS rn FROM d WHERE change > 0) WHERE rn <= 8)"""


def _delta(t: Source, first: bool) -> DataFrame:
    last = t.reports.orderBy(F.desc("number")).limit(2).select("number", "report_no", "date", F.col("cumulative").alias("cases"), "deaths")
    newest = last.agg(F.max("number").alias("top"))
    marked = last.crossJoin(F.broadcast(newest))
    now, before = marked.where("number = top").drop("number", "top"), marked.where("number < top").drop("number", "top")
    response = t.spark.sql("SELECT 0.93D AS contact_followup_rate, 0.9D AS alert_investigation_rate, 4L AS positive_samples, 34118L AS travellers_total, 0.972D AS poe_screening_coverage")
    earlier = t.spark.sql("SELECT 0.9D AS contact_followup_rate")
    neighbour = t.spark.sql("SELECT 19L AS cases, 2L AS deaths, 12L AS imported, 7L AS local, 0L AS new_last_day, 5L AS quiet_days, DATE '2024-01-20' AS last_increase")
    if first:
        before, response, earlier, neighbour = before.limit(0), response.limit(0), earlier.limit(0), neighbour.limit(0)
    return publish.delta(now, before, _changes(t), response, earlier, neighbour)


@query(
    "cases reports",
    _DELTA
    + """ SELECT 'second' AS kind, earlier.report_no AS from_report, newest.report_no AS to_report, '{"previous":' || earlier.cumulative || ',"latest":' || newest.cumulative || ',"change":' || newest.cumulative - earlier.cumulative || '}' AS cases, '{"previous":' || earlier.deaths || ',"latest":' || newest.deaths || ',"change":' || newest.deaths - earlier.deaths || '}' AS deaths,
  '{"previous_count":' || previous_count || ',"latest_count":' || latest_count || ',"new_zones":[' || fresh || '],"largest_increases":[' || up || ']}' AS health_zones,
  '{"contact_followup_rate_previous":0.9,"contact_followup_rate_latest":0.93,"alert_investigation_rate_latest":0.9,"positive_samples_latest":4,"travellers_total_latest":34118,"poe_screening_coverage_latest":0.972}' AS response,
  '{"cases":19,"deaths":2,"imported":12,"local":7,"new_last_day":0,"quiet_days":5,"last_increase":"2024-01-20"}' AS neighbour FROM newest, earlier, z, i
UNION ALL SELECT 'first', NULL, newest.report_no, '{"latest":' || newest.cumulative || '}', '{"latest":' || newest.deaths || '}', '{"latest_count":' || latest_count || ',"new_zones":[' || fresh || '],"largest_increases":[' || up || ']}', '{}', NULL FROM newest, z, i""",
)
def k11_delta_payload(t: Source) -> DataFrame:
    out = None
    for kind, first in (("second", False), ("first", True)):
        part = _delta(t, first).select(F.lit(kind).alias("kind"), "from_report", "to_report", *[F.to_json(c).alias(c) for c in ("cases", "deaths", "health_zones", "response", "neighbour")])
        out = part if out is None else out.unionByName(part)
    return out


@query("reports", "SELECT report_no, zones, unassigned, total, zones > 0 AND zones + unassigned = total AS accepted FROM (SELECT 'R' || (event_id % 50) AS report_no, CAST(sum(CASE WHEN event_type <> 'error' THEN user_id ELSE 0 END) AS BIGINT) AS zones, CAST(sum(CASE WHEN event_type = 'error' THEN user_id ELSE 0 END) AS BIGINT) AS unassigned, CAST(sum(user_id) + CASE WHEN (event_id % 50) % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS total FROM events GROUP BY event_id % 50)")
def d21_validation(t: Source) -> DataFrame:
    rows = t.events.select(F.concat(F.lit("R"), (F.col("event_id") % 50).cast("string")).alias("report_no"), (F.col("event_id") % 50).alias("n"), F.when(F.col("event_type") == "error", "unassigned").otherwise("zone").alias("kind"), F.col("user_id").alias("cases"))
    totals = rows.groupBy("report_no", "n").agg(F.sum("cases").alias("total")).select("report_no", (F.col("total") + F.when(F.col("n") % 7 == 0, 1).otherwise(0)).alias("total"))
    return publish.validated(rows, totals, "report_no", "cases")


@query("zones", "SELECT zone_id, lower(trim(regexp_replace('  ' || zone_name || '   X ', '\\s+', ' ', 'g'))) AS key FROM zones")
def h1_normalise_names(t: Source) -> DataFrame:
    return t.zones.select("zone_id", text.norm_name(F.concat(F.lit("  "), "zone_name", F.lit("   X "))).alias("key"))


@query("zones", "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\x{a0}\\x{202f}]+', ' ', 'g'), ' ') AS clean FROM documents")
def h2_normalise_text(t: Source) -> DataFrame:
    return t.documents.select("doc_id", text.norm_spaces(F.col("text")).alias("clean"))


@query("zones", f"SELECT conv_id, turn, translate(text, '{text._ACCENTED}', '{text._PLAIN}') AS plain FROM conversations")  # noqa: SLF001
def h3_strip_accents(t: Source) -> DataFrame:
    """Every row; characters outside the table pass through."""
    return t.conversations.select("conv_id", "turn", text.strip_accents(F.col("text")).alias("plain"))


@query("zones", "SELECT r_name, CASE r_regionkey % 3 WHEN 0 THEN 'nord-kivu' WHEN 1 THEN 'sud-kivu' ELSE lower(r_name) END AS key FROM region")
def h4_province_alias(t: Source) -> DataFrame:
    k = F.col("r_regionkey") % 3
    return t.region.select("r_name", text.province_key(F.when(k == 0, "North  Kivu").when(k == 1, "south kivu ").otherwise(F.col("r_name"))).alias("key"))


@query("reports", "SELECT number, CAST(number AS INT) AS found FROM reports")
def h5_report_numbers(t: Source) -> DataFrame:
    n = F.col("number").cast("string")
    k = F.col("number") % 4
    raw = F.when(k == 0, F.concat(F.lit("SitRep MVE N° 0"), n, F.lit(" du jour"))).when(k == 1, F.concat(F.lit("sitrep-n"), n)).when(k == 2, F.concat(F.lit("N° "), n, F.lit(" / MVB"))).otherwise(F.concat(F.lit("No"), n))
    return t.reports.select("number", text.report_number(raw).alias("found"))


def _french(orders: DataFrame) -> DataFrame:
    days = orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    months = F.array(*[F.lit(m) for m in ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]])
    worded = F.concat_ws(" ", F.lit("le"), F.day("date").cast("string"), F.element_at(months, F.month("date")), F.year("date").cast("string"))
    return days.select("date", text.french_date(F.date_format("date", "d/MM/yyyy")).alias("slashed"), text.french_date(worded).alias("worded"))


@query("zones", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2099 THEN CAST(o_orderdate AS DATE) END AS slashed, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2099 THEN CAST(o_orderdate AS DATE) END AS worded FROM orders")
def h6_french_dates(t: Source) -> DataFrame:
    """Every order date; null where the form, with years 20yy, does not match."""
    return _french(t.orders)


def _english(orders: DataFrame) -> DataFrame:
    days = orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", text.english_date(F.concat(F.lit("as of "), F.date_format("date", "d MMMM yyyy"))).alias("long_form"), text.chart_date(F.date_format("date", "d-MMM-yy")).alias("chart"))


@query("zones", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2099 THEN CAST(o_orderdate AS DATE) END AS long_form, make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) AS chart FROM orders")
def h7_english_dates(t: Source) -> DataFrame:
    """Every order date; null where a form does not match, chart years are 20yy."""
    return _english(t.orders)


_SHEET = "concat('Zone: ', c_name, '\n', 'Cases: ', CAST(c_custkey AS STRING), '\n', CAST(c_nationkey AS STRING), ' imported and ', CAST(c_custkey % 9 AS STRING), ' local')"


@query("zones", "SELECT c_custkey, c_name AS zone, c_custkey AS cases, CAST(c_nationkey AS BIGINT) AS imported, c_custkey % 9 AS local FROM customer")
def h8_h9_labelled_values(t: Source) -> DataFrame:
    s = F.expr(_SHEET.replace("\n", "\\n"))
    return t.customer.select("c_custkey", text.line_after(s, "Zone").alias("zone"), text.number_after(s, "Cases").alias("cases"), text.number_before(s, "imported").alias("imported"), text.number_before(s, "local").alias("local"))


_BULLETIN = "concat(CAST(1000 + user_id AS STRING), ' Imported Cases ', CAST(event_id AS STRING), ' Local cases; ', format_number(12100 + user_id, 0), ' total persons tested')"


@query("zones", "SELECT event_id, CAST(1000 + user_id AS BIGINT) AS imported, CAST(event_id AS BIGINT) AS local, CAST(12100 + user_id AS BIGINT) AS tested FROM events")
def h9_number_pairs(t: Source) -> DataFrame:
    s = F.expr(_BULLETIN)
    imported, local = text.number_pair(s, "imported cases", "local cases")
    return t.events.select("event_id", imported.alias("imported"), local.alias("local"), text.number_before(s, "total persons tested").alias("tested"))


# report texts of ten forms, k their number of cases and d of deaths; a day of June stands where it must not be read
_TOTALS = [
    ("'Ituri 9 9 1,0% Total {k} {d} 12,5%  le cumul des cas confirmés s’élève à 7 cas'", "k", "d"),
    ("'Ituri (' || {k} || ' cas), Nord-Kivu (2 cas) et Sud Kivu (3 cas). Cumul de décès est ' || {d}", "k + 5", "d"),
    ("'Ainsi, le cumul des cas confirmés s’élève à ' || {k} || ' cas au 08 juin 2026'", "k", None),
    ("'Ainsi le cumul  des cas confirmés du 08 juin 2026\\npasse à ' || {k} || ' cas dont ' || {d} || ' décès confirmés'", "k", "d"),
    ("'CUMUL CAS CONFIRMES : ' || {k} || ' ; ' || {d} || ' (12,5%) Taux de suivi'", "k", "d"),
    ("{k} || ' cumul cas confirmés. Cumul des décès parmi les confirmés du jour : ' || {d} || ' (3%)'", "k", "d"),
    ("'On note ' || {k} || ' cas confirmés dont 3 guéris, cumul décès parmi les confirmés ' || {d} || ' (1%)'", "k", "d"),
    ("'Cumul de cas confirmés 08 juin 2026 : ' || {k} || ' cas'", None, None),
    ("'le cumul des cas confirmés est de 99999 cas ; cumul cas confirmés ' || {k}", "k", None),
    ("CAST(NULL AS {string})", None, None),
]


def _totals_text(string: str) -> str:
    k, d = f"CAST(1 + k % 9000 AS {string})", f"CAST(d AS {string})"
    forms = []
    for n, (form, _, _) in enumerate(_TOTALS):
        said = form.replace("{k} {d}", "' || {k} || ' ' || {d} || '").format(k=k, d=d, string=string)
        forms.append(f"WHEN {n} THEN {said}")
    return "CASE k % 10 " + " ".join(forms) + " END"


def _totals_sql() -> str:
    value = lambda column: "CASE k % 10 " + " ".join(f"WHEN {n} THEN {(form[column] or 'NULL').replace('k', '(1 + k % 9000)')}" for n, form in enumerate(_TOTALS)) + " END"
    return f"SELECT k AS c_custkey, CAST({value(1)} AS BIGINT) AS cases, CAST({value(2)} AS BIGINT) AS deaths FROM (SELECT c_custkey AS k, c_custkey % 30 AS d FROM customer)"


@query("zones", _totals_sql())
def h10_national_totals(t: Source) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_custkey").alias("k"), (F.col("c_custkey") % 30).alias("d"))
    said = F.expr(_totals_text("STRING"))
    return rows.select("c_custkey", extract.national_cases(said).alias("cases"), extract.national_deaths(said).alias("deaths"))


@query("reports", "SELECT k AS doc_id, CAST(pos AS INT) AS pos, 'd' || pos AS label, k * 10 + pos AS value FROM (SELECT n_nationkey AS k, unnest(range(3 + n_nationkey % 4)) AS pos FROM nation)")
def h11_chart_series(t: Source) -> DataFrame:
    size = 3 + F.col("n_nationkey") % 4
    labels = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat(F.lit("'d"), i.cast("string"), F.lit("'"))), ", ")
    data = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: (F.col("n_nationkey") * 10 + i).cast("string")), ", ")
    script = F.concat(F.lit("new Chart({labels: ['a', 'b'], data: [1, 2]}); new Chart({labels: ["), labels, F.lit("], data: ["), data, F.lit("]}); x = {labels: [1], data: [1, 2]};"))
    return extract.chart_series(t.nation.select("n_nationkey", script.alias("script")), "n_nationkey", "script").select("doc_id", F.col("pos").cast("int").alias("pos"), "label", F.col("value").cast("long").alias("value"))


@query("zones", "SELECT event_id, CAST(ts AS DATE) + 7 AS later, CAST(ts AS DATE) - 10 AS earlier, CAST(CAST(ts AS DATE) - DATE '2024-01-05' AS INT) AS days FROM events")
def h12_day_arithmetic(t: Source) -> DataFrame:
    d = F.to_date("ts")
    return t.events.select("event_id", F.date_add(d, 7).alias("later"), F.date_sub(d, 10).alias("earlier"), F.datediff(d, F.lit("2024-01-05").cast("date")).alias("days"))


@query("zones", "SELECT p_partkey, round(ln(1 + p_retailprice), 4) AS logged, round(sqrt(p_retailprice), 4) AS root, CAST(floor(p_size / 2.0 + 0.5) AS BIGINT) AS half_up, CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS half_even, CAST(least(30, greatest(10, p_size)) AS DOUBLE) AS clamped FROM part")
def h13_rounding(t: Source) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.log1p("p_retailprice"), 4).alias("logged"), F.round(F.sqrt("p_retailprice"), 4).alias("root"), numbers.half_up(F.col("p_size") / 2).alias("half_up"), numbers.half_even(F.col("p_size") / 2).alias("half_even"), numbers.clamp(F.col("p_size").cast("double"), 10.0, 30.0).alias("clamped"))


_GROUPED = "format('{:,}', CAST(n AS BIGINT))"
_TENTHS = "CAST(floor(p * 10 + 0.5) AS BIGINT)"
_SHARE = f"CAST({_TENTHS} // 10 AS VARCHAR) || '{{0}}' || CAST({_TENTHS} % 10 AS VARCHAR)"


@query(
    "reports",
    "f AS (SELECT report_no, CASE number WHEN 1 THEN 1 ELSE cumulative * 37 END AS n, deaths * 100.0 / greatest(cumulative, 1) AS p, date FROM reports) SELECT report_no, "
    + f"{_GROUPED} || CASE n WHEN 1 THEN ' case' ELSE ' cases' END AS en_cases, {_GROUPED} || CASE n WHEN 1 THEN ' death' ELSE ' deaths' END AS en_deaths, replace({_GROUPED}, ',', chr(8239)) || ' cas' AS fr_cases, replace({_GROUPED}, ',', chr(8239)) || ' décès' AS fr_deaths, {_GROUPED} || '例' AS ja_cases, "
    + f"{_SHARE.format('.')} || '%' AS en_percent, {_SHARE.format(',')} || chr(8239) || '%' AS fr_percent, {_SHARE.format('.')} || '%' AS ja_percent, strftime(date, '%d/%m/%Y') AS day FROM f",
)
def h18_formats(t: Source) -> DataFrame:
    n = F.when(F.col("number") == 1, F.lit(1)).otherwise(F.col("cumulative") * 37)
    share = F.col("deaths") / F.greatest("cumulative", F.lit(1))
    said = [text.counted(n, unit, lang).alias(f"{lang}_{unit}") for lang, unit in (("en", "cases"), ("en", "deaths"), ("fr", "cases"), ("fr", "deaths"), ("ja", "cases"))]
    return t.reports.select("report_no", *said, *[text.percent(share, lang).alias(f"{lang}_percent") for lang in ("en", "fr", "ja")], F.date_format("date", "dd/MM/yyyy").alias("day"))


@query("reports", "SELECT report_no, CASE number % 3 WHEN 0 THEN cumulative || '例（死亡' || deaths || '例）' WHEN 1 THEN 'a ' || cumulative || '例, ' || deaths || '例' ELSE 'soit ' || cumulative || '例 et ' || deaths || '例' END AS rewritten FROM reports")
def h19_unit_rewriting(t: Source) -> DataFrame:
    n, d, k = F.col("cumulative").cast("string"), F.col("deaths").cast("string"), F.col("number") % 3
    raw = F.when(k == 0, F.concat(n, F.lit(" cases (deaths "), d, F.lit(" cases)"))).when(k == 1, F.concat(F.lit("a "), n, F.lit(" confirmed cases, "), d, F.lit(" deaths"))).otherwise(F.concat(F.lit("soit "), n, F.lit(" cas et "), d, F.lit(" décès")))
    return t.reports.select("report_no", text.units_rewritten(raw).alias("rewritten"))


@query("zones", """SELECT event_id, CAST(props->>'k' AS INT) AS k, '{"event":' || event_id || ',"k":' || CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS VARCHAR) ELSE props->>'k' END || CASE WHEN event_id % 3 = 0 THEN ',"notes":"late"' ELSE '' END || '}' AS merged FROM events""")
def h20_json(t: Source) -> DataFrame:
    """A field read, and a document merged over another: stated fields win, null ones leave the other's."""
    k = F.get_json_object("props", "$.k").cast("int")
    late = F.col("event_id") % 3 == 0
    over = F.to_json(F.struct(F.when(late, F.col("event_id") % 7).cast("int").alias("k"), F.when(late, "late").alias("notes")))
    own = F.to_json(F.struct(F.col("event_id").alias("event"), k.alias("k")))
    return t.events.select("event_id", k.alias("k"), publish.merged_json(own, over, "event long, k int, notes string").alias("merged"))


@query(
    "zones",
    """d AS (SELECT event_id, CAST(props AS JSON) AS p, CAST('{"seen": ' || event_id || CASE WHEN event_id % 2 = 0 THEN ', "k": "late"' ELSE ', "k": null' END || CASE WHEN event_id % 5 = 0 THEN ', "f' || event_id % 7 || '": [1, 2]' ELSE '' END || '}' AS JSON) AS o FROM events),
k AS (SELECT event_id, p, o, unnest(list_distinct(json_keys(p) || json_keys(o))) AS key FROM d)
SELECT event_id, key, CASE WHEN json_type(o->key) IS NULL OR json_type(o->key) = 'NULL' THEN json_extract_string(p, key) ELSE json_extract_string(o, key) END AS value FROM k""",
)
def h20_unknown_fields(t: Source) -> DataFrame:
    """Documents whose fields nobody declared, one over another: stated fields win, null ones leave the other's."""
    over = F.expr("concat('{\"seen\": ', event_id, CASE WHEN event_id % 2 = 0 THEN ', \"k\": \"late\"' ELSE ', \"k\": null' END, CASE WHEN event_id % 5 = 0 THEN concat(', \"f', event_id % 7, '\": [1, 2]') ELSE '' END, '}')")
    return publish.merged_fields(t.events.select("event_id", "props", over.alias("over")), "event_id", "props", "over")


@query("reports", "z AS (SELECT n_regionkey AS doc_id, n_name AS zone, 'zone' AS kind, CAST(n_nationkey * 3 AS BIGINT) AS cases, CAST(n_nationkey AS BIGINT) AS deaths FROM nation) SELECT * FROM z UNION ALL SELECT doc_id, 'Sous total', 'total', CAST(sum(cases) AS BIGINT), CAST(sum(deaths) AS BIGINT) FROM z GROUP BY 1 UNION ALL SELECT DISTINCT doc_id, 'Autres ZS', 'unassigned', 4, CAST(NULL AS BIGINT) FROM z")
def h21_vertical_table(t: Source) -> DataFrame:
    n = t.nation.withColumn("c", F.col("n_nationkey") * 3)
    cell = F.concat_ws("\n", "n_name", F.col("c").cast("string"), F.col("n_nationkey").cast("string"), F.lit("33,3%"))
    body = F.array_join(F.array_sort(F.collect_list(cell)), "\n")
    page = n.groupBy("n_regionkey").agg(F.concat_ws("\n", F.lit("Tableau 1"), body, F.lit("Sous total"), F.sum("c").cast("string"), F.sum("n_nationkey").cast("string"), F.lit("Autres ZS"), F.lit("4")).alias("text"))
    return extract.vertical_table(extract.lines(page, "n_regionkey", "text"), n.select(F.col("n_name").alias("name")))


@query("reports", "SELECT r_regionkey AS doc_id, 'Zone' AS name, CAST(k AS INT) AS n FROM region, generate_series(1, 3) AS s(k)")
def h22_prose_counts(t: Source) -> DataFrame:
    page = t.region.select("r_regionkey", F.lit("Touchées : Zone (1), Zone (2) et Zone ( 3 ).").alias("text"))
    return extract.prose_counts(page, "r_regionkey", "text")


@query(
    "reports",
    "SELECT number, CAST(round((20 + number) / 100.0 + 0.004, 4) AS DOUBLE) AS contact_followup_rate, number * 10 AS alerts_reported, number * 9 AS alerts_investigated, CAST(0.9 AS DOUBLE) AS alert_investigation_rate, CASE WHEN number % 2 = 0 THEN number + 50 END AS samples_received, CASE WHEN number % 2 = 0 THEN number + 40 ELSE number + 7 END AS samples_analysed, CASE WHEN number % 2 = 0 THEN 3 ELSE 2 END AS positive_samples, 34000 + number AS travellers_total, 33000 + number AS travellers_screened, CAST(CASE WHEN number % 3 = 0 THEN 0.972 ELSE round((33000 + number) / (34000.0 + number), 4) END AS DOUBLE) AS poe_screening_coverage FROM reports",
)
def h23_response_fields(t: Source) -> DataFrame:
    n = F.col("number")
    s = lambda c: c.cast("string")
    table = F.concat(F.lit("Échantillons reçus "), s(n + 50), F.lit("; Nbre d’échantillons analysés "), s(n + 40), F.lit("; Nbre des cas positifs 3. "))
    daily = F.concat(s(n + 7), F.lit(" nouveaux échantillons ont été analysés dont 2 sont revenus positifs. "))
    screened = F.concat(F.lit(" Voyageurs screenés 33 "), F.lpad(s(n), 3, "0"), F.when(n % 3 == 0, F.lit(" (97,2%)")).otherwise(F.lit(".")))
    prose = F.concat(
        F.lit("Taux de suivi : 11,1%. Taux de suivi : "), s(20 + n), F.lit(",4%3 hier. Pour la journée du 8 juin, "), s(n * 10), F.lit(" alertes ont été notifiées\ndont "), s(n * 9), F.lit(" (90,0 %) investiguées. "),
        F.when(n % 2 == 0, table).otherwise(daily), F.lit("Voyageurs passés par le PoE/PoC 34 "), F.lpad(s(n), 3, "0"), F.lit(";"), screened,
    )
    rows = t.reports.select("number", extract.response_fields(prose).alias("f"))
    rates = ("contact_followup_rate", "alert_investigation_rate", "poe_screening_coverage")
    counts = ("alerts_reported", "alerts_investigated", "samples_received", "samples_analysed", "positive_samples", "travellers_total", "travellers_screened")
    return rows.select("number", *[F.round(f"f.{c}", 4).alias(c) for c in rates], *[f"f.{c}" for c in counts])


@query("zones", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 300) || chr(10) || '[...]' || chr(10) || right(text, 100) END AS compacted FROM documents")
def h24_compaction(t: Source) -> DataFrame:
    return t.documents.select("doc_id", text.compact(F.col("text"), 400).alias("compacted"))


_FR_INPUT = ["34 118", "1.234", "97,2%", "ND", "28,4%3", "-", "", "1,234", "12"]
_FR_INT = ["34118", "1234", "97", "NULL", "28", "NULL", "NULL", "1", "12"]
_FR_FLOAT = ["34118", "1.234", "0.972", "NULL", "0.284", "NULL", "NULL", "1.234", "12"]


@query("zones", "SELECT p_partkey, CAST(CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_FR_INT)) + " END AS BIGINT) AS whole, CAST(CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_FR_FLOAT)) + " END AS DOUBLE) AS decimal, CAST(CASE p_partkey % 9 WHEN 1 THEN 1.234 WHEN 8 THEN 12 ELSE 0 END AS DOUBLE) AS number FROM part")
def h0_number_coercion(t: Source) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _FR_INPUT)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t.part.select("p_partkey", numbers.fr_int(raw).alias("whole"), F.round(numbers.fr_float(raw), 6).alias("decimal"), numbers.to_number(raw).alias("number"))


_LAGGED = "l AS (SELECT report_no, date, cumulative, deaths, cumulative - lag(cumulative) OVER (ORDER BY date) AS c, deaths - lag(deaths) OVER (ORDER BY date) AS d FROM reports)"
_SAY = "CASE WHEN {0} > 0 THEN '+' || {0} || ' {1}' WHEN {0} < 0 THEN {0} || ' {1}' ELSE 'no change in {1}' END"
_SIGN = "CASE WHEN {0} > 0 THEN '+' ELSE '' END || {0}"


@query("reports", _LAGGED + f" SELECT report_no, 'Report ' || report_no || ' : ' || cumulative || ' cases, ' || deaths || ' deaths' || CASE WHEN c IS NULL THEN '.' ELSE ' (' || {_SAY.format('c', 'cases')} || '; ' || {_SAY.format('d', 'deaths')} || ').' END AS en, 'Rapport ' || report_no || ' : ' || cumulative || ' cas, ' || deaths || ' décès' || CASE WHEN c IS NULL THEN '.' ELSE ' (' || {_SIGN.format('c')} || ' cas ; ' || {_SIGN.format('d')} || ' décès).' END AS fr FROM l")
def k10_delta_narrative(t: Source) -> DataFrame:
    w = W.orderBy("date")
    rows = t.reports.withColumn("c", F.col("cumulative") - F.lag("cumulative").over(w)).withColumn("d", F.col("deaths") - F.lag("deaths").over(w))
    say = lambda lang: publish.narrative(F.col("report_no"), F.col("cumulative"), F.col("deaths"), F.col("c"), F.col("d"), lang)
    return rows.select("report_no", say("en").alias("en"), say("fr").alias("fr"))


_FRESH = "CASE WHEN names <> '' THEN '新規：' || names || '（計' || latest_count || '区域）。' ELSE '新規区域なし。' END || CASE WHEN four <> '' THEN '増加：' || four || '。' ELSE '' END"


@query(
    "cases reports",
    _DELTA
    + f""" SELECT 'second' AS kind, earlier.report_no || 'から' || newest.report_no || 'まで：確定例' || earlier.cumulative || '例→' || newest.cumulative || '例（' || newest.cumulative - earlier.cumulative || '例増）、死亡' || earlier.deaths || '例→' || newest.deaths || '例（' || newest.deaths - earlier.deaths || '例増）。' || {_FRESH} || '追跡率90.0%→93.0%。警報調査率90.0%、陽性4件。通過34,118人、検査率97.2%。' AS local,
  '確定例19例、死亡2例（輸入12、国内7）。24時間の新規0例。2024-01-20以後5日間増加なし。' AS neighbour FROM newest, earlier, z, i
UNION ALL SELECT 'first', newest.report_no || '：確定例' || newest.cumulative || '例、死亡' || newest.deaths || '例。' || {_FRESH}, NULL FROM newest, z, i""",
)
def k12_deterministic_narrative(t: Source) -> DataFrame:
    out = None
    for kind, first in (("second", False), ("first", True)):
        part = publish.summary(_delta(t, first)).select(F.lit(kind).alias("kind"), "local", "neighbour")
        out = part if out is None else out.unionByName(part)
    return out
