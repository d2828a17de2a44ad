"""Facts from report text and web pages, as line tables and SQL patterns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonepulse.functions import phrases
from zonepulse.functions.numbers import fr_float, fr_int
from zonepulse.functions.text import english_date, french_date, norm_name, norm_spaces, number_before, number_pair, plain_words, report_number, strip_accents

#: Labels of rows without a zone, and of rows that end a zone. Fixed values.
UNASSIGNED = r"(?i)autres\s+zs|sans\s+fiche|non\s+ventil"
CLOSING = r"(?i)^\s*(sous[ -]?total|total)\b"
#: How reports say the national numbers of cases and of deaths, in plain words and in the order in which they are asked. Fixed values.
TOTAL_ROW = "total #5 #5 %"
PROVINCE_ROW = "ituri ( # cas ) ... nord kivu ( # cas ) ... sud kivu ( # cas )"
CASES = ["cumul des cas confirme s'eleve a # cas", "le cumul des cas confirme ... # cas", "cumul cas confirme : #", "# cumul cas confirme", "# cas confirme dont"]
DEATHS = ["cumul [ de ] deces parmi les confirme ...80 # _", "cumul [ des ] deces parmi les confirme ...80 # _", "# ( % ) taux de suivi", "cumul de deces est #", "# deces confirme"]


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) of every line, also blank ones; null texts have none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def vertical_table(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, zone, kind, cases, deaths) from tables rendered one cell to a line.

    A zone line opens a group; its first two integers that are no percentages are
    cases and deaths; the next zone, subtotal or total ends it. Windows are per
    document and ordered by line, so documents spread over tasks.
    """
    names = zones.select(strip_accents(norm_name(F.col("name"))).alias("__key"), F.col("name").alias("__zone")).where("__key <> ''").dropDuplicates(["__key"])
    text = norm_spaces(F.col("line"))
    typed = rows.withColumn("__key", strip_accents(norm_name(F.col("line")))).join(names, "__key", "left")
    kind = F.when(F.col("__zone").isNotNull(), "zone").when(F.col("line").rlike(UNASSIGNED), "unassigned").when(F.col("line").rlike(CLOSING), "total")
    typed = typed.withColumn("kind", kind).withColumn("__n", F.when(F.col("kind").isNull() & ~F.contains(text, F.lit("%")) & text.rlike(r"^-?[0-9][0-9 .,]*$"), fr_int(F.col("line"))))
    order = W.partitionBy("doc_id").orderBy("line_no")
    grouped = typed.withColumn("__g", F.count("kind").over(order)).where("__g > 0")
    heads = grouped.where("kind is not null").select("doc_id", "__g", F.coalesce("__zone", F.trim("line")).alias("zone"), "kind")
    numbers = grouped.where("__n is not null").withColumn("__rn", F.row_number().over(W.partitionBy("doc_id", "__g").orderBy("line_no"))).where("__rn <= 2")
    cells = numbers.groupBy("doc_id", "__g").agg(F.max(F.when(F.col("__rn") == 1, F.col("__n"))).alias("cases"), F.max(F.when(F.col("__rn") == 2, F.col("__n"))).alias("deaths"))
    return heads.join(cells, ["doc_id", "__g"]).select("doc_id", "zone", "kind", "cases", "deaths")


def max_per_zone(rows: DataFrame, keys: list[str], value: str, pos: str | None = None) -> DataFrame:
    """The row with the largest value of each key; of equal ones the first by ``pos``, or without it the smallest by the other columns.

    Rows without a value lose to all others.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(value).isNull(), -F.col(value), *([pos] if pos else rest))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def prose_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, name, n) of every ``Name (n)``."""
    form = r"([A-ZÀ-Ý][\p{L}'-]+)\s*\(\s*([0-9]{1,5})\s*\)"
    found = docs.select(F.col(id_col).alias("doc_id"), F.arrays_zip(F.regexp_extract_all(text_col, F.lit(form), F.lit(1)).alias("name"), F.regexp_extract_all(text_col, F.lit(form), F.lit(2)).alias("n")).alias("x"))
    return found.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.name", F.col("x.n").cast("int").alias("n"))


def _plausible(found: list[Column], least: int, most: int) -> Column:
    """The first number from ``least`` to below ``most``."""
    whole = [x.try_cast("long") for x in found]
    return F.coalesce(*[F.when((n >= least) & (n < most), n) for n in whole])


def national_cases(text: Column, most: int = 10_000) -> Column:
    """Confirmed cases of a report: the table's total, else the sum of the three provinces, else the prose."""
    # a province's name is written with a dash or a space
    words = plain_words(text)
    row = F.replace(words, F.lit("-"), F.lit(" "))
    parts = [phrases.said(row, PROVINCE_ROW, k).try_cast("long") for k in (1, 2, 3)]
    return F.coalesce(phrases.said(words, TOTAL_ROW).try_cast("long"), parts[0] + parts[1] + parts[2], _plausible(phrases.first_of(words, CASES), 1, most))


def national_deaths(text: Column, most: int = 10_000) -> Column:
    """Confirmed deaths of a report: the table's total, else the prose."""
    words = plain_words(text)
    return F.coalesce(phrases.said(words, TOTAL_ROW, 2).try_cast("long"), _plausible(phrases.first_of(words, DEATHS), 0, most))


def snapshot(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, as_of, cases, deaths, imported, local) of a country page's text, one typed row a page.

    A page without its date, cases or deaths is an error, which the job raises.
    """
    page = F.col(text_col)
    needed = lambda value, name: F.coalesce(value, F.raise_error(F.concat(F.lit(f"a page lacks its {name}: "), F.col(id_col).cast("string"))))
    imported, local = number_pair(page, "imported cases", "local cases")
    as_of = needed(english_date(page), "date")
    return pages.select(id_col, as_of.alias("as_of"), needed(number_before(page, "confirmed cases"), "cases").alias("cases"), needed(number_before(page, "deaths"), "deaths").alias("deaths"), imported.alias("imported"), local.alias("local"))


def header_columns(header: Column) -> Column:
    """Column positions of a zone table from its header cells (rows joined per column), 0 if absent.

    The zone column names zone and health; the case column confirmed and a count, but
    not new or deaths; the death column deaths and confirmed, but not new. Of several
    the last counts.
    """
    key = lambda x: strip_accents(norm_name(x))
    held = lambda x, *words: key(x).rlike("".join(f"(?=.*{w})" for w in words))
    last = lambda test: F.coalesce(F.array_max(F.transform(header, lambda x, k: F.when(test(x), k + 1).otherwise(0))), F.lit(0))
    zone = last(lambda x: held(x, "zone", "sante"))
    case = last(lambda x: held(x, "confirm", "(?:cumul|nbre|nombre|cas)") & ~held(x, "(?:deces|nouveaux)"))
    death = last(lambda x: held(x, "confirm", "deces") & ~held(x, "nouveaux"))
    return F.struct(zone.alias("zone"), case.alias("cases"), death.alias("deaths"))


def stacked_header(grid: Column, depth: int) -> Column:
    """Cells of the first ``depth`` rows joined per column."""
    top = F.slice(grid, 1, depth)
    width = F.array_max(F.transform(top, lambda r: F.size(r)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.array_join(F.transform(top, lambda r: F.coalesce(F.try_element_at(r, k + 1), F.lit(""))), " "))


def found_header(grid: Column, deepest: int = 3) -> Column:
    """Columns of a table whose header has any depth up to ``deepest``: zone, cases, deaths and the depth.

    The least depth with a zone and a case column counts; without one the greatest depth
    with a case column; else all are 0. Depths beyond the table's rows are not asked.
    """
    asked = [F.when(F.size(grid) >= depth, header_columns(stacked_header(grid, depth)).withField("depth", F.lit(depth))) for depth in range(1, deepest + 1)]
    both = [F.when((c["zone"] > 0) & (c["cases"] > 0), c) for c in asked]
    part = [F.when(c["cases"] > 0, c) for c in reversed(asked)]
    return F.coalesce(*both, *part, F.struct(*[F.lit(0).alias(n) for n in ("zone", "cases", "deaths", "depth")]))


#: How reports say their response indicators, in plain words. Fixed values.
RATES = ["taux de suivi de contact : %", "taux de suivi : %", "contact suivi ... taux de suivi ...80 %"]
ALERTS = "pour la journee du ... , ## alerte ... dont ## ( % ) investiguee"
SAMPLES = "## nouveau echantillon ...80 analyse ...80 ## [ sont ] revenu positif"
RECEIVED, ANALYSED, POSITIVE = "echantillon recu ##", "d'echantillon analyse ##", "cas positif ##"
PASSED, SCREENED = "voyageur passe par le poe/poc ##", "voyageur screene ## [ ( % ) ]"


def response_fields(text: Column) -> Column:
    """Response indicators of a report's text; what the text lacks is null.

    Rates are shares of 1; of several follow-up rates the last of the last form counts.
    The day's statement on samples goes before the table's. The screening rate is the
    stated one, else screened by passed.
    """
    words = plain_words(text)
    whole = lambda phrase, k=1: fr_int(phrases.said(words, phrase, k))
    share = lambda phrase, k=1: fr_float(F.concat(phrases.said(words, phrase, k), F.lit("%")))
    rates = F.transform(phrases.every(words, RATES), lambda x: fr_float(F.concat(x, F.lit("%"))))
    rates = F.filter(rates, lambda x: x.between(0, 1))
    daily = F.coalesce(words.rlike(phrases.pattern(SAMPLES)), F.lit(False))
    some = lambda c: F.nullif(c, F.lit(0))  # noqa: E731  a count of 0 stays blank
    total, screened = some(whole(PASSED)), some(whole(SCREENED))
    return F.struct(
        F.try_element_at(rates, F.lit(-1)).alias("contact_followup_rate"),
        whole(ALERTS).alias("alerts_reported"),
        whole(ALERTS, 2).alias("alerts_investigated"),
        share(ALERTS, 3).alias("alert_investigation_rate"),
        F.when(~daily, some(whole(RECEIVED))).alias("samples_received"),
        F.when(daily, some(whole(SAMPLES))).otherwise(some(whole(ANALYSED))).alias("samples_analysed"),
        F.when(daily, some(whole(SAMPLES, 2))).otherwise(some(whole(POSITIVE))).alias("positive_samples"),
        total.alias("travellers_total"),
        screened.alias("travellers_screened"),
        F.coalesce(some(share(SCREENED, 2)), F.try_divide(screened.cast("double"), total.cast("double"))).alias("poe_screening_coverage"),
    )


def chart_series(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pos, label, value) of the longest pair of equally long label and data arrays."""
    arrays = lambda name: F.transform(F.regexp_extract_all(text_col, F.lit(rf'"?{name}"?\s*:\s*\[([^\]]*)\]'), F.lit(1)), lambda x: F.split(F.regexp_replace(x, r"[\"'\s]", ""), ","))
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(arrays("labels").alias("labels"), arrays("data").alias("data"))).alias("__k", "x"))
    same = pairs.where("size(x.labels) = size(x.data) and size(x.labels) > 0")
    best = same.groupBy("doc_id").agg(F.max_by("x", F.struct(F.size("x.labels"), -F.col("__k"))).alias("x"))
    zipped = F.arrays_zip(F.col("x.labels").alias("label"), F.col("x.data").alias("value"))
    return best.select("doc_id", F.posexplode(zipped).alias("pos", "p")).select("doc_id", "pos", "p.label", F.col("p.value").try_cast("long").alias("value"))


#: Names in front of a quoted address, and folders in which documents lie. Fixed values.
SOURCES, FOLDERS = ("file", "src", "pdf", "source", "url", "href"), ("wp-content/", "download/")


def joined_url(url: Column, base: str) -> Column:
    """The url as a page at ``base`` reads it: whole, by scheme, by host, or beside the page."""
    scheme, _, rest = base.partition("://")
    host, _, path = rest.partition("/")
    folder = f"{scheme}://{host}/" + path[: path.rfind("/") + 1]
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.lit(f"{scheme}:"), url)).when(url.startswith("/"), F.concat(F.lit(f"{scheme}://{host}"), url)).otherwise(F.concat(F.lit(folder), url))


def _from(piece: Column, marks: tuple[str, ...]) -> Column:
    """The rest of the piece from the first of the marks on, with a slash before it; null without one."""
    low = F.lower(piece)
    places = [F.nullif(F.locate(m, low), F.lit(0)) for m in marks]
    at = F.least(*places) if len(places) > 1 else places[0]
    slash = F.when(F.substring(low, at - 1, F.lit(1)) == "/", 1).otherwise(0)
    return F.substring(piece, at - slash, F.length(piece)) if marks is FOLDERS else F.substring(piece, at, F.length(piece))


def _quoted(parts: Column) -> Column:
    """Quoted values with the sign and the name in front, of a page cut at its quotes: an array of (name, sign, value).

    A value meets the part before it in one struct: no element reads the whole array.
    """
    blank, held = F.lit(" \t\n\x0b\f\r"), F.greatest(F.size(parts) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(parts, 1, held), F.slice(parts, 2, held), lambda before, x: F.struct(F.rtrim(before, blank).alias("before"), x.alias("value")))
    signed = F.filter(pairs, lambda r: (r["value"] != "") & (F.endswith(r["before"], F.lit(":")) | F.endswith(r["before"], F.lit("="))))
    name = lambda before: F.rtrim(F.lower(F.substring(before, F.lit(1), F.length(before) - 1)), blank)
    return F.transform(signed, lambda r: F.struct(name(r["before"]).alias("name"), F.right(r["before"], F.lit(1)).alias("sign"), r["value"].alias("value")))


def _data_attribute(name: Column) -> Column:
    """Whether the word that the name ends with says data-."""
    return F.contains(F.substring(name, F.length(F.rtrim(name, F.lit("abcdefghijklmnopqrstuvwxyz0123456789_-"))) + 1, F.length(name)), F.lit("data-"))


def urls(pages: DataFrame, id_col: str, text_col: str, base: str) -> DataFrame:
    """(doc_id, pos, url): documents (.pdf or /download/) that a page or script names, each at its first place.

    The page is taken apart at quotes, brackets and white space. Whole addresses come
    first, then paths into folders of documents, then quoted values behind a name that
    says an address, then those of data attributes; the latter two are percent-decoded.
    Other schemes than the web's are left out.
    """
    low = F.lower
    document = lambda x: F.contains(low(x), F.lit(".pdf")) | F.contains(low(x), F.lit("/download/"))
    cut = pages.select(F.col(id_col).alias("doc_id"), F.split(text_col, r"[\"'<>\s)]+").alias("words"), F.split(text_col, "[\"']").alias("parts"))
    # columns of their own, so that what follows doesn't cut the page anew
    pieces = cut.select("doc_id", F.filter("words", document).alias("words"), _quoted(F.col("parts")).alias("quoted"))
    words, quoted = F.col("words"), F.col("quoted")
    # something stands between the scheme or folder and what makes it a document
    said = lambda rest, skip, marks: functools.reduce(lambda a, b: a | b, [F.contains(low(F.substring(rest, skip, F.length(rest))), F.lit(m)) for m in marks])
    scheme = lambda x: F.coalesce(F.length(F.regexp_extract(x, "^(?i)(https?://)", 1)), F.lit(0))
    whole = F.filter(F.transform(words, lambda x: _from(x, ("http://", "https://"))), lambda x: x.isNotNull() & said(x, scheme(x) + 2, (".pdf", "/download/")))
    paths = F.filter(F.transform(words, lambda x: _from(x, FOLDERS)), lambda x: x.isNotNull() & said(x, F.locate("/", F.ltrim(x, F.lit("/"))) + 2, (".pdf",)))
    # a plus sign is no space here
    decoded = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    values = lambda test: F.filter(F.transform(F.filter(quoted, test), lambda r: decoded(r["value"])), document)
    named = values(lambda r: functools.reduce(lambda a, b: a | b, [F.endswith(r["name"], F.lit(n)) for n in SOURCES]))
    data = values(lambda r: (r["sign"] == "=") & _data_attribute(r["name"]))
    found = F.concat(whole, *[F.transform(x, lambda u: joined_url(u, base)) for x in (paths, named, data)])
    clean = F.transform(found, lambda u: F.trim(norm_spaces(u), F.lit("\"' ")))
    # outer: else Spark derives a filter that makes the whole array once more; the null row goes with the empty ones
    rows = pieces.select("doc_id", F.posexplode_outer(clean).alias("pos", "url")).where((F.col("url") != "") & ~F.lower("url").rlike("^(?:javascript|mailto|tel):"))
    return rows.groupBy("doc_id", "url").agg(F.min("pos").alias("pos")).select("doc_id", "pos", "url")


def latest_article(links: DataFrame) -> DataFrame:
    """The article (url, number, date) of the highest report number, then the last date, then the first place.

    links: pos, text, url. Only links that say sitrep, in their text or address, and
    have a number there count, each address once.
    """
    said = F.lower(F.concat_ws(" ", "text", "url")).contains("sitrep")
    number = F.coalesce(report_number(F.col("text")), report_number(F.col("url")))
    date = F.coalesce(french_date(F.col("text")), french_date(F.translate("url", "_-", "//")))
    rows = links.where(said).select("pos", "url", number.alias("number"), date.alias("date")).where("number is not null")
    once = rows.groupBy("url").agg(F.min_by(F.struct("pos", "number", "date"), "pos").alias("r")).select("url", "r.*")
    return once.agg(F.max_by(F.struct("url", "number", "date"), F.struct("number", F.coalesce("date", F.lit("0001-01-01").cast("date")), -F.col("pos"))).alias("r")).where("r is not null").select("r.*")


def candidates(spark: SparkSession, number: int, folders: list[str], templates: list[str], encodings: dict[str, str]) -> DataFrame:
    """(folder, template, encoding, url): every file name of a report in every folder and encoding."""
    column = lambda values, name: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    kinds = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in encodings.items() for x in kv])).alias("encoding", "space"))
    rows = column(folders, "folder").crossJoin(column(templates, "template")).crossJoin(kinds)
    name = F.replace(F.replace("template", F.lit("{n}"), F.lit(str(number))), F.lit(" "), F.col("space"))
    return rows.select("folder", "template", "encoding", F.concat_ws("/", "folder", name).alias("url"))
