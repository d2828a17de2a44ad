"""Typed scans and sinks of the library's tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the input tables, as DDL.
SCHEMAS = {
    "zones": "zone_id STRING, zone_name STRING, province STRING, category STRING, is_uganda_border INT, is_kinshasa INT, lat DOUBLE, lon DOUBLE, area_km2 DOUBLE",
    "outbreak_zones": "zone_id STRING, zone_name STRING, province STRING, lat DOUBLE, lon DOUBLE, is_outbreak INT, is_uganda_border INT, is_kinshasa INT",
    "monthly_flows": "month STRING, origin_id STRING, destination_id STRING, movement INT",
    "population": "month STRING, zone_id STRING, zone_name STRING, province STRING, lat DOUBLE, lon DOUBLE, population DOUBLE",
    "cases": "date DATE, month STRING, province STRING, health_zone STRING, zone_id STRING, confirmed_cases INT, confirmed_deaths INT, lat DOUBLE, lon DOUBLE, source STRING, source_date DATE, notes STRING",
    "cases_unventilated": "date DATE, month STRING, province STRING, category STRING, confirmed_cases INT, confirmed_deaths INT, source STRING, source_date DATE, notes STRING",
    "contact_followup": "date DATE, province STRING, contacts_under_followup INT, contacts_seen INT, followup_rate DOUBLE, target_rate DOUBLE, source STRING, notes STRING",
    "scenarios": "scenario_id STRING, scenario_name STRING, cross_border_fraction DOUBLE, description STRING",
    "air_rules": "match_type STRING, match_value STRING, air_factor DOUBLE, label STRING, notes STRING",
    "profile": "uganda_id STRING, uganda_name STRING, type STRING, district STRING, lat DOUBLE, lon DOUBLE, weight DOUBLE, source_basis STRING",
    "district_flows": "period STRING, uganda_district STRING, observed_movements INT, share DOUBLE, lat DOUBLE, lon DOUBLE, source STRING",
    "neighbour_daily": "date DATE, date_label STRING, confirmed_cases INT, source_url STRING, notes STRING",
}


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A required CSV with header; quoted text may span lines. Without schema all columns are strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", False).csv(path)


def _there(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV, or an empty table of the schema if the path is missing."""
    found = _there(lambda: scan_csv(spark, path, schema))
    return spark.createDataFrame([], schema) if found is None else found


def scan_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, nulls as ''."""
    return scan_csv(spark, path).fillna("")


def geojson_features(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, properties map, geometry JSON) per feature of GeoJSON documents."""
    shape = "struct<features: array<struct<properties: map<string,string>, geometry: string>>>"
    return raw.select(*keep, F.explode(F.from_json(column, shape)["features"]).alias("f")).select(*keep, "f.properties", "f.geometry")


def cell_grid(text: Column, row: str = "\n", cell: str = r"\s*[|;]\s*") -> Column:
    """Table text as rows of cells; null stays null."""
    return F.transform(F.split(text, row), lambda x: F.split(F.trim(x), cell))


def scan_geojson(spark: SparkSession, path: str) -> DataFrame | None:
    """(properties map, geometry JSON) per feature; None if the path or its features are missing."""
    raw = _there(lambda: spark.read.text(path, wholetext=True))
    if raw is None:
        return None
    rows = geojson_features(raw)
    return None if rows.isEmpty() else rows


def scan_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A JSON document or None if the path is missing."""
    reader = spark.read.option("multiLine", True)
    return _there(lambda: (reader.schema(schema) if schema else reader).json(path))


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Lazy DataFrames of all known tables of a folder; missing ones are empty."""
    return {name: scan_optional_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in SCHEMAS.items()}


def landed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Downloaded files of a landing folder with their content: (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of page rows (doc_id, page, text), each page behind a marker line, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("--- PAGE "), x["page"].cast("string"), F.lit(" ---\n"), F.coalesce(x["text"], F.lit(""))))
    return pages.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))


def property_of(names: list[str], properties: str = "properties") -> Column:
    """The first property of these names that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(F.col(properties), F.lit(n))), F.lit("")) for n in names])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("append").json(path)
