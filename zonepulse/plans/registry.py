"""Where query modules register their Spark query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonepulse.plans import tables
from zonepulse.sources.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Source:
    """Attribute access to the tables of one sf_dir: ``t.flows``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.sf_dir, name)

    def monthly_flows(self) -> DataFrame:
        """Flows written once to the shared folder, a partition a month; rows of a month meet before the write, so it has few files."""
        path = new_path(self.spark, "flows-by-month")
        rows = self.flows
        rows.repartition("month", "destination_id").write.partitionBy("month").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def flows_of(self, month: str) -> DataFrame:
        return tables.load(self.spark, self.sf_dir, "flows", month)


def query(over: str | None = None, sql: str | None = None):
    """Register a function of a Source; ``sql`` is over the concept tables in ``over``."""

    def register(f: Callable[[Source], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = tables.ctes(over or "", sql)
        return f

    return register
