"""Incremental ingestion: poll, validate, publish or quarantine, and the rows that count; windows of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, landing: str, schema: str, checkpoint: str, publish: Callable[[DataFrame, int], None], files: int = 1000) -> StreamingQuery:
    """Hand every new landed CSV once to ``publish(batch, id)``, ``files`` at most a batch; what is seen is in the checkpoint."""
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(landing)
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())  # noqa: SLF001
    return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []


def split_publish(valid: Column, table: str, quarantine: str, source: str, later: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A publisher: valid rows of a batch are appended to ``table``, others are kept for review.

    source names the stream; each batch of a source writes one folder of its own, which
    a repeated attempt writes anew, so nothing is published twice, and a new source, or
    a new checkpoint under a new name, adds to what is there. No batch rewrites what
    others wrote: ``current`` lets the later row of a key win, ``compact`` folds them.
    later grows with the order of a batch's rows (a long); without it the order of files does,
    which says something only where a batch is one file.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{source}-{number}"
        marked = batch.withColumn("__ok", F.coalesce(valid, F.lit(False)))
        marked.where("not __ok").drop("__ok").write.mode("overwrite").json(f"{quarantine}/{name}")
        known = {x.partition("-")[2]: x.partition("-")[0] for x in _listed(spark, table) if x[:1].isdigit()}
        order = known.get(name) or f"{max([0, *map(int, known.values())]) + 1:010d}"
        rows = marked.where("__ok").drop("__ok").withColumn("__order", F.lit(int(order))).withColumn("__pos", F.monotonically_increasing_id() if later is None else later.cast("long"))
        rows.write.mode("overwrite").parquet(f"{table}/{order}-{name}")

    return publish


def current(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The published rows, the last of each key."""
    rows = spark.read.parquet(*[f"{table}/{x}" for x in sorted(_listed(spark, table)) if x[:1].isdigit()])
    rest = [c for c in rows.columns if c not in (*keys, "__order", "__pos")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__order", "__pos")).alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, table: str, keys: list[str], into: str) -> None:
    """Write the current rows as the first batch of a new table."""
    rows = current(spark, table, keys).withColumn("__order", F.lit(0)).withColumn("__pos", F.monotonically_increasing_id())
    rows.write.parquet(f"{into}/{0:010d}-compacted-0")


def newer_only(batch: DataFrame, known: int, number: str = "number") -> DataFrame:
    """Rows of reports that are newer than the last known number."""
    return batch.where(F.col(number) > known)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events a window and type, late rows dropped behind the watermark (an extension)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark (an extension)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
