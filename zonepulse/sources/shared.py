"""Tables in the folder that driver and executors share.

Written tables cut lineage and survive lost executors; ``release`` deletes those of
the application once its results are written.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where to keep shared tables if nothing names a folder and all runs on one machine (tests).
DEFAULT_SHARED_DIR = "file:///tmp/zonepulse-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else the one given to setCheckpointDir.

    Without either a folder of this machine is set, once, but only where driver and
    executors are one process: on a cluster that raises ValueError, since executors
    could not read each other's files.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(DEFAULT_SHARED_DIR)
        found = context.getCheckpointDir()
    return qualified(spark, found).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark reads it: one without takes the default file system."""
    if re.match(r"[a-z][a-z0-9+.-]*://", path):
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    whole = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(hadoop).toString()  # noqa: SLF001
    return re.sub(r"^([a-z0-9+.-]+):/(?!/)", r"\1:///", whole)


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/zonepulse/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the shared tables of this application. Results not yet written need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))  # noqa: SLF001
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)  # noqa: SLF001


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
