"""A data source of landed reports: one folder a report number, JSON lines in it.

    spark.dataSource.register(LandedReports)
    spark.read.format("landed_reports").schema(...).load(folder)
    spark.readStream.format("landed_reports").schema(...).load(folder)

A batch reads every report, ``filesPerPartition`` files a partition, from ``newerThan`` on
if that is given. A stream's offset is a report number: a trigger reads the reports
above the last one read, and a restart goes on behind
the number in its checkpoint. A report whose number is not above it is never read, so
whoever lands an old report anew changes nothing.

Values are read by the schema given: whole numbers, doubles, strings, booleans, dates and
timestamps in ISO form; fields that a line lacks are null, others are ignored.
The listing alone is made on the driver; tasks open the files.
"""

from __future__ import annotations

import datetime
import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegralType, StringType, StructType, TimestampType

_NUMBERED = re.compile(r"/number=([0-9]+)/([^/]+)$")


class Files(InputPartition):
    """Files that one task reads, with the number of each one's report."""

    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri if "://" in uri else f"file://{uri}"))


def listed(folder: str) -> list[tuple[int, str]]:
    """(number, path) of every file of a report, by number; files that writers hide or have not finished do not count."""
    from pyarrow import fs

    system, path = _system(folder)
    out = []
    for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        found = _NUMBERED.search(info.path)
        if info.is_file and info.size and found and found[2][0] not in "._" and "/_temporary/" not in info.path:
            out.append((int(found[1]), info.path))
    return sorted(out)


def typed(value, kind):
    """A JSON value as the type asks for it; what does not fit is null."""
    if value is None or isinstance(kind, StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value)
    try:
        if isinstance(kind, IntegralType):
            return int(value)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value)
        if isinstance(kind, DateType):
            return datetime.date.fromisoformat(value)
        if isinstance(kind, TimestampType):
            return datetime.datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    return value


class _Rows:
    """What batch and stream share: reading the files of a partition."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        self.folder = self.options["path"]

    def _dealt(self, files: list[tuple[int, str]]) -> list[Files]:
        most = max(1, int(self.options.get("filesperpartition", "64")))
        return [Files(files[k : k + most]) for k in range(0, len(files), most)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _system(self.folder)
        for number, path in partition.files:
            with system.open_input_stream(path) as stream:
                for line in stream.read().decode().splitlines():
                    row = (json.loads(line) if line.strip() else {}) | {"number": number}
                    yield tuple(typed(row.get(f.name), f.dataType) for f in self.schema.fields)


class Batch(_Rows, DataSourceReader):
    def partitions(self) -> list[Files]:
        after = int(self.options.get("newerthan", "-1"))
        return self._dealt([f for f in listed(self.folder) if f[0] > after]) or [Files([])]


class Stream(_Rows, DataSourceStreamReader):
    """Offsets are ``{"number": n}``: all reports up to n are read."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"number": int(self.options.get("newerthan", "-1"))}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"number": max([self.initialOffset()["number"], *(n for n, _ in listed(self.folder))])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self._dealt([f for f in listed(self.folder) if start["number"] < f[0] <= end["number"]]) or [Files([])]


class LandedReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_reports"

    def schema(self) -> str:
        return "number long, line string"

    def reader(self, schema: StructType) -> Batch:
        return Batch(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> Stream:  # noqa: N802
        return Stream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session; the classes travel by value, so no worker needs this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LandedReports)
