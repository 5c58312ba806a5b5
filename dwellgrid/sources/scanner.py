"""Scanning by a reader of the user's choice, and one such reader: lines of JSON as a data source in Python."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dwellgrid.sources.checked import read_lines, require_columns

#: Bytes of a file that one partition reads.
SPLIT_BYTES = 32 << 20
Scanner = Callable[[SparkSession, str, str], DataFrame]
_CASTS = {T.LongType: int, T.IntegerType: int, T.DoubleType: float, T.StringType: str, T.BooleanType: bool}


def scan(spark: SparkSession, path: str, ddl: str, scanner: Scanner | None = None) -> DataFrame:
    """Rows of the files under ``path`` with the columns of ``ddl``, by Spark's own text reader or by ``scanner(spark, path, ddl)``."""
    if scanner is None:
        return read_lines(spark, path, ddl)
    names = T.StructType.fromDDL(ddl).names
    return require_columns(scanner(spark, path, ddl), names, "the scanner's table").select(*names)


def lines_scanner(header_only: str | None = None, split_bytes: int = SPLIT_BYTES) -> Scanner:
    """A scanner of JSON lines: files are cut into ranges of bytes, only the asked columns are made, blank lines and those with the field ``header_only`` are skipped."""

    def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
        spark.dataSource.register(LinesSource)
        return spark.read.format(LinesSource.name()).schema(ddl).option("header_only", header_only or "").option("split_bytes", split_bytes).load(path)

    return read


def _opened(path: str):
    """File system and path; a path without a scheme is a local one."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class LinesSource(DataSource):
    """``spark.read.format("json_lines_by_range")``; the schema says which fields are read."""

    @classmethod
    def name(cls) -> str:
        return "json_lines_by_range"

    def schema(self):
        raise ValueError("name the columns: .schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LinesReader(self.options, schema)


class LinesReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.header = options["path"], options.get("header_only") or None
        self.split, self.schema = int(options.get("split_bytes", SPLIT_BYTES)), schema

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, base = _opened(self.path)
        found = system.get_file_info(base)
        if found.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.base_name[0] not in "_."]
        else:
            files = [found]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [Range(scheme + f.path, at, min(at + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """Lines that begin in the range; a line may end beyond it."""
        system, path = _opened(partition.path)
        fields = [(f.name, _CASTS[type(f.dataType)]) for f in self.schema.fields]
        with io.BufferedReader(system.open_input_file(path), 1 << 20) as f:
            at = max(partition.start - 1, 0)
            f.seek(at)
            if partition.start:
                at += len(f.readline())  # the rest of a line that began before
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                at += len(line)
                row = self._row(line, fields)
                if row is not None:
                    yield row

    def _row(self, line: bytes, fields) -> tuple | None:
        if not line.strip():
            return None
        try:
            got = json.loads(line)
        except ValueError:
            got = {}
        if not isinstance(got, dict):
            got = {}
        if self.header is not None and self.header in got:
            return None
        return tuple(_cast(got.get(name), kind) for name, kind in fields)


def _cast(value, kind):
    """A value of another kind than the column's is NULL; whole numbers are numbers."""
    if kind is float and type(value) is int:
        return float(value)
    return value if type(value) is kind else None
