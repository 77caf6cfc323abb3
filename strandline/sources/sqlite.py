"""SQLite tables as a Spark source: `spark.read.format("sqlite")` with the options path, table and partitions.

Rows are dealt over the partitions by ranges of rowid, which SQLite answers from the table's own tree.
The file must be visible to the executors. Null and mixed values are cast to the schema by Arrow.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_KINDS = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
BATCH = 4096


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.count = options["path"], options["table"], int(options.get("partitions", 8))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as base:
            first, last = base.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if first is None:
            return [_Range(0, -1)]
        width = -(-(last - first + 1) // self.count)
        return [_Range(at, min(at + width - 1, last)) for at in range(first, last + 1, width)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(self.schema)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as base:
            names = ", ".join(_quoted(f.name) for f in self.schema.fields)
            rows = base.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while part := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part, strict=True), shape, strict=True)], schema=shape)


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as base:
            columns = base.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        kind = lambda declared: next((spark for part, spark in _KINDS.items() if part in declared.upper()), "string")
        return ", ".join(f"`{name}` {kind(declared or '')}" for _, name, declared, *_ in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()
