"""Reading and writing the corpus' tables: Parquet, CSV, JSON, SQL and SQLite files."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import has_files, shared_dir


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


#: CSV by RFC 4180, every field in quotes and as it is: no white space goes, \N is null and "" the empty text.
_CSV = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "lineSep": "\n", "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: str, line_end: str | None = "\n") -> DataFrame:
    """CSV with a header; texts may hold commas, quotes and line ends. \\N and an empty field without quotes are null.

    Files of other programs may end lines otherwise: None takes what ends the header (as \\n within texts too).
    """
    df = spark.read.schema(schema).csv(path, multiLine=True, **(_CSV | {"lineSep": line_end}))
    return _texts(df, lambda c: F.when(F.rlike(c, F.lit(r"^\\\\+N\z")), F.substr(c, F.lit(2))).otherwise(c))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that read_csv gives back as it was; a text of backslashes and N gets one backslash more, so that none is null's mark."""
    _texts(df, lambda c: F.when(F.rlike(c, F.lit(r"^\\+N\z")), F.concat(F.lit("\\"), c)).otherwise(c)).write.mode("overwrite").csv(path, quoteAll=True, **_CSV)


def _texts(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.select(*[change(df[f.name]).alias(f.name) if isinstance(f.dataType, T.StringType) else df[f.name] for f in df.schema])


def read_sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """query with {name} for each of the given tables."""
    return spark.sql(query, **tables)


def snapshot(df: DataFrame, path: str) -> None:
    """A copy at path, unless there is one."""
    df.write.mode("ignore").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A statistics report, a few rows, as one CSV file."""
    write_csv(report.coalesce(1), path)


def statistics_json(one_row: DataFrame) -> DataFrame:
    return one_row.withColumn("statistics_json", F.to_json(F.struct(*one_row.columns)))


def processed_keys(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """Keys that earlier runs have noted as done; none before the first."""
    path = f"{shared_dir(spark)}/progress-{name}"
    return spark.read.schema(schema).parquet(path) if has_files(spark, path) else spark.createDataFrame([], schema)


def note_processed(keys: DataFrame, name: str) -> None:
    keys.write.mode("append").parquet(f"{shared_dir(keys.sparkSession)}/progress-{name}")


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["dbtable"], schema
        self.parts = int(options.get("numpartitions", "4"))

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            lo, hi = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if lo is None:
            return [_Range(0, -1)]
        step = -(-(hi - lo + 1) // self.parts)
        return [_Range(x, min(x + step - 1, hi)) for x in range(lo, hi + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        types = [f.dataType for f in self.schema.fields]
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'select {names} from "{self.table}" where rowid between ? and ?', (partition.lo, partition.hi)):
                yield tuple(_as(v, t) for v, t in zip(row, types, strict=True))


def _as(v, t: T.DataType):
    """SQLite's 0, 1 and JSON texts as booleans and arrays."""
    if v is None:
        return None
    if isinstance(t, T.BooleanType):
        return bool(v)
    if isinstance(t, T.ArrayType):
        return json.loads(v)
    if isinstance(t, (T.LongType, T.IntegerType)):
        return int(v)
    return float(v) if isinstance(t, T.DoubleType) else str(v)


class SqliteSource(DataSource):
    """format("corpus_sqlite"): options path, dbtable, numPartitions; the schema is the reader's. Row ids are dealt by range.

    The file must be where every executor can open it.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_sqlite"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: T.StructType) -> _SqliteReader:
        return _SqliteReader(dict(self.options), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("corpus_sqlite").schema(schema.replace(" not null", "")).options(path=path, dbtable=table, numPartitions=partitions).load()
