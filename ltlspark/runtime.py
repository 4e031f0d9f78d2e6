"""Session helpers: where shared intermediate tables go, how lineage is cut, and when the tables go."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine (tests), where the session names no shared folder.
LOCAL_SHARED = "/tmp/checkpoints/ltlspark"
#: Shuffle files go when the query that made them has ended, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it only a local master will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def materialise(df: DataFrame, name: str, onto: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, or add it to an earlier table of its kind, and read it back.

    The table survives lost executors, and what follows no longer depends on how it was made. It lies there until
    discard(), or else until the driver ends.
    """
    spark = df.sparkSession
    path = _TABLES.pop(id(onto))[2].toString() if onto is not None else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if id(out) in _TABLES:
        _LEFT.append(_TABLES[id(out)])
    _TABLES[id(out)] = (weakref.ref(out), *_place(spark, path))
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    """The file system and the path of a folder, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    fs, where = _place(spark, path)
    fs.delete(where, True)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there and has Parquet files."""
    fs, where = _place(spark, path)
    return fs.exists(where) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(where))


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files of any format; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.append((None, *_place(spark, path)))
    return path


#: Where tables of materialise() lie: by the frame's id, itself, its file system and its path.
_TABLES: dict[int, tuple] = {}
#: Tables whose frame is gone, but which others may read.
_LEFT: list[tuple] = []


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for these, once nothing lazy reads it any more."""
    for df in tables:
        ref, fs, where = _TABLES.get(id(df), (None, None, None))
        if ref is not None and ref() is df:
            del _TABLES[id(df)]
            fs.delete(where, True)


@atexit.register
def _sweep() -> None:
    """Results are lazy and read what is left; when the driver ends, nothing does."""
    for _, fs, where in [*_TABLES.values(), *_LEFT]:
        with contextlib.suppress(Exception):  # the gateway may have gone before
            fs.delete(where, True)


def arrow_rows(spark: SparkSession, rows: int = 2048) -> None:
    """Bound the rows of an Arrow batch of long texts; a smaller bound of the session stays.

    Plans read the bound when they run, so it holds for the session from here on: smaller batches, equal results.
    """
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_of(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions of so many rows each, the session's number at least, so that a task's memory does not follow the table's size."""
    return max(shuffle_partitions(df.sparkSession), -(-df.count() // rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
