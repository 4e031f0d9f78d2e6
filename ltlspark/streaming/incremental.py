"""Incremental stages: each micro-batch goes through the batch transformation and is appended once.

The work queue of the original is a loop that reads what is not done yet. Here the
input directory is a stream; a batch drops the keys that the output has (so a
repeated batch, or a run from the beginning, adds nothing) and the stream's checkpoint
remembers the files. Of the output only the key is read; batches should be large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import has_files, shared_dir


def run_incremental(spark: SparkSession, source: str, schema: str, out: str, key: str, transform: Callable[[DataFrame], DataFrame], *, name: str = "stage", checkpoint: str | None = None, per_trigger: int | None = None) -> StreamingQuery:
    """A query that has processed all files of source once it has ended (trigger availableNow)."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)

    def each(batch: DataFrame, _: int) -> None:
        made = transform(batch).dropDuplicates([key])
        if has_files(spark, out):
            made = made.join(spark.read.schema(made.schema).parquet(out).select(key), key, "left_anti")
        made.write.mode("append").parquet(out)

    stream = reader.parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/stream-{name}").trigger(availableNow=True).start()


def domain_counts(stream: DataFrame, time: str, domain: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Translations by domain in windows of event time, for balanced choice over a stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), domain).agg(F.count("*").alias("n"))
