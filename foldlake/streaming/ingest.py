"""Edit feeds.

``ingest`` hands each micro-batch to the store under its batch id. The store ignores a batch it already holds, so a query
that restarts from its checkpoint after a failure applies each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..model import EDIT_SCHEMA
from ..plans.store import Store


def edit_stream(spark: SparkSession, path: str, schema: StructType = EDIT_SCHEMA, files_per_trigger: int | None = 16, bytes_per_trigger: int | None = None) -> DataFrame:
    """Edits from Parquet files as they come. A trigger takes so many files, or files of so many bytes, at most,
    which closes a batch and is the back-pressure; give one of the two."""
    if (files_per_trigger is None) == (bytes_per_trigger is None):
        raise ValueError("give files_per_trigger or bytes_per_trigger")
    limit = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    return spark.readStream.schema(schema).option(*limit).parquet(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    def apply(batch: DataFrame, batch_id: int) -> None:
        store.refresh()
        store.append(batch, batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_latest(stream: DataFrame) -> DataFrame:
    """The newest edit of each key, kept as streaming state; for logs without adds. Use output mode update or complete."""
    return stream.groupBy("key").agg(F.max_by(F.struct("op", "i32"), "seq").alias("v"), F.max("seq").alias("seq")).select("key", "v.op", "v.i32", "seq")


def windowed_counts(stream: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and kind; those later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def add_counters(stream: DataFrame) -> DataFrame:
    """Sums of the adds of each key, as streaming state."""
    return stream.where("op = 3").groupBy("key").agg(F.sum("i32").cast("long").alias("i32"))
