"""Key ranges: bounds, drops, splits, routing to pivots, pruning and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import in_hash_mask
from .ordered import key_bounds, place_in


def from_key(df: DataFrame, low: str) -> DataFrame:
    return df.where(F.col("key") >= low)


def up_to(df: DataFrame, high: str) -> DataFrame:
    return df.where(F.col("key") <= high)


def drop_closed(df: DataFrame, low: str, high: str) -> DataFrame:
    """Without keys in [low, high]."""
    return df.where(~F.col("key").between(low, high))


def drop_half_open(df: DataFrame, low: str, high: str) -> DataFrame:
    """Without keys in [low, high)."""
    return df.where((F.col("key") < low) | (F.col("key") >= high))


def split_at(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("key") < key), df.where(F.col("key") >= key)


def pivot_ranges(pivots: DataFrame) -> DataFrame:
    """(key) lower bounds -> (pivot, lo, hi); the last hi is null: open. A row for each pivot."""
    w = Window.partitionBy(F.lit(1)).orderBy("key")
    return pivots.select((F.row_number().over(w) - 1).cast("int").alias("pivot"), F.col("key").alias("lo"), F.lead("key").over(w).alias("hi"))


def route(df: DataFrame, pivots: DataFrame, bound: int = 8192) -> DataFrame:
    """``df`` with the pivot whose range holds the key; keys below the first pivot are not routed.

    Up to ``bound`` pivots go to all rows as a sorted array, which each row searches. More are placed by sorting the
    distinct keys and the pivots together inside ranges of the key, where the last pivot seen is the answer; rows then get it by their
    key, so a key with very many rows is one row where it is sorted.
    """
    few = [r.key for r in pivots.select("key").limit(bound + 1).collect()]
    if len(few) <= bound:
        return df.withColumn("pivot", (place_in(sorted(few), F.col("key")) - 1).cast("int")).where("pivot >= 0")
    ranges = pivot_ranges(pivots)
    bounds = key_bounds(df)
    at = place_in(bounds, F.col("key"))
    starts = ranges.select(F.col("lo").alias("key"), "pivot").withColumn("range", at)
    tops = starts.groupBy("range").agg(F.max("pivot").alias("top"))
    every = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("range")).join(tops, "range", "left")
    before = every.select("range", F.max("top").over(Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row for each range
    both = df.select("key").distinct().withColumns({"pivot": F.lit(None).cast("int"), "range": at}).unionByName(starts)
    last = F.last("pivot", ignorenulls=True).over(Window.partitionBy("range").orderBy("key", F.col("pivot").asc_nulls_last()))
    placed = both.withColumn("last", last).where("pivot IS NULL").join(F.broadcast(before), "range").select("key", F.coalesce("last", "before").alias("pivot")).where("pivot IS NOT NULL")
    return df.join(placed, "key")


def only_pivots(df: DataFrame, active: int) -> DataFrame:
    """Rows whose pivot's bit is set in ``active``, which may have any number of bits."""
    return df.where(F.col("pivot").isin([i for i in range(active.bit_length()) if active >> i & 1]))


def unflushed(edits: DataFrame, compacted_seq: int | Column) -> DataFrame:
    """Edits that no compaction has moved down yet."""
    return edits.where(F.col("seq") > compacted_seq)


def after_batch(edits: DataFrame, upper: int) -> DataFrame:
    """Edits of batches that the checkpoint does not hold: a batch that comes again changes nothing."""
    return edits.where(F.col("batch_id") > upper)


def sample_by_hash(df: DataFrame, mask: int) -> DataFrame:
    return df.where(in_hash_mask(F.col("key"), mask))


def maybe_member(df: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows whose key is among the probes. The join's own runtime filters (a Bloom filter of the probe side, where Spark
    finds it worth while) reject absent keys at the scan, so no filter of our own goes before it."""
    return df.join(probes.select("key"), "key", "left_semi")
