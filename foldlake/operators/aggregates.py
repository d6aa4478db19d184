"""Sizes, counts and statistics of edit and item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import packed_size
from ..model import ITEM_OPS


def set_size(df: DataFrame) -> DataFrame:
    """(n, bytes): edits and their bytes in packed leaves."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(packed_size(F.col("key"), F.col("value"))).cast("long").alias("bytes"))


def key_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def distinct_keys(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("key").alias("n_keys"))


def leaf_summary(df: DataFrame) -> DataFrame:
    """(drop_count, key_count, key_bytes, value_bytes): what a leaf of these edits would hold; parts add up."""
    live = F.col("op").isin(*ITEM_OPS)
    return df.agg(
        F.count_if(~live).alias("drop_count"),
        F.count_if(live).alias("key_count"),
        F.coalesce(F.sum(F.when(live, F.octet_length("key"))), F.lit(0)).cast("long").alias("key_bytes"),
        F.coalesce(F.sum(F.when(live, F.octet_length("value"))), F.lit(0)).cast("long").alias("value_bytes"),
    )


def pending_bytes(routed: DataFrame, value: str = "i32") -> DataFrame:
    """Bytes that wait for each pivot."""
    return routed.groupBy("pivot").agg(F.sum(F.lit(9) + F.octet_length("key") + F.octet_length(F.col(value).cast("string"))).cast("long").alias("bytes"))


def fullest_pivot(pending: DataFrame) -> DataFrame:
    """(pivot, bytes) of the most bytes, the first on a tie; (0, 0) if there are none."""
    return pending.agg(F.coalesce(F.max_by("pivot", F.struct("bytes", -F.col("pivot"))), F.lit(0)).alias("pivot"), F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes"))


def flush_wanted(pending: DataFrame, min_flush: int, levels: int, max_levels: int = 62) -> DataFrame:
    """Whether the fullest pivot is to be flushed."""
    return fullest_pivot(pending).select("pivot", "bytes", ((F.col("bytes") >= min_flush) | F.lit(levels > max_levels)).alias("flush"))


def segment_estimate(pending: DataFrame, flush_size: int, max_item: int) -> DataFrame:
    return pending.select("pivot", F.ceil(F.col("bytes") / (flush_size - max_item)).cast("long").alias("segments"))


def level_counts(df: DataFrame) -> DataFrame:
    """(tier, keys, edits, key_bytes, pivots) of each tier: pivots that a tier's keys touch, each counted once."""
    return df.groupBy("tier").agg(
        F.count_distinct("key").alias("keys"),
        F.count(F.lit(1)).alias("edits"),
        F.sum(F.octet_length("key")).cast("long").alias("key_bytes"),
        F.count_distinct("pivot").cast("int").alias("pivots"),
    )


def op_metrics(df: DataFrame) -> DataFrame:
    """Counts and value statistics by op."""
    return df.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.min("i32").alias("min_v"), F.max("i32").alias("max_v"), F.sum("i32").cast("long").alias("sum_v"))


def edits_per_key(df: DataFrame) -> DataFrame:
    """Derived ratios of a log: edits, keys, edits per key in thousandths, share of adds in thousandths."""
    a = df.agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("key").alias("keys"), F.count_if(F.col("op") == 3).alias("adds"))
    return a.select("edits", "keys", F.expr("edits * 1000 div greatest(keys, 1)").alias("per_key_milli"), F.expr("adds * 1000 div greatest(edits, 1)").alias("adds_milli"))


def run_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Runs, mean and sample deviation of a value by group, rounded to 6 places."""
    return df.groupBy(by).agg(F.count(value).alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd"))
