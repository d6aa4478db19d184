"""Generated tables: random result sets and their odometer twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import random_key, sequential_text


def result_set(spark: SparkSession, n: int, seed: int = 0, key_size: int = 24, value_size: int = 100) -> DataFrame:
    """(key, value): n items with distinct random keys; values repeat one letter."""
    letter = F.substring(F.lit("_`abcdefghijklmnopqrstuvwxyz{|}~"), (F.col("id") % 32 + 1).cast("int"), F.lit(1))
    drawn = spark.range(n + n // 8 + 16).select(random_key(F.col("id"), seed, key_size).alias("key"), F.repeat(letter, F.lit(value_size)).alias("value"), "id")
    one = drawn.groupBy("key").agg(F.min_by("value", "id").alias("value"), F.min("id").alias("id"))
    return one.orderBy("id").limit(n).select("key", "value")


def sequential_values(spark: SparkSession, n: int, size: int = 100) -> DataFrame:
    """(id, value): the first n values of the odometer."""
    return spark.range(n).select("id", sequential_text(F.col("id"), size).alias("value"))
