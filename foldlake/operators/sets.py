"""Sets of items: concatenation, upserts, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fold import latest


def concat_disjoint(*parts: DataFrame) -> DataFrame:
    """Parts whose ranges of keys do not overlap, as one; columns go by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replace_all(base: DataFrame, batch: DataFrame) -> DataFrame:
    """(key, value): the batch's items over the base's."""
    age = lambda df, n: df.select("key", F.lit(n).cast("long").alias("seq"), "value")
    return latest(age(base, 0).unionByName(age(batch, 1)), ("value",)).select("key", "value")


def checksums(items: DataFrame) -> DataFrame:
    """(key, checksum): the MD5 of each key."""
    return items.select("key", F.md5("key").alias("checksum"))
