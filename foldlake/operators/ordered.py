"""Computations along the key order: running totals, even parts, separators, revisions, levels."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import separator
from ..shared import cut

#: Groups are split at so many values of their order.
CHUNK = 1 << 22
#: Ranges of keys for so many rows each, within these limits; keys of a sample for each range.
RANGE_ROWS, RANGES, SAMPLE = 250_000, (8, 8192), 32


def place_in(bounds: list[str], key: Column) -> Column:
    """How many of ``bounds``, which are sorted, lie at or below ``key``: a binary search in each row."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    all_ = F.from_json(F.lit(json.dumps(bounds)), "array<string>")  # folded to one literal when the query is planned

    def step(at: Column, add: Column) -> Column:
        return F.when((at + add <= len(bounds)) & (F.get(all_, at + add - 1) <= key), at + add).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def key_bounds(df: DataFrame, buckets: int | None = None) -> list[str]:
    """Keys that cut the table into ``buckets`` ranges of like size, by a hash sample of keys; without ``buckets``, into
    ranges of about RANGE_ROWS rows. The driver gets SAMPLE keys for each range."""
    n = df.count()
    buckets = buckets or min(max(-(-n // RANGE_ROWS), RANGES[0]), RANGES[1])
    step = max(1, n // (SAMPLE * buckets))
    keys = sorted(r.key for r in df.select("key").where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).limit(8 * SAMPLE * buckets).collect() if r.key is not None)
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def running_total(df: DataFrame, size: Column, out: str = "run", buckets: int | None = None) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows up to and with this one, by key (unique).

    Ranges of keys are summed by themselves, as many as the rows ask for; then each range's rows add the sums of the
    ranges before. No window over the whole table. ``df`` is computed once and kept in the shared folder.
    """
    kept = cut(df.withColumn("__size", size))
    dealt = kept.withColumn("__range", place_in(key_bounds(kept, buckets), F.col("key")))
    sums = dealt.groupBy("__range").agg(F.sum("__size").alias("__sum"))  # a row for each range, RANGES at most
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("__size").over(Window.partitionBy("__range").orderBy("key"))
    return dealt.withColumn("__run", inside).join(F.broadcast(before), "__range").withColumn(out, (F.col("__run") + F.col("__before")).cast("long")).drop("__size", "__range", "__run", "__before")


def trim_to(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """The longest prefix in key order whose sizes sum to ``limit`` at most."""
    return running_total(df, size).where(F.col("run") <= limit)


def even_parts(df: DataFrame, size: Column, max_part: int, max_item: int) -> DataFrame:
    """``df`` with ``part``: contiguous parts in key order, each of max_part at most, sizes within one item of even."""
    if max_part <= max_item:
        raise ValueError("a part must have room for more than one item")
    runs = cut(running_total(df, size))
    total = runs.agg(F.coalesce(F.max("run"), F.lit(0)).cast("long").alias("total"))
    parts = F.greatest(F.lit(1), F.expr(f"(total + {max_part - max_item} - 1) div {max_part - max_item}"))
    return runs.join(F.broadcast(total), how="cross").withColumn("part", F.floor((F.col("run") - 1) * parts / F.greatest("total", F.lit(1))).cast("int")).drop("total")


def part_sizes(parts: DataFrame, size: Column) -> DataFrame:
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"), F.min("key").alias("min_key"))


def split_point(df: DataFrame, size: Column) -> DataFrame:
    """(key): the first key of the right half, where the running total is nearest to half of the whole."""
    runs = cut(running_total(df, size))
    half = runs.agg(F.max("run").alias("total"))
    gap = F.abs(2 * (F.col("run") - size) - F.col("total"))
    return runs.join(F.broadcast(half), how="cross").agg(F.min_by("key", F.struct(gap, "key")).alias("key"))


def _parted(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("__part", F.floor(F.col(order) / chunk).cast("long"))


def carried(df: DataFrame, by: str, order: str, inside: Column, summary: Column, over_parts: Callable[[Column], Column], chunk: int = CHUNK, span: int | None = None) -> DataFrame:
    """``df`` with __inside and __carry, for a computation along ``order`` in each group of ``by`` that is split.

    Groups fall into parts of ``chunk`` values of ``order``. ``inside`` is a window function, computed within each part;
    ``summary`` is an aggregate of a part, and ``over_parts`` makes of it what all parts before hand on, over a window of
    the group's parts. So a group with very many rows is many tasks' work; parts are as many as its rows / ``chunk``. Where
    the whole table's ``order`` spans less than that, no group has more than one part, and the window alone does. A
    caller that knows this ``span`` gives it, else a job over ``df`` finds it.
    """
    if span is None:
        span = df.agg(F.max(order) - F.min(order)).first()[0]
    if span is None or span < chunk:
        return df.withColumns({"__inside": inside.over(Window.partitionBy(by).orderBy(order)), "__carry": F.lit(None)})
    parted = _parted(df, order, chunk)
    ends = parted.groupBy(by, "__part").agg(summary.alias("__end"))
    handed = ends.select(by, "__part", over_parts(F.col("__end")).over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    return parted.withColumn("__inside", inside.over(Window.partitionBy(by, "__part").orderBy(order))).join(handed, [by, "__part"]).drop("__part")


def before(df: DataFrame, by: str, order: str, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """``df`` with __before: a struct of ``columns`` of the row in front in each group of ``by``, null for the first."""
    row = F.struct(*columns)
    both = carried(df, by, order, F.lag(row), F.max_by(row, order), lambda end: F.last(end), chunk)
    return both.withColumn("__before", F.coalesce("__inside", "__carry")).drop("__inside", "__carry")


def revisions(edits: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``edits`` with the number of each within its key, from 0."""
    both = carried(edits, "key", "seq", F.row_number(), F.count(F.lit(1)), lambda end: F.sum(end), chunk)
    return both.withColumn("revision", F.col("__inside").cast("long") - 1 + F.coalesce("__carry", F.lit(0))).drop("__inside", "__carry")


def separators(items: DataFrame, step: int = 16, by: str | None = None) -> DataFrame:
    """(rn, separator) at every ``step``-th key: the shortest prefix that parts it from the key before."""
    ranked = cut(running_total(items.select("key"), F.lit(1), "rn"))
    high = ranked.where(F.expr(f"(rn - 1) % {step} = 0 AND rn > 1")).withColumnRenamed("key", "hi")
    prev = ranked.select((F.col("rn") + 1).alias("rn"), F.col("key").alias("lo"))
    return high.join(prev, "rn").select("rn", separator("lo", "hi").alias("separator"))


def rates(points: DataFrame, by: str, time: str, ops: str, chunk: int = CHUNK) -> DataFrame:
    """Ops per second since the point before in each series."""
    span = F.greatest(F.col(time) - F.col(f"__before.{time}"), F.lit(1e-10))
    return before(points, by, time, [time, ops], chunk).withColumn("rate", (F.col(ops) - F.col(f"__before.{ops}")) / span).drop("__before")


def newest_of_runs(edits: DataFrame) -> DataFrame:
    """One row for each run of equal keys: the newest. Counts down on the map side."""
    return edits.groupBy("key").agg(F.max_by(F.struct("*"), "seq").alias("newest")).select("newest.*")


def sort_edits(edits: DataFrame) -> DataFrame:
    """Edits by key, then newest last, in files that hold ranges of keys."""
    return edits.repartitionByRange("key").sortWithinPartitions("key", "seq")


def out_of_order(df: DataFrame, by: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """(by, n): places in each partition where a key is smaller than the one before; none means sorted."""
    return before(df, by, order, ["key"], chunk).groupBy(by).agg(F.count_if(F.col("__before.key") > F.col("key")).alias("n"))


def first_n(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("key").limit(n)


def drop_first_n(df: DataFrame, n: int) -> DataFrame:
    """All but the first n: the n-th key is found by a limited sort, the rest is a filter."""
    last = df.orderBy("key").limit(n).agg(F.max("key").alias("__last"))
    return df.join(F.broadcast(last), how="cross").where(F.col("__last").isNull() | (F.col("key") > F.col("__last"))).drop("__last")


def levels_after(batches: int) -> list[int]:
    """Which buffer levels hold batches after so many inserts under binary-counter merging: the set bits."""
    return [k for k in range(batches.bit_length()) if batches >> k & 1]


def level_of(batch: Column, n_batches: Column) -> Column:
    """The level that holds a batch (from 0) once n were inserted: the highest bit in which batch and n differ below the
    prefix they share."""
    return F.floor(F.log2(batch.bitwiseXOR(n_batches).cast("double"))).cast("int")
