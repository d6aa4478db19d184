"""The fold of a key's edits, and decay.

Newest first: an edit that is not an ADD decides alone; an ADD over a WRITE is a WRITE of the sum, over a DELETE a WRITE of
what was added, over an ADD an ADD of the sum, and passes over NOOP and PAGE_SLICE. Sums wrap to 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import wrap32
from ..model import ADD, ASSOCIATIVE_OPS, ITEM_OPS

#: Edits of one key are folded in chunks of so many sequence numbers first, so that a hot key is no single task's work.
CHUNK = 1 << 22


def _fold(edits: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of ``by``: op, i32 and the newest seq. Window and grouping share one exchange."""
    bar = F.max(F.when(F.col("op").isin(0, 2), F.col("seq"))).over(Window.partitionBy(*by))
    payload = [F.max_by("value", "seq").alias("value")] if "value" in edits.columns else []
    at_bar = F.col("seq") == F.col("bar")
    adds = F.sum(F.when((F.col("op") == ADD) & (F.col("bar").isNull() | (F.col("seq") > F.col("bar"))), F.col("i32")).otherwise(0))
    # numbers only, so that they aggregate by hash
    g = edits.withColumn("bar", bar).groupBy(*by).agg(
        F.max_by("op", "seq").alias("op"), F.max_by("i32", "seq").alias("v"), F.max("seq").alias("seq"), adds.alias("adds"), F.max(F.when(at_bar, F.col("op"))).alias("bar_op"), F.max(F.when(at_bar, F.col("i32"))).alias("bar_v"), *payload
    )
    op = F.when(F.col("op") != ADD, F.col("op")).when(F.col("bar_op").isNull(), ADD).otherwise(2)
    v = F.when(F.col("op") != ADD, F.col("v")).when(F.col("bar_op") == 2, F.col("adds") + F.col("bar_v")).otherwise(F.col("adds"))
    kept = [F.when(F.col("op") != ADD, F.col("value")).alias("value")] if payload else []
    return g.select(*by, op.cast("int").alias("op"), wrap32(v).alias("i32"), "seq", *kept)


def fold(edits: DataFrame, chunk: int | None = CHUNK, full_history: bool = False) -> DataFrame:
    """(key, op, i32, seq[, value]) for each key; the result can be folded again with newer or older edits.

    A WRITE's payload stays with it where no ADD came after.
    Chunks of sequence numbers keep the fold's order, so folding them first changes nothing for DELETE, WRITE and ADD.
    Edits with NOOP or PAGE_SLICE need ``full_history``, which folds at once.
    """
    if full_history or chunk is None:
        return _fold(edits, ["key"])
    parts = _fold(edits.withColumn("part", F.expr(f"seq div {chunk}")), ["key", "part"])
    return _fold(parts.drop("part"), ["key"])


def latest(edits: DataFrame, columns: tuple[str, ...] = ("op", "i32")) -> DataFrame:
    """The newest edit of each key: the fold where no ADD occurs. Counts down on the map side."""
    return edits.groupBy("key").agg(F.max_by(F.struct(*columns), "seq").alias("v"), F.max("seq").alias("seq")).select("key", *[F.col(f"v.{c}").alias(c) for c in columns], "seq")


def decay(edits: DataFrame) -> DataFrame:
    """Items of folded edits. Only over a fold of the whole history: above it, deletes must stay."""
    return edits.where(F.col("op").isin(*ITEM_OPS))


def items(edits: DataFrame, has_adds: bool = True) -> DataFrame:
    return decay(fold(edits) if has_adds else latest(edits))


def union_tiers(*tiers: DataFrame) -> DataFrame:
    """Active edits, deltas and base as one log; newest wins by seq."""
    return reduce(lambda a, b: a.unionByName(b), tiers)


def needs_combine(edits: DataFrame) -> DataFrame:
    return edits.where(F.col("op") == ADD)


# --- merge operators of the user's own

_REGISTRY: dict[int, Callable] = {}


def register_merge(op: int, aggregate: Callable) -> None:
    """``aggregate`` (a column of values -> an aggregate column) merges the edits of ``op``; it must be associative and
    commutative, as parts of a key's edits are merged in any order. Codes 0 to 4 are taken."""
    if op in range(5):
        raise ValueError(f"op {op} is built in")
    _REGISTRY[op] = aggregate


def fold_registered(edits: DataFrame, op: int) -> DataFrame:
    """(key, i32) over the edits with a registered op."""
    return edits.where(F.col("op") == op).groupBy("key").agg(_REGISTRY[op](F.col("i32")).alias("i32"))


def combine(newer: tuple[int, int], older: tuple[int, int]) -> tuple[int, int]:
    """Two edits (op, i32) of one key, for models and tests."""
    if newer[0] != ADD:
        return newer
    wrap = lambda v: (v + 2**31 & 0xFFFFFFFF) - 2**31
    if older[0] == 2:
        return 2, wrap(newer[1] + older[1])
    if older[0] == 0:
        return 2, newer[1]
    if older[0] == ADD:
        return ADD, wrap(newer[1] + older[1])
    return newer


assert set(ASSOCIATIVE_OPS) == {0, 2, 3}
