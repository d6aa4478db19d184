"""XXH64 of strings with any seed, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five primes of XXH64, the seed of Spark's function, and the seed of the filters' key hash.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
SPARK_SEED = 42
FILTER_SEED = 0x9D0924DC03E79A75

_ALL = (1 << 64) - 1


def _turn(x: int, by: int) -> int:
    return (x << by | x >> (64 - by)) & _ALL


def _unshift(x: int, by: int) -> int:
    """y where y ^ (y >> by) is x."""
    y = x
    for _ in range(64 // by):
        y = x ^ y >> by
    return y


def number_hashed_to(h: int) -> int:
    """The BIGINT that ``xxhash64`` takes to ``h``: its steps for eight bytes, undone one by one."""
    p1, p2, p3, p4, p5 = PRIMES
    undo = lambda x, prime: x * pow(prime, -1, 1 << 64) & _ALL
    h = undo(_unshift(h, 32), p3)
    h = undo(_unshift(h, 29), p2)
    h = undo(_unshift(h, 33) - p4, p1)
    h = _turn(h, 64 - 27) ^ (SPARK_SEED + p5 + 8 & _ALL)
    n = undo(_turn(undo(h, p1), 64 - 31), p2)
    return n - (1 << 64) if n >> 63 else n


def xxh64(c: Column, seed: int) -> Column:
    """XXH64 with ``seed``. Spark hashes several columns one after another, each with the hash so far as its seed, so a
    number in front that hashes to ``seed`` sets it."""
    return F.xxhash64(F.lit(number_hashed_to(seed & _ALL)), c)


def filter_hash(key: Column) -> Column:
    """The hash by which filters place a key."""
    return xxh64(key, FILTER_SEED)


def index_hash(key: Column) -> Column:
    """The hash of an index in memory: only its spread matters; the lowest bit is always set."""
    return F.xxhash64(key).bitwiseOR(F.lit(1))
