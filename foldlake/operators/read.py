"""Reads: get, batched get, missing keys, scans, cursors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A probe side of at most so many rows is broadcast; its size is counted first.
BROADCAST_ROWS = 100_000


def get(items: DataFrame, key: str) -> DataFrame:
    """The item of one key; no row where it is not found. The equality reaches the scan below the fold."""
    return items.where(F.col("key") == key)


def _small(probes: DataFrame) -> DataFrame:
    keys = probes.select("key").distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(keys) if few else keys


def multi_get(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Items of all probe keys, one row each. A probe side of checked size is broadcast, a larger one is shuffled."""
    return items.join(_small(probes), "key", "left_semi")


def missing(probes: DataFrame, items: DataFrame) -> DataFrame:
    """Probe keys without an item."""
    return probes.select("key").distinct().join(items.select("key"), "key", "left_anti")


def scan(items: DataFrame, min_key: str, n: int) -> DataFrame:
    """The first n items with keys from min_key on, in key order."""
    return items.where(F.col("key") >= min_key).orderBy("key").limit(n)


def scan_keys(edits: DataFrame, min_key: str, n: int) -> DataFrame:
    """The first n distinct keys from min_key on; values are neither read nor folded."""
    return edits.select("key").where(F.col("key") >= min_key).distinct().orderBy("key").limit(n)


def page_after(items: DataFrame, last_key: str, n: int) -> DataFrame:
    """The page that follows ``last_key``."""
    return items.where(F.col("key") > last_key).orderBy("key").limit(n)


class Cursor:
    """A forward cursor in key order: fetches pages of ``page`` rows as needed, so the driver holds one page."""

    def __init__(self, items: DataFrame, min_key: str = "", page: int = 1000, keys_only: bool = False):
        self._items, self._page, self._keys_only = items, page, keys_only
        self._ahead: list[Row] = self._fetch(self._items.where(F.col("key") >= min_key))

    def _fetch(self, df: DataFrame) -> list[Row]:
        return (df.select("key") if self._keys_only else df).orderBy("key").limit(self._page).collect()[::-1]

    def set_keys_only(self, on: bool = True) -> None:
        self._keys_only = on

    def peek(self) -> Row | None:
        return self._ahead[-1] if self._ahead else None

    def next(self) -> Row | None:
        if not self._ahead:
            return None
        row = self._ahead.pop()
        if not self._ahead:
            self._ahead = self._fetch(self._items.where(F.col("key") > row.key))
        return row

    def read(self, n: int) -> list[Row]:
        return [r for _ in range(n) if (r := self.next()) is not None]

    def read_keys(self, n: int) -> list[str]:
        return [r.key for r in self.read(n)]

    def __iter__(self) -> Iterator[Row]:
        while (r := self.next()) is not None:
            yield r
