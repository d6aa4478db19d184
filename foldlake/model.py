"""Data model: edits, items, op codes and options.

An edit is (key, seq, op, i32[, value]): ``seq`` orders the edits of a key and is unique per key, ``i32`` is the value
read as a 32-bit integer (never null), ``value`` the raw bytes or text where a payload is read back. The fold of a key's
edits is its current value; after decay (deletes and no-ops dropped) it is an item.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

DELETE, NOOP, WRITE, ADD, PAGE_SLICE = range(5)
OP_NAMES = {DELETE: "delete", NOOP: "noop", WRITE: "write", ADD: "add_i32", PAGE_SLICE: "page_slice"}
#: Ops that make an item.
ITEM_OPS = (WRITE, ADD, PAGE_SLICE)
#: Ops over which folding in parts equals folding at once.
ASSOCIATIVE_OPS = (DELETE, WRITE, ADD)

EDIT_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("i32", T.LongType(), False),
        T.StructField("value", T.StringType(), True),
    ]
)


@dataclass(frozen=True)
class StoreOptions:
    """Of a store. ``chi`` batches are folded into one checkpoint; ``retain`` snapshots are kept.

    Policy "levelled" merges deltas as a binary counter carries; "tiered" stacks them until a checkpoint; "pivot" moves the
    key range with the most waiting bytes down into the snapshot as soon as it has ``min_flush``. What a commit replaces
    stays readable for ``grace`` further states.
    """

    chi: int = 1
    retain: int = 2
    policy: str = "levelled"
    bloom: bool = True
    max_records_per_file: int = 5_000_000
    min_flush: int = 64 << 20
    grace: int = 4

    def __post_init__(self):
        if self.chi < 1:
            raise ValueError("chi must be 1 or more")
        if self.policy not in ("levelled", "tiered", "pivot"):
            raise ValueError(f"unknown policy {self.policy}")

    @classmethod
    def from_conf(cls, conf, prefix: str = "foldlake.store.") -> "StoreOptions":
        """Options from a session's settings (``spark.conf``): prefix and an option's name, typed as its default."""
        found = {}
        for f in fields(cls):
            if (text := conf.get(prefix + f.name, None)) is not None:
                kind = type(f.default)
                found[f.name] = text.lower() in ("true", "1", "yes", "on") if kind is bool else kind(text)
        return cls(**found)


@dataclass(frozen=True)
class TreeOptions:
    """Size arithmetic of leaves and nodes, kept as plain numbers for layout planning."""

    node_size: int = 4096
    leaf_size: int = 2 << 20
    key_size_hint: int = 24
    value_size_hint: int = 100
    filter_bits_per_key: int = 12
    extras: dict = field(default_factory=dict)

    @property
    def max_item_size(self) -> int:
        return self.node_size // 7

    @property
    def item_size_hint(self) -> int:
        return 9 + self.key_size_hint + self.value_size_hint

    @property
    def flush_size(self) -> int:
        return self.leaf_size - self.trie_reserve

    @property
    def expected_items(self) -> int:
        return self.leaf_size // self.item_size_hint

    @property
    def trie_reserve(self) -> int:
        n, k = self.expected_items, self.key_size_hint
        return (-(-n * k // 16)) * 5 // 8 if k > 16 else (-(-n * k // 8)) * 3 // 4

    def filter_page_bytes(self) -> int:
        from .functions.numbers import next_power_of_two

        return next_power_of_two(-(-self.expected_items * self.filter_bits_per_key // 8))
