"""Integer arithmetic: wrapping, bit sets, ids, rounding, filter sizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(c: Column) -> Column:
    """A BIGINT brought into the range of a signed 32-bit integer, as overflow would."""
    return (c + F.lit(2147483648)).bitwiseAND(F.lit(4294967295)) - F.lit(2147483648)


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def buffer_size(c: Column) -> Column:
    """Up to 32,768 the next power of two, beyond that the next multiple of 32,768."""
    small = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(c, F.lit(1)).cast("double")))).cast("long")
    return F.when(c <= 32768, small).otherwise(F.ceil(c / 32768) * 32768)


def batch_of(memtable_id: Column) -> Column:
    return F.shiftright(memtable_id, 16)


def memtable_of(batch_id: Column) -> Column:
    return F.shiftleft(batch_id, 16)


def circular_less(a: Column, b: Column, bits: int = 32) -> Column:
    """a before b on a circle of 2 ** bits ids."""
    ahead = F.pmod(b - a, F.lit(1 << bits))
    return (ahead > 0) & (ahead < (1 << (bits - 1)))


def slot_locator(block: Column, slot: Column) -> Column:
    return F.shiftleft(block, 16).bitwiseOR(slot)


def locator_block(locator: Column) -> Column:
    return F.shiftright(locator, 16)


def locator_slot(locator: Column) -> Column:
    return locator.bitwiseAND(F.lit(65535))


def bit_test(bits: Column, i: int) -> Column:
    return F.shiftright(bits, i).bitwiseAND(F.lit(1)).cast("int")


def bit_set(bits: Column, i: int) -> Column:
    return bits.bitwiseOR(F.lit(1 << i))


def first_bit(bits: Column) -> Column:
    """The lowest set bit's place; -1 if there is none."""
    return F.when(bits == 0, F.lit(-1)).otherwise(F.bit_count(bits.bitwiseAND(-bits) - 1))


def bit_rank(bits: Column, i: int) -> Column:
    """How many bits are set below place i."""
    return F.bit_count(bits.bitwiseAND(F.lit((1 << i) - 1)))


def filter_tag_bits(bits_per_key: Column) -> Column:
    """Width of a quotient filter's tags: 16 bits if they fit in the budget at a load factor of 0.85, else 8."""
    return F.when(F.lit(18.0) / bits_per_key <= 0.85, 16).otherwise(8)


def filter_load_factor(bits_per_key: Column) -> Column:
    """The planned load factor, 0.85 at most; budgets under 12 bits count as 12."""
    bits = F.greatest(bits_per_key, F.lit(12)).cast("double")
    return F.least(F.lit(0.85), F.when(filter_tag_bits(bits) == 16, F.lit(18.0) / bits).otherwise(F.lit(10.2) / bits))
