"""Values and keys: encoding, packing, separators, hashes, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def user_key(c: Column) -> Column:
    """'user' and 20 digits: text keys sort as their numbers."""
    return F.concat(F.lit("user"), F.lpad(c.cast("string"), 20, "0"))


def sequential_text(c: Column, size: int) -> Column:
    """The value after ``c`` + 1 turns of an odometer of ``size`` places: digits '_', 'a' to 'z', the first place fastest."""
    digit = lambda k: F.call_function("div", c.cast("long") + 1, F.lit(27**k)) % 27 + 1
    places = [F.substring(F.lit("_abcdefghijklmnopqrstuvwxyz"), digit(k).cast("int"), F.lit(1)) for k in range(min(size, 13))]
    return F.rpad(F.concat(*places), size, "_")


def random_key(c: Column, seed: int = 0, size: int = 24) -> Column:
    """'user' and digits that a hash of ``c`` and ``seed`` gives; ``size`` characters in all, 22 digits at most."""
    digits = F.concat(*[F.lpad(F.pmod(F.xxhash64(c, F.lit(seed * 4 + k)), F.lit(10**11)).cast("string"), 11, "0") for k in range(2)])
    return F.concat(F.lit("user"), F.substring(digits, 1, size - 4))


def from_text(c: Column, op: int = 2) -> Column:
    return F.struct(F.lit(op).alias("op"), F.encode(c, "UTF-8").alias("value"))


def deleted() -> Column:
    return F.struct(F.lit(0).alias("op"), F.unhex(F.lit("")).alias("value"))


def encode_i32(c: Column) -> Column:
    """Four bytes, least significant first."""
    h = F.lpad(F.hex(c.bitwiseAND(F.lit(4294967295))), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def write_i32(c: Column) -> Column:
    return F.struct(F.lit(2).alias("op"), encode_i32(c).alias("value"))


def add_i32(c: Column) -> Column:
    return F.struct(F.lit(3).alias("op"), encode_i32(c).alias("value"))


def as_i32(value: Column) -> Column:
    """Bytes as a signed little-endian integer of their length: none is 0, more than four count as the first four."""
    h = F.hex(F.substring(value, 1, 4))
    n = F.least(F.octet_length(value), F.lit(4))
    turned = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    raw = F.coalesce(F.conv(F.nullif(turned, F.lit("")), 16, 10).cast("long"), F.lit(0))
    full = F.element_at(F.array(*[F.lit(1 << (8 * k)) for k in range(5)]), n + 1)
    return F.when(n == 0, F.lit(0)).when(raw >= full / 2, raw - full).otherwise(raw).cast("long")


def pack_tag(op: Column, size: Column, inline: Column) -> Column:
    """Inline flag (bit 63), op (bits 48 to 62) and size (the rest) in one BIGINT."""
    return F.shiftleft(inline.cast("long"), 63).bitwiseOR(F.shiftleft(op.cast("long"), 48)).bitwiseOR(size.cast("long"))


def tag_op(tag: Column) -> Column:
    return F.shiftright(tag, 48).bitwiseAND(F.lit(0x7FFF)).cast("int")


def tag_size(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit((1 << 48) - 1))


def tag_inline(tag: Column) -> Column:
    return tag < 0


def packed_size(key: Column, value: Column) -> Column:
    """Bytes of an edit in a packed leaf: two offsets of four, an op byte, key and value."""
    return F.lit(9) + F.octet_length(key) + F.octet_length(value)


def common_prefix(a: str, b: str) -> str:
    """SQL for the number of leading characters two columns share."""
    return f"coalesce(element_at(filter(sequence(1, greatest(1, least(length({a}), length({b})))), i -> substring({a}, i, 1) <> substring({b}, i, 1)), 1) - 1, least(length({a}), length({b})))"


def separator(a: str, b: str) -> Column:
    """The shortest prefix of column b that sorts after column a (a < b)."""
    return F.expr(f"substring({b}, 1, {common_prefix(a, b)} + 1)")


def in_hash_mask(key: Column, mask: int, want: int = 0) -> Column:
    """Keys whose MD5's first 32 bits fit the mask: a sample that is the same for every table."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(mask)) == want


def hex_literal(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def range_text(lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("["), lo, F.lit(", "), hi, F.lit(")"))
