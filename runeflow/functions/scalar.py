"""Byte-string, character-class, number, bit and hash functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
# Fixed values of the hash's definition.
FNV32_BASIS, FNV32_PRIME = 2166136261, 16777619
FNV64_BASIS, FNV64_PRIME_LOW = 14695981039346656037, 435


def octets(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("bigint"))


def fnv1a_32(text: Column, fold_case: bool = False) -> Column:
    return F.aggregate(octets(F.lower(text) if fold_case else text), F.lit(FNV32_BASIS).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(F.lit(MASK32)))


def fnv1a_64(text: Column) -> Column:
    """As 16 hexadecimal digits. The product with 2**40 + 435 is taken on two halves, which don't overflow."""
    start = F.struct(F.lit(FNV64_BASIS >> 32).cast("bigint").alias("high"), F.lit(FNV64_BASIS & MASK32).cast("bigint").alias("low"))

    def step(h, b):
        low = h["low"].bitwiseXOR(b)
        product = low * FNV64_PRIME_LOW
        high = (h["high"] * FNV64_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(MASK32))
        return F.struct(high.alias("high"), product.bitwiseAND(F.lit(MASK32)).alias("low"))

    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(octets(text), start, step, lambda h: F.concat(half(h["high"]), half(h["low"])))


def multiply32(a: Column, k: int) -> Column:
    """a * k mod 2**32 for a below 2**32, in halves that don't overflow."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * k
    high = F.shiftleft((F.shiftright(a, 16) * k).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(MASK32))


def fmix32(h: Column) -> Column:
    """The 32-bit finaliser of murmur3."""
    h = h.bitwiseAND(F.lit(MASK32))
    h = multiply32(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = multiply32(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.char_length(F.bin((n - 1).cast("bigint")))))


def bit_field(x: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(x.cast("bigint"), start).bitwiseAND(F.lit((1 << width) - 1))


def set_bit_field(x: Column, start: int, width: int, new: Column) -> Column:
    mask = ((1 << width) - 1) << start
    return x.cast("bigint").bitwiseAND(F.bitwise_not(F.lit(mask).cast("bigint"))).bitwiseOR(F.shiftleft(new.cast("bigint").bitwiseAND(F.lit((1 << width) - 1)), start))


def swap32(x: Column) -> Column:
    x = x.cast("bigint")
    return F.shiftleft(bit_field(x, 0, 8), 24).bitwiseOR(F.shiftleft(bit_field(x, 8, 8), 16)).bitwiseOR(F.shiftleft(bit_field(x, 16, 8), 8)).bitwiseOR(bit_field(x, 24, 8))


def rotate_left32(x: Column, n: int) -> Column:
    x = x.cast("bigint").bitwiseAND(F.lit(MASK32))
    return F.shiftleft(x, n).bitwiseAND(F.lit(MASK32)).bitwiseOR(F.shiftright(x, 32 - n))


def rotate_right32(x: Column, n: int) -> Column:
    return rotate_left32(x, 32 - n)


def parse_hex(text: Column) -> Column:
    return F.conv(F.regexp_extract(text, "^(?:0[xX])?([0-9A-Fa-f]{1,15})", 1), 16, 10).cast("bigint")


def fixed_16_16(x: Column) -> Column:
    return x.cast("double") / 65536.0


def fixed_2_14(x: Column) -> Column:
    return x.cast("double") / 16384.0


def trim_quotes(text: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(text, "^([\"'])(.*)\\1$", "$2")


def integer_prefix(text: Column) -> Column:
    return F.regexp_extract(text, "^[ \\t]*([+-]?[0-9]{1,18})", 1).try_cast("bigint")


def number_prefix(text: Column) -> Column:
    return F.regexp_extract(text, "^[ \\t]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def number_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def parameters(text: Column, pair: str = ";", key: str = ":") -> Column:
    return F.str_to_map(text, F.lit(pair), F.lit(key))


def all_in(text: Column, cls: str) -> Column:
    return text.rlike(f"^[{cls}]*$")


def count_in(text: Column, cls: str) -> Column:
    """Characters of a class, written as in a regular expression."""
    return F.regexp_count(text, F.lit(f"[{cls}]"))


def read_until(text: Column, delimiter: str) -> Column:
    return F.substring_index(text, delimiter, 1)


def read_while(text: Column, cls: str) -> Column:
    return F.regexp_extract(text, f"^[{cls}]*", 0)


def read_quoted(text: Column) -> Column:
    """The inside of a leading quoted token, in which a backslash keeps the next character."""
    return F.regexp_extract(text, "^\"((?:[^\"\\\\]|\\\\.)*)\"", 1)


def find_first_of(text: Column, cls: str) -> Column:
    """Position, from 0, of the first character of the class; -1 without one."""
    return F.regexp_instr(text, F.lit(f"[{cls}]")) - 1


def identifier(text: Column) -> Column:
    return F.regexp_extract(text, "^[A-Za-z_][A-Za-z0-9_]*", 0)


def boolean(text: Column) -> Column:
    """1, true, yes and on, in any case, are true; 0, false, no and off false; all else is null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False)


def arithmetic_shift32(x: Column, n: int) -> Column:
    """The signed 32-bit value moved right, its sign kept."""
    x = x.cast("bigint").bitwiseAND(F.lit(MASK32))
    return F.shiftright(F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x), n)


def rotate_left64(x: Column, n: int) -> Column:
    x = x.cast("bigint")
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n % 64 else x


def rotate_right64(x: Column, n: int) -> Column:
    return rotate_left64(x, (64 - n) % 64)


def bits_from_bytes(data: Column, start: int, width: int) -> Column:
    """``width`` bits of a byte string from bit ``start`` on, the least of each byte first; at most 56 bits."""
    first, last = start // 8, (start + width - 1) // 8
    word = F.lit(0).cast("bigint")
    for k in range(first, last + 1):
        byte = F.conv(F.hex(F.substring(data, k + 1, 1)), 16, 10).cast("bigint")
        word = word.bitwiseOR(F.shiftleft(F.coalesce(byte, F.lit(0).cast("bigint")), 8 * (k - first)))
    return F.shiftright(word, start % 8).bitwiseAND(F.lit((1 << width) - 1))


def read_enclosed(text: Column, opening: str, closing: str) -> Column:
    """What stands between a leading opening mark and the first closing one; null without both."""
    rest = F.substring(text, len(opening) + 1, 1 << 30)
    return F.when(text.startswith(opening) & (F.instr(rest, closing) > 0), F.substring_index(rest, closing, 1))


def read_until_unquoted(text: Column, delimiter: str) -> Column:
    """What stands before the first delimiter outside double quotes; a backslash keeps the next character."""
    return F.regexp_extract(text, f'^(?:"(?:[^"\\\\]|\\\\.)*"|[^"{delimiter}])*', 0)
