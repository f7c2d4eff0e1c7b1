"""Integer hash families that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_modulo(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of ``text`` read as one big-endian integer, modulo ``modulus``: a Horner fold, so any length is exact."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"))
    codes = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: (a * 256 + x) % modulus)


def trailing_zeros(value: Column) -> Column:
    """Zeros at the end of the binary form; 3 for zero, whose form holds no one."""
    return F.when(value == 0, 3).otherwise(F.bit_count(value.bitwiseAND(-value) - 1))


def shift_hash(x: Column, step: int, c: Column, modulus: Column) -> Column:
    return (x + step * c) % modulus
