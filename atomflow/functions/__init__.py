"""Column functions."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_hash(text: Column) -> Column:
    """The 32-bit hash that a JVM gives a string of ASCII characters: s[0]*31^(n-1) + ... + s[n-1]."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(total >= 2**31, total - 2**32).otherwise(total).cast("int")


def hash_code(value) -> int | None:
    """The 32-bit hash that a JVM gives a value: text, integer, float or boolean; a 32-bit integer is its own. None for all others."""
    if isinstance(value, bool):
        return 1231 if value else 1237
    if isinstance(value, float):
        bits = struct.unpack(">q", struct.pack(">d", value))[0] & (1 << 64) - 1
        total = bits ^ bits >> 32
    elif isinstance(value, int):
        total = value if -(2**31) <= value < 2**31 else (value & (1 << 64) - 1) ^ (value & (1 << 64) - 1) >> 32
    elif isinstance(value, str):
        units = value.encode("utf-16-be")
        total = 0
        for at in range(0, len(units), 2):
            total = total * 31 + (units[at] << 8 | units[at + 1]) & 0xFFFFFFFF
    else:
        return None
    total &= 0xFFFFFFFF
    return total - 2**32 if total >= 2**31 else total


def sampled(by: Column, one_in: int) -> Column:
    """True for one in so many rows, the same ones each time: those whose number is divisible by it after mixing.

    The mix is integer arithmetic that other engines share.
    """
    return mixed(by) % one_in == 0


def mixed(number: Column) -> Column:
    """An integer below 2147483647 that orders non-negative numbers as if by chance."""
    return (number % 2147483647 * 48271 + 11) % 2147483647


def cents(value: Column) -> Column:
    """An amount as an exact integer, for sums that don't depend on their order."""
    return F.round(value * 100).cast("bigint")
