"""Scalar functions: rotation, prefixes, unsigned parsing, differences, the partition function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate(text: Column, by: Column) -> Column:
    """The text rotated left by so many characters."""
    n = F.pmod(by, F.greatest(F.length(text), F.lit(1)))
    return F.concat(F.substring(text, n + 1, F.length(text)), F.substring(text, F.lit(1), n))


def rotations(text: Column, times: int = 4) -> Column:
    """The text rotated by one to ``times`` quarters (for four) of its length."""
    step = F.floor(F.length(text) / times).cast("int")
    return F.transform(F.sequence(F.lit(1), F.lit(times)), lambda i: rotate(text, i.cast("int") * step))


def half(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))


def unsigned(text: Column) -> Column:
    """An unsigned 64-bit literal: 0x hexadecimal, 0 octal, else decimal; as DECIMAL(20,0), null if malformed."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(low, F.lit(3), F.length(low)), 16, 10))
        .when(low.rlike("^0[0-7]*$"), F.conv(low, 8, 10))
        .when(low.rlike("^[1-9][0-9]*$"), low)
        .cast("decimal(20,0)")
    )


def distance(a: Column, b: Column) -> Column:
    """The absolute difference."""
    return F.abs(a - b)


def bytes_of(text: Column) -> Column:
    """The UTF-8 bytes as numbers 0 to 255."""
    return F.when(F.octet_length(text) > 0, F.transform(F.split(by_byte(text), ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def by_byte(text: Column) -> Column:
    """A text with one character for each UTF-8 byte, of that code."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_sum(text: Column) -> Column:
    """The sum of the bytes, each taken as signed."""
    return F.aggregate(bytes_of(text), F.lit(0).cast("long"), lambda a, b: a + F.when(b > 127, b - 256).otherwise(b))


def partition_of(text: Column, n: int, kind: int = 0) -> Column:
    """The partition of a key: its byte sum, plus 1 on the reduce side, modulo n and never negative."""
    return F.pmod(byte_sum(text) + kind, F.lit(n)).cast("int")
