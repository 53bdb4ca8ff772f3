"""Unsigned integers and runs of bytes out of BINARY columns, inside code generation.

Offsets count from 0 and may be columns. What lies beyond the end is null, as is anything read from null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Place = Column | int


def col(x: Place) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def run_of(data: Column, at: Place, n: Place) -> Column:
    """n bytes from `at`, or null if there are fewer."""
    return F.when(F.length(data) >= col(at) + col(n), F.substring(data, col(at) + 1, col(n)))


def rest(data: Column, at: Place) -> Column:
    """All bytes from `at`; empty just at the end, null beyond."""
    return F.when(F.length(data) >= col(at), F.substring(data, col(at) + 1, F.length(data)))


def uint(data: Column, at: Place, n: int) -> Column:
    """A big-endian unsigned integer of n bytes, at most 7, as a bigint."""
    return F.conv(F.hex(run_of(data, at, n)), 16, 10).cast("bigint")


def u8(data: Column, at: Place) -> Column:
    return uint(data, at, 1).cast("int")


def u16(data: Column, at: Place) -> Column:
    return uint(data, at, 2).cast("int")


def u32(data: Column, at: Place) -> Column:
    return uint(data, at, 4)


def u16le(data: Column, at: Place) -> Column:
    return u8(data, at) + u8(data, col(at) + 1) * 256


def first_of(*cases: tuple[Column, Column | str | int], otherwise: Column | str | int | None = None) -> Column:
    """The value of the first case whose condition holds."""
    (when, then), *more = cases
    chain = reduce(lambda c, case: c.when(case[0], case[1]), more, F.when(when, then))
    return chain if otherwise is None else chain.otherwise(otherwise)
