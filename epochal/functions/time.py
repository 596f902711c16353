"""Time as whole nanoseconds: conversion to and from seconds, other units and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of each unit that the interface takes.
UNITS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000}
SECOND, MINUTE, HOUR, DAY = 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9


def unit_ns(unit: str) -> int:
    if unit not in UNITS:
        raise ValueError(f"time unit {unit!r} is none of {', '.join(UNITS)}")
    return UNITS[unit]


def to_ns(value: float, unit: str = "s") -> int:
    """A number of ``unit`` as nanoseconds, rounded half to even."""
    return round(float(value) * unit_ns(unit))


def ns_of(column: Column | str, unit: str = "s") -> Column:
    """A numeric column of ``unit`` as BIGINT nanoseconds, rounded half to even at nine decimals of a second."""
    return F.bround(F.col(column) * F.lit(unit_ns(unit)) if isinstance(column, str) else column * F.lit(unit_ns(unit)), 0).cast("bigint")


def ns_of_timestamp(column: Column | str) -> Column:
    """A TIMESTAMP or TIMESTAMP_NTZ column as BIGINT nanoseconds since 1970, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp")) * F.lit(1000)


def in_unit(column: Column | str, unit: str = "s") -> Column:
    """Nanoseconds in ``unit``; microseconds come as whole numbers."""
    c = F.col(column) if isinstance(column, str) else column
    return (c / F.lit(1000)).cast("bigint") if unit == "us" else c / F.lit(float(unit_ns(unit)))
