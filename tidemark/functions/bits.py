"""Active days as 32 bits in a bigint; the top bit is bit 31."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32


def bit_of_day(back: Column) -> Column:
    """The bit of a place 0 to 31, counted from the top; elsewhere no bit."""
    return F.when(back.between(0, BITS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(BITS - 1) - back).cast("int"))).otherwise(F.lit(0).cast("long"))


def bits_of_days(days: Column, as_of: Column) -> Column:
    """Top bit: as_of; each lower bit one day earlier. Days after as_of or before the 32 days count nothing."""
    return F.aggregate(days, F.lit(0).cast("long"), lambda acc, d: acc.bitwiseOR(bit_of_day(F.datediff(as_of, d))))


def month_bits(days: Column, month_start: Column) -> Column:
    """Top bit: the first day of the month; days of other months count nothing."""
    inside = F.filter(days, lambda d: F.trunc(d, "month") == month_start)
    return F.aggregate(inside, F.lit(0).cast("long"), lambda acc, d: acc.bitwiseOR(bit_of_day(F.dayofmonth(d) - 1)))


def days_ago_mask(first: int, last: int) -> int:
    """Mask of the days from first to last before the top bit, both included."""
    return sum(1 << (BITS - 1 - d) for d in range(first, last + 1))


def bits_text(bits: Column) -> Column:
    return F.lpad(F.bin(bits), BITS, "0")
