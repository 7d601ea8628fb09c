"""Ordered classes from thresholds and patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(value: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first threshold that value exceeds; bands run from high to low. Null gives null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for threshold, label in bands:
        out = out.when(value > threshold, label)
    return out.otherwise(otherwise)


def rank_of(label: Column, worst_to_best: Sequence[str]) -> Column:
    """Place of an ordered class, from 1; 0 for an unknown or null one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, worst_to_best)), label), F.lit(0)).cast("int")


def first_like(value: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The label of the first LIKE pattern that value matches, else value itself."""
    out = F.when(F.lit(False), value)
    for pattern, label in patterns:
        out = out.when(value.like(pattern), label)
    return out.otherwise(value)
