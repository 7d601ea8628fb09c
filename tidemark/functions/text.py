"""Flags and numbers from loosely written text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_token(text: Column, token: str) -> Column:
    """True where text holds token; null text is false."""
    return F.coalesce(F.contains(text, F.lit(token)), F.lit(False))


def minutes_played(text: Column) -> Column:
    """Minutes as a double from "MM:SS" or "MM"; null where there is no number of minutes."""
    minutes = F.split_part(text, F.lit(":"), F.lit(1)).try_cast("double")
    seconds = F.coalesce(F.split_part(text, F.lit(":"), F.lit(2)).try_cast("double"), F.lit(0.0))
    return minutes + seconds / 60
