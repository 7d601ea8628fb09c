"""Column expressions that the jobs share."""

from tidemark.functions.bits import bit_of_day, bits_of_days, bits_text, days_ago_mask, month_bits
from tidemark.functions.classes import banded, first_like, rank_of
from tidemark.functions.text import has_token, minutes_played

__all__ = ["banded", "bit_of_day", "bits_of_days", "bits_text", "days_ago_mask", "first_like", "has_token", "minutes_played", "month_bits", "rank_of"]
