"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows with this remainder of crc32(id as text) modulo 4 are held out of every training.
HELD_OUT = 2


def held_out(doc_id: str) -> Column:
    """False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


#: Labels that are learnt unless told otherwise: the most frequent ones.
MOST_LABELS = 256


def bounded(rows: DataFrame, label: str, key: str, about: int, most: int = MOST_LABELS) -> DataFrame:
    """About so many rows of each label, or all if there are fewer: those whose hash of key is below the
    label's share. Labels are counted over all rows; of more than most of them the most frequent ones are taken (ties: the
    first by name), however dirty the column is. Nothing reaches the driver: the shares are joined."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.col("count").desc(), label).limit(most)
    shares = counts.select(F.col(label).alias("of_label"), (F.least(F.lit(1.0), F.lit(about) / F.col("count")) * (1 << 30)).cast("long").alias("share"))
    taken = rows.join(F.broadcast(shares), F.col(label) == F.col("of_label"))  # a row a label, so many at most
    return taken.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.col("share")).select(rows.columns)
