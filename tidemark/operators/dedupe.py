"""One row per key, by a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rank_of


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], descending: bool = False) -> DataFrame:
    """The first row of each key by order_by (descending: the last), completed by the columns that are not keys, so the
    survivor never depends on how rows are dealt. Rows combine before the shuffle, and a value travels once: columns that
    can be ordered are the order and the row in one. Nulls are lowest. Select what is needed beforehand."""
    rest = [c for c in df.columns if c not in keys]
    order = [c.alias(f"o{i}") for i, c in enumerate(order_by)]
    pick = F.max if descending else F.min
    if all(_sortable(df, c) for c in rest):
        row = pick(F.struct(*order, *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])).alias("x")
        back = {c: F.col(f"x.r{i}") for i, c in enumerate(rest)}
    else:
        by = F.max_by if descending else F.min_by
        row = by(F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)]), F.struct(*order, *[F.col(c) for c in rest if _sortable(df, c)])).alias("x")
        back = {c: F.col(f"x.r{i}") for i, c in enumerate(rest)}
    return df.groupBy(*keys).agg(row).select(*[back[c].alias(c) if c in back else F.col(c) for c in df.columns])


def _sortable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def distinct_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def best_class(df: DataFrame, keys: Sequence[str], label: str, worst_to_best: Sequence[str], name: str = "best_class") -> DataFrame:
    """The best class of each key by an explicit rank, not by the label's spelling."""
    return df.groupBy(*keys).agg(F.max_by(label, rank_of(F.col(label), worst_to_best)).alias(name))
