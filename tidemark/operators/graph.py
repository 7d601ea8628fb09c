"""Vertices and edges from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedupe import keep_first


def _properties(properties: dict[str, Column]) -> Column:
    return F.create_map(*[x for n, c in properties.items() for x in (F.lit(n), c.cast("string"))])


def vertices(rows: DataFrame, identifier: str, kind: str, properties: dict[str, Column], order_by: Sequence[Column], descending: bool = False) -> DataFrame:
    """One vertex for each identifier; order_by says which of repeated rows describes it."""
    return keep_first(rows, [identifier], order_by, descending).select(F.col(identifier).alias("identifier"), F.lit(kind).alias("type"), _properties(properties).alias("properties"))


def edges(rows: DataFrame, subject: tuple[str, str], obj: tuple[str, str], edge: str, properties: dict[str, Column], order_by: Sequence[Column], descending: bool = False) -> DataFrame:
    """One edge for each (subject, object)."""
    return keep_first(rows, [subject[0], obj[0]], order_by, descending).select(
        F.col(subject[0]).alias("subject_id"), F.lit(subject[1]).alias("subject_type"), F.col(obj[0]).alias("object_id"), F.lit(obj[1]).alias("object_type"), F.lit(edge).alias("edge_type"), _properties(properties).alias("properties")
    )


#: Participants of an event up to which it is one block.
BLOCK = 1000


def block_pairs(rows: DataFrame, event: str, who: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """rows twice, each with the columns low and high: two blocks of participants of the event. Rows of the first lie in
    the block low, rows of the second in the block high, so that joined on event, low and high each two participants meet
    in one place: of an event of n participants in (n / block)**2 / 2 places of about block**2 pairs each. Participants
    are dealt by hash; an event within one block has the blocks 0 and 0, and its rows are not repeated."""
    large = rows.groupBy(event).count().where(F.col("count") > block).select(F.col(event).alias("large_event"), F.ceil(F.col("count") / block).alias("blocks"))
    wide = rows.join(large, F.col(event) == F.col("large_event"), "left").drop("large_event")
    n = F.coalesce("blocks", F.lit(1)).cast("int")
    own = wide.withColumns({"own": F.pmod(F.xxhash64(who), n).cast("int"), "last": n - 1}).drop("blocks")
    first = own.withColumn("high", F.explode(F.sequence("own", "last"))).withColumnRenamed("own", "low").drop("last")
    second = own.withColumn("low", F.explode(F.sequence(F.lit(0), "own"))).withColumnRenamed("own", "high").drop("last")
    return first, second


def co_occurrence(rows: DataFrame, event: str, who: str, side: str, points: str, together: str = "shares_team", against: str = "plays_against", block: int = BLOCK) -> DataFrame:
    """Pairs that met in an event, the larger id as subject: how often, on one side or against each other, and
    both sums of points. rows has one row per event and participant; an unknown side counts as against. An event of
    n participants gives n (n - 1) / 2 pairs, which is what is asked for; very large events are joined by pairs of blocks (see
    block_pairs), and pairs combine to one row a pair of ids before the shuffle of the sums."""
    need = rows.where(F.col(event).isNotNull()).select(F.col(event).alias("event"), F.col(who).alias("id"), F.col(side).alias("side"), F.col(points).alias("points"))
    first, second = block_pairs(need, "event", "id", block)
    a = first.select("event", "low", "high", F.col("id").alias("a"), F.col("side").alias("sa"), F.col("points").alias("pa"))
    b = second.select("event", "low", "high", F.col("id").alias("b"), F.col("side").alias("sb"), F.col("points").alias("pb"))
    # Within a block the larger one comes first; of two blocks either may hold it.
    met = a.join(b, ["event", "low", "high"]).where((F.col("a") > F.col("b")) | ((F.col("low") < F.col("high")) & (F.col("a") < F.col("b"))))
    larger = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(larger, F.col(x)).otherwise(F.col(y))
    kind = F.when(F.col("sa") == F.col("sb"), together).otherwise(against)
    return (
        met.groupBy(F.greatest("a", "b").alias("subject_id"), F.least("a", "b").alias("object_id"), kind.alias("edge_type"))
        .agg(F.count("*").alias("games"), F.sum(pick("pa", "pb")).alias("subject_points"), F.sum(pick("pb", "pa")).alias("object_points"))
    )


def property_ratio(edges_: DataFrame, vertices_: DataFrame, kind: str, top: str, bottom: str) -> DataFrame:
    """Ratio of two properties of the vertex at each edge's subject; a zero or missing bottom gives null."""
    v = vertices_.where(F.col("type") == kind).select(F.col("identifier").alias("subject_id"), "properties")
    number = lambda k: F.element_at("v", k).try_cast("double")
    return edges_.join(v.withColumnRenamed("properties", "v"), "subject_id").select("subject_id", "object_id", "edge_type", F.try_divide(number(top), number(bottom)).alias("ratio"))
