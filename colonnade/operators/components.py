"""Connected components by randomised contraction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.session import cut_lineage, dealt

#: Rows of a late round that a task and its files are worth.
PACK_ROWS = 1 << 16


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows in no more tasks than these are worth: every task leaves files in the table and in the next shuffle."""
    return df.coalesce(max(1, math.ceil(rows / PACK_ROWS)))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(``v``, ``root``): the smallest vertex of every component.

    Each round every vertex of the graph goes over to the one of itself and its neighbours
    that comes first in an order drawn anew by hashing, and the edges between those are the
    graph of the next round.  At least a third of the vertices is expected to go whatever
    the graph looks like, so all rounds together read and write a few times the edges,
    however long the chains are, and late rounds run in as few tasks as they have edges for.
    The way of a vertex through the rounds is joined together from the last, smallest round
    back to the first.
    """
    left = cut_lineage(edges.where("a <> b").select(*_ordered(F.col("a"), F.col("b"))).distinct())
    rounds, ends_of = [], []
    while count := left.count():
        def drawn(c: str, k: int = len(rounds)) -> Column:
            return F.xxhash64(F.lit(k), c)

        left = _packed(left, count)
        ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
        first = left.select(F.inline(ends)).groupBy("v").agg(F.min_by("w", drawn("w")).alias("w"), F.min(drawn("w")).alias("h"))
        goes = cut_lineage(_packed(first.select("v", F.when(drawn("v") <= F.col("h"), F.col("v")).otherwise(F.col("w")).alias("to")), 2 * count))
        rounds.append(goes)
        ends_of.append(2 * count)
        half = _packed(left.join(dealt(goes.select(F.col("v").alias("a"), F.col("to").alias("_a"))), "a"), count)
        moved = _packed(half.join(dealt(goes.select(F.col("v").alias("b"), F.col("to").alias("_b"))), "b").where("_a <> _b"), count)
        left = cut_lineage(_packed(moved.select(*_ordered(F.col("_a"), F.col("_b"))).distinct(), count))
    if not rounds:
        return vertices.select("v", F.col("v").alias("root"))
    ended = rounds[-1]
    for goes, rows in zip(rounds[-2::-1], ends_of[-2::-1]):
        later = ended.select(F.col("v").alias("to"), F.col("to").alias("_later"))
        ended = _packed(goes.join(dealt(later), "to", "left").select("v", F.coalesce("_later", "to").alias("to")), rows)
    ended = cut_lineage(ended)
    named = ended.join(dealt(ended.groupBy("to").agg(F.min("v").alias("root"))), "to").select("v", "root")
    return cut_lineage(vertices.join(dealt(named), "v", "left").select("v", F.coalesce("root", "v").alias("root")))
