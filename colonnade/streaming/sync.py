"""Approximate-time synchronisation of message topics.

Messages of several topics belong together when each is, within a tolerance, the
mutual nearest neighbour of the anchor topic's message; of two equally near ones
the earlier wins.  Time is cut into buckets and a message also goes to a bucket
beside it when it is within two tolerances of the border.  A bucket then knows
all it needs to judge its own anchors, and a busy key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_buckets(msgs: DataFrame, us: str, tol_us: int, width_us: int) -> DataFrame:
    """Adds ``bucket`` (repeating messages near a border) and ``own`` (the bucket it lies in)."""
    if width_us < 4 * tol_us:
        raise ValueError("a bucket must be at least four tolerances wide")
    own = F.floor(F.col(us) / width_us)
    reach = [F.floor((F.col(us) + s) / width_us) for s in (-2 * tol_us, 2 * tol_us)]
    spread = F.sequence(*[r.cast("bigint") for r in reach])
    return msgs.withColumn("bucket", F.explode(spread)).withColumn("own", own.cast("bigint") == F.col("bucket"))


def sync_batch(msgs: DataFrame, keys: list[str], topic: str, us: str, ident: str, anchor: str,
               others: list[str], tol_us: int, width_us: int) -> DataFrame:
    """Matched sets: the anchor's id and time, and per other topic the id of its partner.

    Two passes of running firsts and lasts over one partitioning: first every message
    finds the nearest anchor, then every anchor the nearest message of each topic,
    which brings along whether the choice is mutual.  Linear in the messages.
    """
    w = W.partitionBy(*keys, "bucket").orderBy(us, ident)
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)

    def nearest(what: Column) -> Column:
        """Nearer of the last one before and the first one after; the earlier on a tie."""
        a, b = F.last(what, ignorenulls=True).over(before), F.first(what, ignorenulls=True).over(after)
        gap_a, gap_b = F.col(us) - a["us"], b["us"] - F.col(us)
        return F.when(b.isNull() | (gap_a <= gap_b), a).otherwise(b)

    rows = with_buckets(msgs.select(*keys, topic, us, ident), us, tol_us, width_us)
    me = F.struct(F.col(us).alias("us"), F.col(ident).alias("id"))
    rows = rows.withColumn("_anchor", nearest(F.when(F.col(topic) == anchor, me)))
    known = F.struct(F.col(us).alias("us"), F.col(ident).alias("id"), F.col("_anchor.id").alias("likes"))
    rows = rows.select("*", *[nearest(F.when(F.col(topic) == o, known)).alias(f"_n_{o}") for o in others])
    found = rows.where((F.col(topic) == anchor) & F.col("own"))
    for o in others:
        n = F.col(f"_n_{o}")
        found = found.where((n["likes"] == F.col(ident)) & (F.abs(n["us"] - F.col(us)) <= tol_us))
    return found.select(*keys, F.col(us), F.col(ident).alias(anchor), *[F.col(f"_n_{o}.id").alias(o) for o in others])
