"""Contiguous shards of near equal byte size.

The rows are put in a total order, byte sizes are summed up over it by totals per
partition, and the order is cut at equal targets: a row belongs to the shard that
holds the middle of its byte range.  Shards are therefore contiguous, and two shards
differ in size by about one row.

* A null text has no bytes; every row adds ``overhead`` bytes, so empty rows spread too.
* Null order keys come first; equal keys and repeated rows stand in any order among
  themselves and may fall to different shards.
* A row larger than a shard fills several targets; the shards it passes stay empty.
* An empty table gives no rows.  Columns of any name pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import global_prefix


def byte_size(text: str, overhead: int = 16) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("bigint")


def assign_shards(rows: DataFrame, order_by: Sequence[str], size: Column, shards: int) -> DataFrame:
    """``row`` (the whole input row as a struct), ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Everything in ``rows`` is moved once, so hand over only the columns that are wanted.
    ``size`` must be positive.
    """
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), size.alias("size"))
    placed = global_prefix(packed, [F.col(f"row.`{c}`").asc_nulls_first() for c in order_by], "size")
    cut = placed.withColumn("shard", F.expr(f"((2 * g_before + size) * {shards}) div (2 * g_total)").cast("int"))
    first = cut.groupBy("shard").agg(F.min("g_index").alias("g_first"))
    return (cut.join(F.broadcast(first), "shard")  # one row per shard
            .select("row", "size", "shard", (F.col("g_index") - F.col("g_first")).alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; within its files the rows stand in slot order."""
    out = sharded.select("shard", "slot", "row.*")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
