"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import colonnade
from colonnade.session import cut_lineage

cloudpickle.register_pickle_by_value(colonnade)  # executors need no copy of this package

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A group is hot when it holds more than one row in HOT_SHARE; so there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 64


def cut_text(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, packed tighter: for rows that hold whole texts."""
    return cut_lineage(df, compression="zstd")


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def key_of(column: str) -> Column:
    """A never-null text key, so that nulls form a group of their own in joins."""
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n"))


def bit_field(keys: DataFrame, key: str, log_bits: int = 25) -> np.ndarray:
    """Bits of the last ``log_bits`` digits of all keys (longs, well mixed): of fixed size, however many keys there are.

    It tells a task which rows need not be shuffled; as it fills up fewer are left out, and results stay the same.
    """
    last = F.col(key).bitwiseAND(F.lit((1 << log_bits) - 1))
    cells = keys.select(F.shiftrightunsigned(last, 6).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bits"))
    found = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(1 << (log_bits - 6), np.uint64)
    field[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return field


def in_field(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys the field may hold."""
    last = keys.view(np.uint64) & np.uint64(len(field) * 64 - 1)
    return (field[(last >> np.uint64(6)).astype(np.int64)] >> (last & np.uint64(63)) & np.uint64(1)).astype(bool)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group; groups that hold a large share of the rows are not shuffled.

    Fewer than HOT_SHARE groups can hold more than a HOT_SHARE-th of ``total`` rows, so
    their broadcast has a fixed bound.  All others meet in an ordinary shuffled join.
    """
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    first = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return first.unionByName(rest)


def global_prefix(rows: DataFrame, order: Sequence[Column], size: str) -> DataFrame:
    """Adds ``g_index`` (place in the total order, from 0), ``g_before`` (sum of ``size`` before the row) and ``g_total``.

    The rows are range-partitioned and sorted, so a partition is a block of the order;
    totals per block, one row per partition, are scanned and handed back.  Equal keys
    are told apart by a running number, so a repeated row cannot fill one block.  The
    blocks are written, since sampling the ranges anew could cut them elsewhere.
    """
    tied = rows.withColumn("g_tie", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(*order, F.col("g_tie")).sortWithinPartitions(*order, F.col("g_tie")).drop("g_tie")
    placed = cut_lineage(cut.withColumn("g_block", F.spark_partition_id())
                         .withColumn("g_pos", F.expr("monotonically_increasing_id() & 8589934591L")))
    blocks = placed.groupBy("g_block").agg(F.count("*").alias("g_n"), F.sum(size).alias("g_sum"))
    before = W.orderBy("g_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(F.col("g_block"), F.coalesce(F.sum("g_n").over(before), F.lit(0)).alias("g_rows0"),
                            F.coalesce(F.sum("g_sum").over(before), F.lit(0)).alias("g_sum0"),
                            F.sum("g_sum").over(W.partitionBy()).alias("g_total"))
    inside = W.partitionBy("g_block").orderBy("g_pos").rowsBetween(W.unboundedPreceding, -1)
    scanned = placed.withColumn("g_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (scanned.join(F.broadcast(offsets), "g_block")
            .withColumn("g_index", F.col("g_rows0") + F.col("g_pos"))
            .withColumn("g_before", F.col("g_sum0") + F.col("g_inside"))
            .drop("g_block", "g_pos", "g_inside", "g_rows0", "g_sum0"))
