"""Log files with line numbers, read in splits.

A split of a text file knows where in the file it begins, but not how many lines lie
before it.  One narrow pass counts the lines of every split; running sums per file, over
one row per split, give each split its first line number and each file its length.  No
task reads a whole file, and for the last lines only the splits that hold them are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.text(folder)
    keys = [c for c in found.columns if c != "value"]
    return found.select(*keys, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))


def _splits(lines: DataFrame) -> DataFrame:
    """Per split the lines before it in its file, and the lines of the file."""
    counts = lines.groupBy("path", "_start").agg(F.count("*").alias("_held"))
    ordered = W.partitionBy("path").orderBy("_start")  # one row per split
    return counts.select("path", "_start", "_held", (F.sum("_held").over(ordered) - F.col("_held")).alias("_before"),
                         F.sum("_held").over(W.partitionBy("path")).alias("n_lines"))


def _numbered(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """A split is one stretch of its scan, so its lines are in order; it holds a bounded number of bytes."""
    inside = F.row_number().over(W.partitionBy("path", "_start").orderBy("_id"))
    return (lines.join(splits.drop("_held"), ["path", "_start"]).withColumn("line_no", F.col("_before") + inside)
            .drop("_start", "_id", "_before"))


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``line_no`` (from 1), ``line``, ``n_lines`` of the file, and the keys in the folder names."""
    lines = _lines(spark, folder)
    return _numbered(lines, _splits(lines))


def last_lines(spark: SparkSession, folder: str, last: int) -> DataFrame:
    """The ``last`` lines of every file, numbered as in the whole file."""
    lines = _lines(spark, folder)
    splits = _splits(lines)
    holding = splits.where(F.col("_before") + F.col("_held") > F.col("n_lines") - last)
    return _numbered(lines, holding).where(F.col("line_no") > F.col("n_lines") - last)


def log_files(lines: DataFrame, key: str, order: str, line: str, folder: str) -> None:
    """One file per value of ``key``, its lines in ``order``; a log is one file, so one task writes it, line by line."""
    dealt = lines.select(key, order, F.col(line).alias("value")).repartition(key).sortWithinPartitions(key, order)
    dealt.select(key, "value").write.partitionBy(key).text(folder)
