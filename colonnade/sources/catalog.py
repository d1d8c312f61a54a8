"""Finding which files belong together and checking that the set is whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.constants import STEM_PARTS, STEM_TAIL


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths and sizes below ``folder``; file contents are never read (pruned column)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(folder).select("path", "length"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, STEM_TAIL, "")


def stem_parts(df: DataFrame, name: str) -> DataFrame:
    """Adds ``stem`` and its three parts (place, sequence, frame) to a table of file names."""
    part = [F.regexp_extract(name, STEM_PARTS, i) for i in (1, 2, 3)]
    return (df.withColumn("stem", file_stem(F.col(name))).withColumn("place", part[0])
            .withColumn("seq", part[1].cast("int")).withColumn("frame_no", part[2].cast("bigint")))


def frame_catalog(files: DataFrame, kinds: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """One row per stem with the first path of each kind and a status.

    A missing required kind is an error, several files of one kind a warning (the
    first is taken).  One shuffle on the stem; the per-kind picks combine map-side.
    """
    of = {k: F.when(F.col("kind") == k, F.col("path")) for k in kinds}
    picks = [F.min(of[k]).alias(k) for k in kinds]
    counts = [F.count(of[k]).alias(f"n_{k}") for k in kinds]
    wide = files.groupBy("stem").agg(*picks, *counts)
    lacking = [F.col(k).isNull() for k in kinds if k not in optional]
    many = [F.col(f"n_{k}") > 1 for k in kinds]
    status = (F.when(any_of(lacking), "error").when(any_of(many), "warning").otherwise("ok"))
    return wide.withColumn("status", status)


def any_of(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def consistency_report(files: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Stems that do not occur exactly once per kind, with how often each kind occurs."""
    n = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds]
    wide = files.groupBy("stem").agg(*n)
    return wide.where(any_of([F.col(f"n_{k}") != 1 for k in kinds]))


def sorted_listing(files: DataFrame, order: list[str], length: int) -> DataFrame:
    """The first ``length`` rows in order (a distributed top-k, not a full sort)."""
    return files.orderBy(*order).limit(length)
