"""The line format of segment files: one line per column, ``;`` between segments.

A segment is 4 fields (type, bottom, top, value), then optionally class, cost,
the two means and an instance number; a closing line carries the ground plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.constants import FIRST_INSTANCE_CLASS


def by_file(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by the file they go to, over as many tasks as a shuffle has.

    A file takes its time however short it is; partitions put together by their bytes
    would leave all files to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def write_files(lines: DataFrame, key: str, order: str, line: str, folder: str) -> None:
    """One text file per value of ``key``, its lines in ``order``; a file's lines must fit a string."""
    files = by_file(lines, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t")))).alias("p"))
    text = F.array_join(F.transform("p", lambda s: s["t"]), "\n")
    files.select(key, text.alias("value")).write.partitionBy(key).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files below ``folder`` with ``path``, ``line_no`` (from 0) and the keys in the folder names."""
    whole = spark.read.text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    keys = [c for c in whole.columns if c not in ("value", "path")]
    body = F.regexp_replace("value", "\n$", "")
    return whole.select(*keys, "path", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


def parse_segments(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Segment rows of column lines; ``seg_idx`` counts from the first of a line."""
    parts = F.filter(F.split(F.col(line), ";"), lambda s: F.length(F.trim(s)) > 0)
    rows = (lines.where(~F.col(line).startswith("groundplane"))
            .select(*keys, F.posexplode(parts).alias("seg_idx", "text"))
            .select(*keys, "seg_idx", F.split("text", ",").alias("f")))
    size = F.size("f")

    def field(i: int, at_least: int, kind: str) -> Column:
        return F.when(size >= at_least, F.element_at("f", i).cast(kind))

    cls = field(5, 5, "int")
    raw = F.element_at("f", 9).cast("int")
    label = F.when(size >= 9, F.when((raw >= 0) & (raw < 1000), cls * 1000 + raw).otherwise(-1))
    return rows.select(
        *keys, "seg_idx",
        field(1, 1, "int").alias("type"), field(2, 2, "int").alias("v_b"),
        field(3, 3, "int").alias("v_t"), field(4, 4, "double").alias("disparity"),
        cls.alias("class_id"), field(6, 6, "double").alias("cost"),
        field(7, 8, "double").alias("mean_x"), field(8, 8, "double").alias("mean_y"),
        label.cast("int").alias("label"),
        F.coalesce((size >= 9) & (cls < FIRST_INSTANCE_CLASS), F.lit(False)).alias("bad_label"))


def parse_ground(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Slope and horizon of the closing line of each file."""
    f = F.split(F.expr(f"substring({line}, 12)"), ",")
    return (lines.where(F.col(line).startswith("groundplane"))
            .select(*keys, f[0].cast("double").alias("alpha_ground"), f[1].cast("int").alias("vhor")))


def write_segments(segs: DataFrame, keys: list[str], order: str, fields: list[str],
                   label: str) -> DataFrame:
    """One text line per column; a column holds at most as many segments as grid rows."""
    text = F.concat(F.concat_ws(",", *[F.col(c).cast("string") for c in fields]),
                    F.when(F.col(label).isNotNull(), F.concat(F.lit(","), F.col(label).cast("string")))
                    .otherwise(""), F.lit(";"))
    packed = segs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("p"))
    return packed.select(*keys, F.array_join(F.transform("p", lambda s: s["t"]), "").alias("line"))
