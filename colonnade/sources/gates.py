"""Reading parameters and logs, and the checks that keep bad frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAMERA_SCHEMA = T.StructType([
    T.StructField("extrinsic", T.StructType([T.StructField("baseline", T.DoubleType())])),
    T.StructField("intrinsic", T.StructType(
        [T.StructField(n, T.DoubleType()) for n in ("fx", "fy", "u0", "v0")])),
])


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera files (one JSON object each) with the path they came from."""
    return (spark.read.schema(CAMERA_SCHEMA).option("multiLine", "true").json(path)
            .withColumn("path", F.input_file_name()))


def json_params(df: DataFrame, text: str, defaults: dict[str, float]) -> DataFrame:
    """Numeric fields of a JSON text column; a missing one takes its default."""
    schema = "struct<" + ",".join(f"{k}:double" for k in defaults) + ">"
    got = df.withColumn("_j", F.from_json(text, schema))
    for k, v in defaults.items():
        got = got.withColumn(k, F.coalesce(F.col(f"_j.{k}"), F.lit(float(v))))
    return got.drop("_j")


def scale_values(raw: Column, bits: Column) -> Column:
    """8-bit values as they are, 16-bit ones divided by 256."""
    return F.when(bits == 16, raw / 256.0).otherwise(raw.cast("double"))


def gate_by_height(cells: DataFrame, keys: list[str], row: str, max_dis: int,
                   limit: int = 1024) -> DataFrame:
    """Frame verdicts: a frame is rejected below ``max_dis`` rows or from ``limit`` rows on."""
    h = F.max(row) + 1
    return cells.groupBy(*keys).agg(h.alias("n_rows")).withColumn(
        "verdict", F.when(F.col("n_rows") < max_dis, "too_small")
        .when(F.col("n_rows") >= limit, "too_large").otherwise("ok"))


def padded_height(height: Column, factor: int) -> Column:
    """Next power of two above ``height / factor``: 2^ceil(log2(height/factor + 1))."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.floor(height / factor) + 1.0))).cast("int")


def split_by_verdict(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected frames with their reason)."""
    bad = verdicts.where(F.col("verdict") != "ok")
    return rows.join(bad, keys, "left_anti"), bad


def write_accepted(rows: DataFrame, verdict: Column, reasons: list[str], path: str) -> dict[str, int]:
    """Writes the rows whose verdict is ``ok`` and returns how many rows had which verdict, counted in the same run.

    A verdict that is not among ``reasons`` counts as ``other``; nothing is read twice.
    """
    seen = Observation()
    known = ["ok", *reasons]
    judged = rows.withColumn("_verdict", verdict)
    counts = [F.count(F.when(F.col("_verdict") == r, 1)).alias(r) for r in known]
    other = F.count(F.when(F.col("_verdict").isNull() | ~F.col("_verdict").isin(known), 1)).alias("other")
    judged.observe(seen, *counts, other).where(F.col("_verdict") == "ok").drop("_verdict").write.parquet(path)
    return seen.get


def tail_match(log: DataFrame, keys: list[str], number: str, line: str, prefix: str, pattern: str,
               last: int, scale: float = 1.0) -> DataFrame:
    """The number that ``pattern`` finds in the first ``prefix`` line of the last ``last`` lines.

    ``-1`` if nothing matches.  The line count and the hit combine map-side: the
    candidate lines are those with the prefix, so only they travel to the join.
    """
    size = log.groupBy(*keys).agg(F.max(number).alias("_n"))
    hit = (log.where(F.col(line).startswith(prefix)).join(size, keys)
           .where(F.col(number) > F.col("_n") - last)
           .groupBy(*keys).agg(F.min_by(line, number).alias("_hit")))
    found = F.regexp_extract("_hit", pattern, 1)
    value = F.when(F.length(found) > 0, found.cast("double") * scale)
    return (size.join(hit, keys, "left")
            .select(*keys, F.coalesce(value, F.lit(-1.0)).alias("value")))
