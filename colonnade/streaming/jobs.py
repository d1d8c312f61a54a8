"""Running streams to files and per-batch work with the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.session import settings, shared_dir

#: Slots of keys in the store of a keyed stream: a batch of few keys reads few of them.
SLOTS = 64
#: A time after all messages.
FAR_AHEAD = "9000-01-01 00:00:00"


def open_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A table, one file or a folder of part files, as a stream; naive timestamps get the session zone (UTC)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: a plain path would have to be a folder
    naive = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_files(stream: DataFrame, name: str, out: str | None = None, state: str | None = None,
                 conf: dict[str, str] | None = None, held: list[int] | None = None) -> DataFrame:
    """Writes all that is available to Parquet (exactly once, by its checkpoint) and reads it back.

    With the folders of an earlier run it goes on where that one stopped.  ``conf`` are
    settings for this stream; ``held`` gets the rows in state after every batch.
    """
    spark = stream.sparkSession
    out = out or fresh(spark, name)
    with settings(spark, conf or {}):
        q = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", state or fresh(spark, f"{name}-state")).trigger(availableNow=True).start())
        q.awaitTermination()
    if held is not None:
        held += [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    return spark.read.schema(stream.schema).parquet(out)


def run_flushed(stream: DataFrame, name: str, ts: str, work: Callable[[DataFrame], DataFrame],
                out: str | None = None, state: str | None = None, clock: str | None = None, last: bool = True,
                conf: dict[str, str] | None = None, held: list[int] | None = None) -> DataFrame:
    """Runs ``work`` on the stream and, at the end of input, on one more row that only moves the clock.

    The row has nothing but a time ``ts`` far ahead.  It takes the watermark past every
    open window, so what the stream still held is given out; its own window stays open.
    ``work`` sets the watermark, after the clock has been joined in.  With ``last`` false
    the stream is left open and a later call with the same folders takes it up again; after
    the last row it cannot be, since all that came later would be late, so that is an error.
    """
    spark = stream.sparkSession
    out, state, clock = (p or fresh(spark, f"{name}-{k}") for p, k in ((out, "out"), (state, "state"), (clock, "clock")))
    try:
        ended = spark.read.schema(stream.schema).parquet(clock).where(F.col(ts) >= FAR_AHEAD).count()
        if ended:
            raise RuntimeError(f"{name}: this stream was closed by its last call; later input needs folders of its own")
    except AnalysisException:  # the first call
        spark.createDataFrame([], stream.schema).write.parquet(clock)
    timed = work(stream.unionByName(spark.readStream.schema(stream.schema).parquet(clock)))
    result = run_to_files(timed, name, out, state, conf, held)
    if last:
        ahead = spark.range(1).select(*[
            (F.lit(FAR_AHEAD).cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema.fields])
        ahead.write.mode("append").parquet(clock)
        result = run_to_files(timed, name, out, state, conf, held)
    return result


def run_keyed_batches(stream: DataFrame, name: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results per key over all that has arrived: a batch redoes the keys it touches.

    Arrivals are kept in a store, one folder per batch id and slot of keys, and a batch reads
    only the slots that it touches.  The rows of a redone key replace its older ones: of each
    key the rows of the latest batch count.
    """
    spark = stream.sparkSession
    store, out = fresh(spark, f"{name}-store"), fresh(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
        batch.withColumn("slot", slot).write.mode("overwrite").partitionBy("slot").parquet(f"{store}/batch={batch_id}")
        if batch.isEmpty():
            return
        slots = [r[0] for r in batch.select(slot).distinct().collect()]  # SLOTS rows at most
        every = session.read.schema(stream.schema.add("batch", T.LongType()).add("slot", T.IntegerType())).parquet(store)
        known = every.where((F.col("batch") <= batch_id) & F.col("slot").isin(slots)).drop("slot")
        touched = known.where(F.col("batch") == batch_id).select(*keys).distinct()
        work(known.drop("batch").join(touched, keys, "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", fresh(spark, f"{name}-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the rows of its latest batch."""
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").drop("batch")


def run_batches(stream: DataFrame, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``work`` on every micro-batch and keeps its rows, one folder per batch id.

    A repeated batch overwrites its own folder, so a restart cannot double rows.
    """
    spark = stream.sparkSession
    out = fresh(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", fresh(spark, f"{name}-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def throughput(stream: DataFrame, ts: str, width: str, value: str) -> DataFrame:
    """Messages, total, mean value and messages per second of every tumbling window."""
    win = F.window(ts, width)
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / 1_000_000
    return stream.groupBy(win).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.unix_micros("window.start").alias("start_us"), "n", "total",
        F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round(F.col("n") / seconds, 9).alias("per_second"))
