"""Streams that arrive in many micro-batches give the rows of their batch twins."""

import pytest
from pyspark.sql import functions as F

from colonnade.plans import streams
from colonnade.plans.registry import Tables, load_all
from colonnade.streaming import asof, jobs, matching, sync

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in order of time, six files written one after another."""
    folder = str(tmp_path_factory.mktemp("parts") / "events.parquet")
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    lo, hi = ev.agg(F.min("us"), F.max("us")).first()
    nth = F.least(F.floor((F.col("us") - lo) * 6 / (hi - lo)), F.lit(5))
    for k in range(6):
        ev.where(nth == k).drop("us").coalesce(1).write.mode("append").parquet(folder)
    return folder


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def batch(spark, name):
    return rows(load_all()[name].run(Tables(spark, SF)))


def test_synchronisation_of_four_topics(spark, parts):
    got = streams.synced(jobs.open_stream(spark, parts, 1), ["view", "signup", "purchase"], streams.TOL4, "t4")
    assert rows(got) == batch(spark, "q_sync4_batch")


def test_synchronisation_of_two_topics(spark, parts):
    got = streams.synced(jobs.open_stream(spark, parts, 1), ["view"], streams.TOL2, "t2")
    assert rows(got) == batch(spark, "q_sync2_batch")


def one_busy_key(spark, tmp_path_factory):
    """All messages are of one user, a tenth of an hour apart, in six files."""
    folder = str(tmp_path_factory.mktemp("busy") / "events.parquet")
    topics = F.array(*map(F.lit, ("click", "view", "signup", "purchase")))
    ev = spark.range(6000).select(
        F.lit(1).cast("bigint").alias("user_id"), topics[(F.xxhash64("id") % 4 + 4).cast("int") % 4].alias("event_type"),
        F.timestamp_micros(F.col("id") * (streams.HOUR // 2) + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(streams.HOUR // 2))).alias("ts"),
        F.col("id").alias("event_id"), F.lit(0.0).alias("value"))
    for k in range(6):
        ev.where(F.floor(F.col("event_id") / 1000) == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


OTHERS = ["view", "signup", "purchase"]


def sets_of(spark, folder, tol):
    msgs = streams.messages(spark.read.parquet(folder))
    return rows(sync.sync_batch(msgs, ["user_id"], "topic", "us", "event_id", "click", OTHERS, tol, streams.WIDTH))


def test_one_key_with_all_messages(spark, tmp_path_factory):
    """A bucket's state holds the messages of a delay and four tolerances only, and nothing once its time is over."""
    folder, tol = one_busy_key(spark, tmp_path_factory), streams.HOUR
    places = [str(tmp_path_factory.mktemp("busy") / k) for k in ("out", "state", "clock")]

    def run(last):
        def work(stream):
            return matching.sync_stream(streams.of_topics(stream, OTHERS), ["user_id"], "topic", "us", "event_id", "click", OTHERS, tol, streams.WIDTH, 24 * streams.HOUR)

        stream = jobs.open_stream(spark, folder, 1).select("user_id", "event_type", "ts", "event_id")
        return jobs.run_flushed(stream, "busy", "ts", work, *places, last=last, conf=matching.STATEFUL)

    def waiting():
        with jobs.settings(spark, matching.STATEFUL):
            state = spark.read.format("statestore").option("path", places[1]).option("stateVarName", "waiting").load()
            return [r["count"] for r in state.groupBy("key").count().collect()]

    run(last=False)
    assert waiting() and max(waiting()) <= 2 * 28 + 8
    got = run(last=True)
    assert rows(got.drop("dropped")) == sets_of(spark, folder, tol) and len(sets_of(spark, folder, tol)) > 50
    assert waiting() == []


def test_many_keys_share_states(spark, tmp_path):
    """Calls on states go by slots of keys, not by keys; no set is lost and none mixes keys."""
    folder, places = str(tmp_path / "in"), [str(tmp_path / k) for k in ("out", "state", "clock")]
    spark.range(3000).select((F.col("id") % 1000).alias("user_id"), F.when(F.col("id") < 1000, "click").otherwise("view").alias("event_type"),
                             F.timestamp_micros((F.col("id") + 1_000_000) * 1_000_000).alias("ts"), F.col("id").alias("event_id")).coalesce(1).write.parquet(folder)

    def run(last):
        def work(stream):
            return matching.sync_stream(streams.of_topics(stream, ["view"]), ["user_id"], "topic", "us", "event_id", "click", ["view"],
                                        streams.HOUR, streams.WIDTH, 24 * streams.HOUR)

        return jobs.run_flushed(jobs.open_stream(spark, folder), "many", "ts", work, *places, last=last, conf=matching.STATEFUL)

    run(last=False)
    with jobs.settings(spark, matching.STATEFUL):
        assert spark.read.format("statestore").option("path", places[1]).option("stateVarName", "clock").load().count() <= 2 * 256
    got = run(last=True)
    assert {(r.user_id, r.click, r.view) for r in got.collect()} == {(k, k, k + 1000) for k in range(1000)} and got.count() == 1000


def test_interval_join_of_one_key(spark, tmp_path_factory):
    """Besides the batch itself, state has the rows of a delay and the tolerance, two an hour, and the clock's on both sides."""
    folder, held = one_busy_key(spark, tmp_path_factory), []
    got = streams.joined(jobs.open_stream(spark, folder, 1), OTHERS, streams.HOUR, "busy", held)
    assert rows(got) == sets_of(spark, folder, streams.HOUR)
    assert max(held) <= 1000 + 2 * 2 * 26 and held[-1] <= 2 * 26 + 2


def test_a_full_queue_reports_what_it_pushes_out(spark, tmp_path_factory):
    folder = one_busy_key(spark, tmp_path_factory)
    msgs = jobs.open_stream(spark, folder, 1)

    def work(stream):
        return matching.sync_stream(streams.of_topics(stream, ["view"]), ["user_id"], "topic", "us", "event_id", "click", ["view"],
                                    streams.HOUR, streams.WIDTH, 24 * streams.HOUR, queue=5)

    got = jobs.run_flushed(msgs.select("user_id", "event_type", "ts", "event_id"), "full", "ts", work, conf=matching.STATEFUL)
    assert got.where("click IS NULL").agg(F.sum("dropped")).first()[0] > 0
    sets = got.where("click IS NOT NULL").drop("dropped")
    every = streams.synced(jobs.open_stream(spark, folder, 1), ["view"], streams.HOUR, "all")
    assert 0 < sets.count() <= every.count()


def test_interval_joins(spark, parts):
    for name, others, tol in (("q_sync2_batch", ["view"], streams.TOL2), ("q_sync4_batch", ["view", "signup", "purchase"], streams.TOL4)):
        assert rows(streams.joined(jobs.open_stream(spark, parts, 1), others, tol, "j")) == batch(spark, name)


def test_a_closed_stream_takes_no_more_input(spark, tmp_path):
    """Left open it goes on where it stopped; once closed, later rows are refused and not lost."""
    ev, folder = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts"), str(tmp_path / "in")
    places = [str(tmp_path / k) for k in ("out", "state", "clock")]

    def run(last):
        stream = jobs.open_stream(spark, folder).select("ts", F.lit(1).alias("one"))
        return jobs.run_flushed(stream, "open", "ts", lambda s: jobs.throughput(s.withWatermark("ts", "1 hour"), "ts", "1 hour", "one"), *places, last=last)

    ev.limit(100).coalesce(1).write.parquet(folder)
    run(last=False)
    ev.offset(100).limit(100).coalesce(1).write.mode("append").parquet(folder)
    assert run(last=True).agg(F.sum("n")).first()[0] == 200
    ev.offset(200).limit(100).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(RuntimeError, match="closed"):
        run(last=True)


def test_configuration_by_event_time(spark, parts):
    assert rows(streams.configured(jobs.open_stream(spark, parts, 1), "c")) == batch(spark, "q_asof_config")


def test_a_configuration_that_arrives_late_still_holds(spark, tmp_path):
    """It comes in a later batch than the events after it, but within the delay."""
    def arrive(*seen):
        df = spark.createDataFrame([(k, f"2024-01-01 {h:02d}:00:00", i, f'{{"k": {i}}}') for k, h, i in seen], "event_type string, ts string, event_id long, props string")
        df.withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive(("error", 1, 1), ("view", 0, 10), ("view", 5, 11))
    arrive(("error", 4, 2), ("error", 4, 3), ("view", 9, 12))
    got = streams.configured(jobs.open_stream(spark, str(tmp_path / "in"), 1), "late")
    assert {r.event_id: (r.config_id, r.k) for r in got.collect()} == {10: (None, None), 11: (3, 3), 12: (3, 3)}


def test_a_state_holds_the_configurations_of_its_span_only(spark, tmp_path):
    """Ten a span for three days go to one state each; an event long after all of them still finds the last one."""
    folder, places = str(tmp_path / "in"), [str(tmp_path / k) for k in ("out", "state", "clock")]
    start = 1_000_000 * streams.HOUR // 3600
    config = spark.range(720).select((F.col("id") * (streams.HOUR // 10) + start).alias("us"), F.lit(True).alias("kind"), F.col("id").alias("c"))
    event = spark.range(100).select((F.col("id") * streams.HOUR + start).alias("us"), F.lit(False).alias("kind"), F.col("id").alias("c"))
    config.unionByName(event).select(F.timestamp_micros("us").alias("ts"), "us", "kind", F.col("c").alias("e"), "c").coalesce(1).write.parquet(folder)

    def run(last):
        return jobs.run_flushed(jobs.open_stream(spark, folder), "span", "ts", lambda rows: asof.asof_stream(rows.withColumn("us", F.unix_micros("ts")), "us", F.col("kind"), ["e"], ["c"], 72 * streams.HOUR),
                                *places, last=last, conf=matching.STATEFUL)

    run(last=False)
    with jobs.settings(spark, matching.STATEFUL):
        state = spark.read.format("statestore").option("path", places[1]).option("stateVarName", "history").load()
        held = [r["count"] for r in state.groupBy("key").count().collect()]
    assert held and max(held) <= 10
    got = asof.with_earlier(run(last=True), "us", ["e"], ["c"])
    assert {r.e: r.c for r in got.collect()} == {h: min(10 * h, 719) for h in range(100)} and got.count() == 100


def test_series_spread_over_batches(spark, parts):
    got = streams.frames(jobs.open_stream(spark, parts, 1), SF)
    whole = streams.frames(jobs.open_stream(spark, f"{SF}/events.parquet"), SF)
    assert rows(got) == rows(whole)


def test_throughput_gives_the_last_hours(spark, parts):
    ev = jobs.open_stream(spark, parts, 1).select("ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    got = jobs.run_flushed(ev, "tp", "ts", lambda s: jobs.throughput(s.withWatermark("ts", "1 hour"), "ts", "1 hour", "cents"))
    assert rows(got) == batch(spark, "q_throughput")
