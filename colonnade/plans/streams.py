"""Queries over streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators.joins import micros
from colonnade.plans import geometry, segmenting
from colonnade.plans.registry import Tables, query
from colonnade.streaming import asof, jobs, matching, sync

HOUR = 3_600_000_000
TOL2, TOL4, WIDTH = 6 * HOUR, 24 * HOUR, 96 * HOUR


def messages(events):
    return events.select("user_id", F.col("event_type").alias("topic"), micros(F.col("ts")).alias("us"), "event_id")


def sync_sql(others: tuple[str, ...], tol: int) -> str:
    ctes = ["m AS (SELECT user_id, event_type AS topic, epoch_us(ts) AS us, event_id FROM events)"]
    for o in others:
        for name, a, b in ((f"f_{o}", "click", o), (f"g_{o}", o, "click")):
            ctes.append(f"""{name} AS (SELECT a_id, b_id FROM (SELECT a.event_id AS a_id, b.event_id AS b_id,
  ROW_NUMBER() OVER (PARTITION BY a.event_id ORDER BY abs(a.us - b.us), b.us, b.event_id) AS k
  FROM m a JOIN m b ON a.user_id = b.user_id AND a.topic = '{a}' AND b.topic = '{b}' AND abs(a.us - b.us) <= {tol}) z WHERE k = 1)""")
    joins = " ".join(f"JOIN f_{o} ON f_{o}.a_id = c.event_id JOIN g_{o} ON g_{o}.a_id = f_{o}.b_id AND g_{o}.b_id = c.event_id" for o in others)
    cols = ", ".join(f'f_{o}.b_id AS "{o}"' for o in others)
    return f"WITH {', '.join(ctes)} SELECT c.user_id, c.us, c.event_id AS click, {cols} FROM m c {joins} WHERE c.topic = 'click'"


@query("q_sync2_batch", sql=sync_sql(("view",), TOL2))
def q_sync2_batch(t):
    return sync.sync_batch(messages(t.events), ["user_id"], "topic", "us", "event_id", "click", ["view"], TOL2, WIDTH)


@query("q_sync4_batch", sql=sync_sql(("view", "signup", "purchase"), TOL4))
def q_sync4_batch(t):
    return sync.sync_batch(messages(t.events), ["user_id"], "topic", "us", "event_id", "click",
                           ["view", "signup", "purchase"], TOL4, WIDTH)


def of_topics(stream, others):
    """Messages of the wanted topics; the clock's row has no topic and no user, so it is in no set."""
    return messages(stream.where(F.col("event_type").isin("click", *others) | F.col("event_type").isNull()))


def synced(events, others, tol, name, queue=64, held=None):
    """Sets by the stateful processor; a message that a full queue pushed out would show up as a row without click."""
    def work(stream):
        return matching.sync_stream(of_topics(stream, others), ["user_id"], "topic", "us", "event_id", "click", others, tol, WIDTH, 24 * HOUR, queue)

    sets = jobs.run_flushed(events.select("user_id", "event_type", "ts", "event_id"), name, "ts", work, conf=matching.STATEFUL, held=held)
    return sets.drop("dropped")


def joined(events, others, tol, name, held=None):
    """Sets by the join of two streams, the choice made on the pairs it wrote."""
    def work(stream):
        return matching.interval_pairs(of_topics(stream, others), ["user_id"], "topic", "us", "event_id", "click", others, tol, 24 * HOUR)

    pairs = jobs.run_flushed(events.select("user_id", "event_type", "ts", "event_id"), name, "ts", work, held=held)
    return matching.mutual_sets(pairs, ["user_id"], "us", "click", others)


@query("q_stream_sync2", sql=sync_sql(("view",), TOL2))
def q_stream_sync2(t):
    """Two topics; a set is given out once no message in time can change it, at the latest at the end of input."""
    return synced(jobs.open_stream(t.spark, t.path("events")), ["view"], TOL2, "sync2")


@query("q_stream_sync4", sql=sync_sql(("view", "signup", "purchase"), TOL4))
def q_stream_sync4(t):
    return synced(jobs.open_stream(t.spark, t.path("events")), ["view", "signup", "purchase"], TOL4, "sync4")


@query("q_stream_join2", sql=sync_sql(("view",), TOL2))
def q_stream_join2(t):
    """The same sets by an interval join of the two topics as streams."""
    return joined(jobs.open_stream(t.spark, t.path("events")), ["view"], TOL2, "join2")


@query("q_stream_join4", sql=sync_sql(("view", "signup", "purchase"), TOL4))
def q_stream_join4(t):
    return joined(jobs.open_stream(t.spark, t.path("events")), ["view", "signup", "purchase"], TOL4, "join4")


@query("q_stream_frames", views=segmenting.VIEWS, sql=segmenting.sql(True, "SELECT * FROM seg"))
def q_stream_frames(t):
    """Every series that a batch adds to goes through the whole segmentation, with all that is known of it."""
    return frames(jobs.open_stream(t.spark, t.path("events")), t.sf_dir)


def frames(events, sf_dir):
    """The scale is that of the whole table: it must not change with what has arrived so far."""
    scale = segmenting.scale_of(Tables(events.sparkSession, sf_dir))

    def work(known):
        local = Tables(known.sparkSession, sf_dir)
        local._open["events"] = known
        return segmenting.rounded(segmenting.segments(local, True, scale=scale))

    return jobs.latest(jobs.run_keyed_batches(events, "frames", ["user_id"], work), ["series_id"])


@query("q_stream_config", sql="""
SELECT event_id, n_regionkey AS region, ROUND(value * (1 + n_regionkey), 4) AS scaled FROM events JOIN nation ON n_nationkey = user_id % 25""")
def q_stream_config(t):
    """The configuration table is read anew for every batch, so changes take effect live."""
    def work(batch):
        config = batch.sparkSession.read.parquet(t.path("nation")).select("n_nationkey", F.col("n_regionkey").alias("region"))
        keyed = batch.withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
        return keyed.join(config, "n_nationkey").select(
            "event_id", "region", F.round(F.col("value") * (1 + F.col("region")), 4).alias("scaled"))

    return jobs.run_batches(jobs.open_stream(t.spark, t.path("events")), "config", work)


def configured(events, name):
    """Errors change the configuration; every other event gets the one in force at its time, however late that arrived."""
    event, config = ["event_id"], ["config_id", "k"]

    def work(stream):
        kind = F.col("event_type")
        rows = stream.select(micros(F.col("ts")).alias("us"), kind, F.when(kind != "error", F.col("event_id")).alias("event_id"), F.col("event_id").alias("config_id"),
                             F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
        return asof.asof_stream(rows, "us", kind == "error", event, config, 24 * HOUR)

    found = jobs.run_flushed(events.select("event_type", "ts", "event_id", "props"), name, "ts", work, conf=matching.STATEFUL)
    return asof.with_earlier(found, "us", event, config)


@query("q_stream_asof", sql="""
WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id FROM events WHERE event_type <> 'error'),
c AS (SELECT epoch_us(ts) AS us, event_id AS config_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE event_type = 'error')
SELECT e.event_id, e.us, c.config_id, c.k FROM e ASOF LEFT JOIN c ON e.us >= c.us""")
def q_stream_asof(t):
    """Live reconfiguration by event time: an event waits until its configuration is final."""
    return configured(jobs.open_stream(t.spark, t.path("events")), "asof")


@query("q_stream_late", sql="""
WITH e AS (SELECT ts, event_type, CAST(ts AS DATE) AS day FROM events),
q AS (SELECT epoch_us(MIN(ts)) + (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) // 4 AS us FROM e)
SELECT epoch_us(CAST(day AS TIMESTAMP)) AS start_us, COUNT(*) AS n FROM e, q
WHERE NOT (event_type = 'error' AND epoch_us(ts) <= us) GROUP BY 1""")
def q_stream_late(t):
    """Errors of the first quarter arrive last, far behind the watermark, and are dropped.

    Three arrivals: the earlier half, the later half, the stragglers; the stream takes
    up each one from where it stopped.
    """
    ev = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts")).withColumn("us", micros(F.col("ts")))
    lo, hi = ev.agg(F.min("us"), F.max("us")).first()
    early = F.col("us") <= lo + (hi - lo) // 2
    straggler = (F.col("event_type") == "error") & (F.col("us") <= lo + (hi - lo) // 4)
    arrivals, out, state, clock = (jobs.fresh(t.spark, n) for n in ("arrivals", "late", "late-state", "late-clock"))
    parts = (early & ~straggler, ~early, straggler)
    for k, part in enumerate(parts, 1):
        ev.where(part).select("ts").write.mode("append").parquet(arrivals)

        def work(stream):
            timed = stream.withColumn("one", F.lit(1)).withWatermark("ts", "1 day")
            return jobs.throughput(timed, "ts", "1 day", "one").select("start_us", "n")

        result = jobs.run_flushed(jobs.open_stream(t.spark, arrivals), "late", "ts", work, out, state, clock, last=k == len(parts))
    return result


RATE_SQL = """
SELECT *, ROUND(total / n, 6) AS mean, ROUND(n / 3600.0::DOUBLE, 9) AS per_second FROM (
  SELECT epoch_us(date_trunc('hour', ts)) AS start_us, COUNT(*) AS n, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1) h"""


@query("q_throughput", sql=RATE_SQL)
def q_throughput(t):
    cents = F.round(F.col("value") * 100).cast("bigint")
    ev = t.events.select(F.col("ts").cast("timestamp").alias("ts"), cents.alias("cents"))
    return jobs.throughput(ev, "ts", "1 hour", "cents")


@query("q_stream_throughput", sql=RATE_SQL)
def q_stream_throughput(t):
    """Reported per hour, one hour behind the newest message; the last hours at the end of input."""
    stream = jobs.open_stream(t.spark, t.path("events"))
    ev = stream.select("ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return jobs.run_flushed(ev, "throughput", "ts", lambda s: jobs.throughput(s.withWatermark("ts", "1 hour"), "ts", "1 hour", "cents"))


@query("q_message_assembly", views=("fx_segments",), sql="""
SELECT frame_id, COUNT(*) AS n_segments, 12 * COUNT(*) AS n_vertices, TRUE AS complete,
  string_agg(concat(CAST(col_id AS VARCHAR), ':', CAST(seg_idx AS VARCHAR)), ' ' ORDER BY col_id, seg_idx) AS segments FROM fx_segments GROUP BY 1""")
def q_message_assembly(t):
    """One message per frame: segments in order, each with its twelve vertex numbers.

    A frame holds at most columns x rows segments, so the array is bounded by the grid.
    """
    vertices = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in geometry.NAMES])
    seg = geometry.quads(t).select("frame_id", F.struct("col_id", "seg_idx", "class_id", vertices.alias("vertices")).alias("s"))
    msg = seg.groupBy("frame_id").agg(F.sort_array(F.collect_list("s")).alias("segs"))
    n_vertices = F.aggregate("segs", F.lit(0), lambda a, s: a + F.size(s["vertices"]))
    names = F.transform("segs", lambda s: F.concat_ws(":", s["col_id"].cast("string"), s["seg_idx"].cast("string")))
    out = msg.select("frame_id", F.size("segs").cast("bigint").alias("n_segments"), n_vertices.cast("bigint").alias("n_vertices"),
                     F.array_join(names, " ").alias("segments"))
    return out.withColumn("complete", F.col("n_vertices") == 12 * F.col("n_segments"))


@query("q_stream_sink", sql="""
SELECT 'segments' AS sink, COUNT(*) AS n FROM events WHERE event_type = 'click'
UNION ALL SELECT 'points', COUNT(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'markers', COUNT(*) FROM events WHERE event_type NOT IN ('click', 'view')""")
def q_stream_sink(t):
    """Three independent sinks of one source, each with its own checkpoint."""
    stream = jobs.open_stream(t.spark, t.path("events"))
    kinds = {"segments": "event_type = 'click'", "points": "event_type = 'view'", "markers": "event_type NOT IN ('click', 'view')"}
    out = [jobs.run_to_files(stream.where(c).select("event_id", "user_id", "value"), k).agg(F.count("*").alias("n"))
           .withColumn("sink", F.lit(k)) for k, c in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
