"""Matching of message topics in streams: a stateful processor with bounded queues, and an interval join.

Both give the sets of ``sync.sync_batch``: messages of several topics that are, within a
tolerance, each the mutual nearest neighbour of the anchor topic's message.

The processor keeps, per key and time bucket, a queue of messages per topic.  The queues of
a slot of keys lie in one state, since every call on a state costs far more than a message;
slots are many, so a state holds few of all messages of its time.  As soon as
the newest message or the watermark is ``delay`` and two tolerances past an anchor, no
message in time can change its choice: it is judged, and messages that no later anchor can
reach leave the queues.  So a queue is as long as the delay and four tolerances are, at
most ``queue`` messages.  What a full queue pushes out is counted and reported, not
lost without a word.  An event-time timer judges the rest of a bucket and clears it.

The interval join pairs anchors with messages inside the tolerance, both sides with a
watermark, so a row leaves the state when no partner can come any more; the mutual
choice is made on the pairs it writes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import colonnade
from colonnade.streaming.sync import with_buckets

# the processor travels to the tasks by value, so workers need not have the package installed
cloudpickle.register_pickle_by_value(colonnade)

#: State stores that can serve a stateful processor.
STATEFUL = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Line:
    """Messages of one topic in order of time; of those at one time the least id stands for all."""

    def __init__(self, messages: list[tuple]):
        first: dict[int, object] = {}
        for us, ident in sorted(messages):
            first.setdefault(us, ident)
        self.us, self.ids = list(first), list(first.values())

    def nearest(self, at: int) -> tuple[int, int, object] | None:
        """(gap, time, id) of the nearest message, the earlier one on a tie."""
        if not self.us:
            return None
        k = bisect_right(self.us, at)
        near = [(abs(self.us[j] - at), self.us[j], self.ids[j]) for j in (k - 1, k) if 0 <= j < len(self.us)]
        return min(near, key=lambda x: x[:2])


def judged(messages: list[tuple], anchor: str, others: list[str], tol: int, after: int, upto: int) -> Iterator[tuple]:
    """Sets (time, anchor id, ids of the others) of a bucket's own anchors later than ``after`` and up to ``upto``.

    ``messages`` are tuples of topic, time, id and whether the bucket owns it.
    """
    line = {name: Line([(us, i) for t, us, i, _ in messages if t == name]) for name in (anchor, *others)}
    for topic, us, ident, own in messages:
        if topic != anchor or not own or not after < us <= upto:
            continue
        found = [line[o].nearest(us) for o in others]
        if all(n is not None and n[0] <= tol and line[anchor].nearest(n[1])[1:] == (us, ident) for n in found):
            yield (us, ident, *[n[2] for n in found])


class TopicMatcher(StatefulProcessor):
    """State per slot of keys and bucket: the queues of its keys as one list, and what has been judged so far."""

    def __init__(self, anchor: str, others: list[str], tol: int, width: int, delay: int, queue: int, id_type: str, columns: list[str], keys: dict[str, str]):
        self.anchor, self.others, self.tol, self.width, self.delay, self.queue = anchor, others, tol, width, delay, queue
        self.id_type, self.columns, self.keys = id_type, columns, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keys = "".join(f"_k{n} {kind}, " for n, kind in enumerate(self.keys.values()))
        self.waiting = handle.getListState("waiting", f"{keys}topic string, us bigint, id {self.id_type}, own boolean")
        self.clock = handle.getValueState("clock", "newest bigint, done bigint")

    def by_key(self, rows: list[tuple]) -> dict[tuple, list[tuple]]:
        """The messages (topic, time, id, own) of every key, in order of time."""
        found, n = defaultdict(list), len(self.keys)
        for r in rows:
            found[r[:n]].append(r[n:])
        for messages in found.values():
            messages.sort(key=lambda m: (m[1], m[2]))
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        topics, columns = {self.anchor, *self.others}, [*self.keys, "topic", "us", "id", "own"]
        new = [tuple(r[c] for c in columns) for r in rows if r["topic"] in topics]
        if not new:  # only the clock
            return
        newest, done = self.clock.get() if self.clock.exists() else (None, -(1 << 62))
        latest = max(r[-3] for r in new)
        if newest is None:
            self.handle.registerTimer(((key[1] + 1) * self.width + 2 * self.tol) // 1000 + 1)
        else:
            latest = max(newest, latest)
            new += [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        upto = max(latest - self.delay, timerValues.getCurrentWatermarkInMs() * 1000) - 2 * self.tol
        out, kept, shape, most = [], [], Row(*self.columns), max(done, upto)
        for own, messages in self.by_key(new).items():
            out += [shape(*own, *found, 0) for found in judged(messages, self.anchor, self.others, self.tol, done, upto)]
            messages = [m for m in messages if m[1] > most - 2 * self.tol]
            dropped = 0
            for name in (self.anchor, *self.others):
                queue = [m for m in messages if m[0] == name]
                dropped += max(0, len(queue) - self.queue)
                kept += [(*own, *m) for m in queue[-self.queue:]]
            if dropped:
                out.append(shape(*own, *[None] * (2 + len(self.others)), dropped))
        if kept:
            self.waiting.put(kept)
        else:
            self.waiting.clear()
        self.clock.update((latest, most))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        done = self.clock.get()[1] if self.clock.exists() else -(1 << 62)
        shape = Row(*self.columns)
        out = [shape(*own, *found, 0) for own, messages in self.by_key(held).items()
               for found in judged(messages, self.anchor, self.others, self.tol, done, 1 << 62)]
        self.waiting.clear()
        self.clock.clear()
        yield from out

    def close(self) -> None:
        pass


def sync_stream(msgs: DataFrame, keys: list[str], topic: str, us: str, ident: str, anchor: str,
                others: list[str], tol_us: int, width_us: int, delay_us: int, queue: int = 64, slots: int = 256) -> DataFrame:
    """Matched sets of a stream, and ``dropped``: 0, or in a row of its own how many messages a full queue pushed out.

    Messages more than ``delay_us`` behind the newest one may come too late.  The stream
    has to run with the settings ``STATEFUL``.  Keys are dealt out over ``slots`` states per bucket.
    """
    rows = with_buckets(msgs.select(*keys, topic, us, ident), us, tol_us, width_us).withColumn("at", F.timestamp_micros(F.col(us)))
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int").alias("_slot")
    timed = rows.withWatermark("at", f"{delay_us // 1000 + 1} milliseconds").select(
        slot, *keys, "bucket", F.col(topic).alias("topic"), F.col(us).alias("us"), F.col(ident).alias("id"), "own", "at")
    kind = msgs.schema[ident].dataType
    out = T.StructType([msgs.schema[k] for k in keys] + [T.StructField(us, T.LongType()), *[T.StructField(n, kind) for n in (anchor, *others)],
                                                         T.StructField("dropped", T.LongType())])
    matcher = TopicMatcher(anchor, others, tol_us, width_us, delay_us, queue, kind.simpleString(), out.names,
                           {k: msgs.schema[k].dataType.simpleString() for k in keys})
    return timed.groupBy("_slot", "bucket").transformWithState(matcher, out, outputMode="Append", timeMode="EventTime")


def interval_pairs(msgs: DataFrame, keys: list[str], topic: str, us: str, ident: str, anchor: str,
                   others: list[str], tol_us: int, delay_us: int) -> DataFrame:
    """Anchors and messages of the other topics within the tolerance, by a join of two streams.

    Rows without a topic only move the clock: they keep both watermarks going.
    """
    delay = f"{delay_us // 1000 + 1} milliseconds"

    def side(name: str, wanted: Column) -> DataFrame:
        rows = msgs.where(wanted | F.col(topic).isNull()).select(
            *[F.col(k).alias(f"{name}_{k}") for k in keys], F.col(us).alias(f"{name}_us"), F.col(ident).alias(f"{name}_id"),
            F.col(topic).alias(f"{name}_topic"), F.timestamp_micros(F.col(us)).alias(f"{name}_at"))
        return rows.withWatermark(f"{name}_at", delay)

    a, b = side("a", F.col(topic) == anchor), side("b", F.col(topic).isin(*others))
    within = F.expr(f"b_at >= a_at - interval {tol_us} microseconds AND b_at <= a_at + interval {tol_us} microseconds")
    for k in keys:
        within = (F.col(f"a_{k}") == F.col(f"b_{k}")) & within
    return a.join(b, within).select(*[F.col(f"a_{k}").alias(k) for k in keys], "a_us", "a_id", "b_us", "b_id", F.col("b_topic").alias("topic"))


def mutual_sets(pairs: DataFrame, keys: list[str], us: str, anchor: str, others: list[str]) -> DataFrame:
    """Of all pairs within the tolerance those that choose each other, one set per anchor that has all topics."""
    gap = F.abs(F.col("a_us") - F.col("b_us"))
    of_a = F.min(F.struct(gap.alias("gap"), "b_us", "b_id")).over(W.partitionBy(*keys, "a_us", "a_id", "topic"))
    of_b = F.min(F.struct(gap.alias("gap"), "a_us", "a_id")).over(W.partitionBy(*keys, "topic", "b_us", "b_id"))
    chosen = pairs.withColumns({"_of_a": of_a, "_of_b": of_b}).where(
        (F.col("_of_a.b_us") == F.col("b_us")) & (F.col("_of_a.b_id") == F.col("b_id"))
        & (F.col("_of_b.a_us") == F.col("a_us")) & (F.col("_of_b.a_id") == F.col("a_id")))
    sets = chosen.groupBy(*keys, F.col("a_us").alias(us), F.col("a_id").alias(anchor)).agg(
        F.count_distinct("topic").alias("_topics"), *[F.max(F.when(F.col("topic") == o, F.col("b_id"))).alias(o) for o in others])
    return sets.where(F.col("_topics") == len(others)).drop("_topics")
