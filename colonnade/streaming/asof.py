"""The configuration in force, by event time, while both events and configurations stream in.

Time is cut into spans.  An event waits until its span is over: until the watermark has
passed it, so that no configuration of the span can come any more.  Then the last
configuration at or before it in the span is final.  A span that is over gives out its last
configuration as well, one row, and is forgotten; events that come before the first
configuration of their span take that of the last earlier span that had one, from the rows
that the stream wrote.  So a row goes to one state, and a state holds the rows of one span.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import colonnade.streaming.matching  # noqa: F401  code travels by value
from colonnade.operators.scan import blocked_scan


class ConfigKeeper(StatefulProcessor):
    """State per span: ``history`` of configurations and ``waiting`` events, both as (time, fields)."""

    def __init__(self, event: T.StructType, config: T.StructType, width: int, columns: list[str]):
        self.event, self.config, self.width, self.columns = event, config, width, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        time = T.StructField("_at", T.LongType())
        self.waiting = handle.getListState("waiting", T.StructType([time, *self.event.fields]))
        self.history = handle.getListState("history", T.StructType([time, *self.config.fields]))

    def read(self, state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, history = [], []
        for r in rows:
            if r["_kind"] is None:  # the clock
                continue
            if r["_kind"]:
                history.append((r["_at"], *(r[f"_c_{f.name}"] for f in self.config)))
            else:
                waiting.append((r["_at"], *(r[f"_e_{f.name}"] for f in self.event)))
        for state, new in ((self.waiting, waiting), (self.history, history)):
            if new:
                state.appendList(new)
        if waiting or history:
            self.handle.registerTimer((key[0] + 1) * self.width // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        history = sorted(self.read(self.history), key=lambda c: (c[0], c[1:]))  # of several at one instant the greatest holds
        times, shape = [c[0] for c in history], Row(*self.columns)
        for event in self.read(self.waiting):
            k = bisect_right(times, event[0])
            yield shape(key[0], k > 0, *event, *(history[k - 1][1:] if k else [None] * len(self.config)))
        if history:
            yield shape(key[0], None, history[-1][0], *[None] * len(self.event), *history[-1][1:])
        self.waiting.clear()
        self.history.clear()

    def close(self) -> None:
        pass


def asof_stream(rows: DataFrame, us: str, is_config, event: list[str], config: list[str], delay_us: int, width_us: int = 3_600_000_000) -> DataFrame:
    """Per span of time every event's ``us`` and fields with the fields of its configuration, for ``with_earlier``.

    ``_known`` says whether the span had one; it is null in the row of the span's last
    configuration.  ``is_config`` says which rows of the stream are configurations; where it
    is null the row only moves the clock.  The stream has to run with the settings ``STATEFUL``.
    """
    span = F.floor(F.col(us) / width_us).cast("bigint").alias("_span")
    timed = rows.withColumn("_time", F.timestamp_micros(F.col(us))).withWatermark("_time", f"{delay_us // 1000 + 1} milliseconds")
    dealt = timed.select(span, is_config.alias("_kind"), F.col(us).alias("_at"), "_time",
                         *[F.col(n).alias(f"_e_{n}") for n in event], *[F.col(n).alias(f"_c_{n}") for n in config])
    of = lambda names: T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])
    out = T.StructType([T.StructField("_span", T.LongType()), T.StructField("_known", T.BooleanType()), T.StructField(us, T.LongType()),
                        *of(event).fields, *of(config).fields])
    keeper = ConfigKeeper(of(event), of(config), width_us, out.names)
    return dealt.groupBy("_span").transformWithState(keeper, out, outputMode="Append", timeMode="EventTime")


def with_earlier(found: DataFrame, us: str, event: list[str], config: list[str]) -> DataFrame:
    """Events with the configuration in force; null where there is none yet.  What is scanned is one row per span."""
    last = F.when(F.col("_known").isNull(), F.struct(*config))
    spans = found.groupBy("_span").agg(F.max(last).alias("_last"))
    before = blocked_scan(spans, [], "_span", [("_before", "_last", "last_before")], block=1 << 20)
    early = found.where("NOT _known").drop(*config).join(before.select("_span", "_before"), "_span").select(
        us, *event, *[F.col("_before")[c].alias(c) for c in config])
    return found.where("_known").select(us, *event, *config).unionByName(early)
