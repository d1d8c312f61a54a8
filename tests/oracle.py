"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import time
from decimal import Decimal

import duckdb

from colonnade.plans.registry import TABLES, Tables


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (float, Decimal)):
        f = float(v)
        if math.isnan(f) or math.isinf(f):
            return str(f)
        return format(f + 0.0, ".9g")
    return str(v)


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir):
    """(ok, message); a query without SQL only has to give rows."""
    t0 = time.time()
    df = q.run(Tables(spark, sf_dir))
    rows = df.collect()
    t_spark = time.time() - t0
    if q.sql is None:
        return bool(rows), f"{len(rows)} rows (no SQL) spark {t_spark:.1f}s"
    names, got = canon(df.columns, rows)
    t0 = time.time()
    cur = con.execute(q.sql)
    want_rows = cur.fetchall()
    t_duck = time.time() - t0
    want_names, want = canon([d[0] for d in cur.description], want_rows)
    head = f"{len(got)} rows spark {t_spark:.1f}s duck {t_duck:.1f}s"
    if names != want_names:
        return False, f"{head}: columns {names} != {want_names}"
    kinds = {n: f.dataType.simpleString() for n, f in zip(df.columns, df.schema.fields)}
    for d in cur.description:
        a, b = kinds[d[0]], str(d[1]).upper()
        ok = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN"}.get(a)
        if ok != b:
            return False, f"{head}: type of {d[0]}: spark {a}, sql {b}"
    if got != want:
        gs, ws = set(got), set(want)
        return False, (f"{head}: {len(want)} expected; only spark {sorted(gs - ws)[:3]} "
                       f"only sql {sorted(ws - gs)[:3]} cols {names}")
    if not got:
        return False, f"{head}: empty on both sides"
    return True, head
