"""The column segmentation: structured columns, invariants and an independent recurrence."""

import math

import column_reference as ref
import duckdb
import numpy as np
import pytest
from column_reference import object_lut
from oracle import canon
from pyspark.sql import functions as F

from colonnade.operators import segments as sg
from colonnade.operators.models import IMPOSSIBLE, MICRO, Model
from colonnade.operators.segmentation import Roles, Task, Weights, jump_path, segment_columns
from colonnade.plans import segmenting
from colonnade.plans.registry import Tables, load_all
from colonnade.session import cut_lineage

N, D, FACTOR = 24, 32, 4
MODEL = Model(rows=N, max_dis=D, focal=60.0, baseline=0.5)
ROLES = Roles(ground=(0, 1), plain=(2,), instance=(3,), sky=4)


def column_arrays(d, vhor, alpha, classes):
    """Arrays of one column; ``classes`` gives the favoured class per coarse row."""
    n = len(d)
    fn = alpha * (vhor - np.arange(n))
    uniform = math.log(D) - math.log(0.15)
    ground = np.where(np.arange(n) < vhor, np.minimum(uniform, (d - fn) ** 2 / 8 + 2) * MICRO, IMPOSSIBLE).astype(np.int64)
    ground = np.where((d < 0) & (np.arange(n) < vhor), int(1.5 * MICRO), ground)
    sky = np.where(np.arange(n) < vhor, 0, np.where(d < 0, 1.0, np.minimum(6.0, d * d * 50.0)) * MICRO).astype(np.int64)
    cost = np.full((5, len(classes)), 80, dtype=np.int64)
    cost[classes, np.arange(len(classes))] = 0
    zero = np.zeros(len(classes), dtype=np.int64)
    return {"d": d, "vhor": vhor, "ground_fn": fn, "ground_cost": ground, "sky_cost": sky, "x": np.full(n, 4),
            "y": np.arange(n), "offset_energy": zero, "class_cost": cost}


def batch(columns):
    return {k: np.stack([np.asarray(c[k]) for c in columns]) for k in columns[0]}


def solve(columns, **kw):
    return ref.solve(Task(MODEL, kw.pop("weights", Weights(1.0, 1.0, 0.05, 0.0)), ROLES, FACTOR, **kw), batch(columns))


def road_box_sky():
    alpha, vhor = 1.5, 15  # sky may start once the row below is at the horizon
    d = np.array([round(alpha * (vhor - v)) for v in range(8)] + [12] * 8 + [-1] * 8)
    return column_arrays(d, vhor, alpha, [0, 0, 3, 3, 4, 4])


def test_road_box_and_sky():
    (segs,) = solve([road_box_sky()])
    assert [int(s["type"]) for s in segs] == [2, 1, 0]
    assert [(int(s["v_b"]), int(s["v_t"])) for s in segs] == [(16, 23), (8, 15), (0, 7)]
    assert [int(s["class_id"]) for s in segs] == [4, 3, 0] and segs[1]["disparity"] == 12.0


def test_column_without_any_value_is_one_sky_segment():
    (segs,) = solve([column_arrays(np.full(N, -1), 16, 1.5, [0] * 6)])
    assert segs[-1]["v_b"] == 0 and segs[0]["v_t"] == N - 1
    assert all(s["type"] != 1 for s in segs)


@pytest.mark.parametrize("pairwise", [True, False])
def test_segments_tile_the_column_and_batches_do_not_matter(pairwise):
    rng = np.random.default_rng(7)
    cols = [column_arrays(rng.integers(-1, D, N), int(rng.integers(8, 20)), 1.2, rng.integers(0, 5, 6)) for _ in range(12)]
    together = solve(cols, pairwise=pairwise)
    for c, segs in zip(cols, together):
        assert segs[0]["v_t"] == N - 1 and segs[-1]["v_b"] == 0
        assert all(a["v_b"] == b["v_t"] + 1 for a, b in zip(segs, segs[1:]))
        alone = solve([c], pairwise=pairwise)[0]
        assert segs == alone


def test_min_height_restricts_the_borders():
    rng = np.random.default_rng(9)
    cols = [column_arrays(rng.integers(0, D, N), 14, 1.2, rng.integers(0, 5, 6)) for _ in range(5)]
    for segs in solve(cols, min_height=4):
        assert all(s["v_b"] % 4 == 0 and s["v_t"] % 4 == 3 for s in segs)


def test_single_segment_costs_follow_the_formulas():
    """A column that is one object: first-segment prior, object data, class cost."""
    d = np.full(N, 20)
    (segs,) = solve([column_arrays(d, 4, 1.0, [2] * 6)])
    assert len(segs) == 1 and segs[0]["type"] == 1
    prior = math.log(N) + math.log(D)
    data = object_lut(MODEL)[20, 20] * N
    assert segs[0]["cost"] == round(prior * MICRO) + data


def test_lut_in_tasks_equals_the_table_built_by_spark(spark):
    lut = object_lut(MODEL)
    got = sg.object_table(spark, MODEL).collect()
    assert len(got) == D * (D + 1)
    assert all(lut[r["fn"], r["d"]] == r["cost"] for r in got)


ARRAYS = "d array<long>, ground_fn array<double>, ground_cost array<long>, sky_cost array<long>, x array<long>, y array<long>, offset_energy array<long>, class_cost array<long>"


@pytest.mark.parametrize("pairwise, jumps, height", [(True, False, 1), (True, True, 1), (False, False, 1), (False, False, 4), (True, False, 4)])
def test_spark_form_equals_the_numpy_form(spark, pairwise, jumps, height):
    rng = np.random.default_rng(11)
    cols = [column_arrays(rng.integers(-1, D, N), 14, 1.2, rng.integers(0, 5, 6)) for _ in range(20)]
    for c in cols:
        c["offset_energy"] = rng.integers(0, 30, 6)
        c["x"] = rng.integers(0, 40, N)
    data = [(f"f{i % 3}", i, int(c["vhor"]), *[[x.item() for x in np.asarray(c[k]).ravel()] for k in (
        "d", "ground_fn", "ground_cost", "sky_cost", "x", "y", "offset_energy", "class_cost")]) for i, c in enumerate(cols)]
    df = spark.createDataFrame(data, f"frame string, col_id int, vhor long, {ARRAYS}").repartition(3)
    weights = Weights(2.0, 1.0 if pairwise else 10.0, 0.05, 0.002)
    task = Task(MODEL, weights, ROLES, FACTOR, pairwise, height)
    got = segment_columns(df, ["frame", "col_id"], task, jumps)
    assert got.schema["col_id"].dataType.simpleString() == "int"
    want = solve(cols, pairwise=pairwise, weights=weights, min_height=height)
    for i, r in ((r["col_id"], r) for r in got.collect()):
        mine = want[i][r["seg_idx"]]
        assert {k: r[k] for k in ("type", "v_b", "v_t", "class_id", "cost")} == {k: mine[k] for k in ("type", "v_b", "v_t", "class_id", "cost")}
        assert all(r[k] == pytest.approx(mine[k], abs=1e-12) for k in ("disparity", "mean_x", "mean_y"))
    assert got.count() == sum(map(len, want))


def test_pointer_jumping_on_a_long_series(spark):
    """A hundred thousand segments of one series are found in seventeen rounds or so."""
    n = 100_000
    kinds = spark.range(3 * n).select(F.lit("s").alias("key"), F.floor(F.col("id") / 3).alias("t"), (F.col("id") % 3).cast("int").alias("kind"))
    nodes = kinds.select("key", "t", "kind", F.when(F.col("kind") == 1, 5).otherwise(9).cast("bigint").alias("cost"), F.col("t").alias("start"), F.lit(1).alias("below"))
    path = jump_path(nodes, ["key"], n - 1)
    found = path.agg(F.count("*").alias("n"), F.sum("seg_idx").alias("s"), F.min(F.col("seg_idx") + F.col("v_t")).alias("a"), F.max(F.col("seg_idx") + F.col("v_t")).alias("b")).first()
    assert (found.n, found.s, found.a, found.b) == (n, n * (n - 1) // 2, n - 1, n - 1)


def test_values_far_above_the_rest_keep_their_levels(spark, tmp_path):
    """Levels follow the range of the data: no value is cut off, and a busy user still has segments."""
    rows = [(u, d, k, 40.0 + 900.0 * u * (d % 3)) for u in (1, 2, 3) for d in range(1, 29) for k in range(u * 4)]
    kinds = ("click", "error", "purchase", "signup", "view")
    ev = spark.createDataFrame([(u, f"2024-01-{d:02d} 00:{k:02d}:00", kinds[k % 5], v) for u, d, k, v in rows], "user_id long, ts string, event_type string, value double")
    ev.withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    scale = segmenting.scale_of(t)
    assert scale.value > 19_200 and scale.count > 10
    levels = segmenting.columns(t, scale).select("series_id", F.explode("d").alias("d")).where("series_id = 3 AND d >= 0").distinct().count()
    assert levels == 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("q_backtrace", "q_segment_unary"):
        q = load_all()[name]
        df, cur = q.run(t), con.execute(q.sql)
        got, want = canon(df.columns, df.collect()), canon([d[0] for d in cur.description], cur.fetchall())
        assert got == want


def test_pointers_are_not_broadcast(spark):
    """Their files are small, the tables of a task that holds them all are not."""
    kinds = spark.range(300).select(F.lit("s").alias("key"), F.floor(F.col("id") / 3).alias("t"), (F.col("id") % 3).cast("int").alias("kind"))
    nodes = kinds.select("key", "t", "kind", F.lit(5).cast("bigint").alias("cost"), F.col("t").alias("start"), F.lit(1).alias("below"))
    path = jump_path(cut_lineage(nodes), ["key"], 99)
    assert path.count() == 100 and "BroadcastHashJoin" not in path._jdf.queryExecution().toString()
