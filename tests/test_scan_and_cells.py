"""Scans, packing, resampling, text formats and gates on small hand-made data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.functions.erf import erf
from colonnade.operators import aggregate as ag
from colonnade.operators import joins as jn
from colonnade.operators import lines, packed, resample
from colonnade.operators.scan import blocked_scan, series_scan
from colonnade.sources import catalog, gates, segment_text


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_blocked_scan_equals_plain_window_with_a_hot_key(spark, levels):
    rnd = random.Random(1)
    data = [(0 if rnd.random() < 0.4 else rnd.randrange(5), i, rnd.randrange(100), rnd.choice([None, i])) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, pos long, v long, c long")
    specs = [("s", "v", "sum"), ("sb", "v", "sum_before"), ("m", "v", "max"), ("mb", "v", "max_before"), ("l", "c", "last"),
             ("lb", "c", "last_before")]
    names = ["k", "pos", *[s[0] for s in specs]]
    plain = series_scan(df, ["k"], "pos", specs).select(names).collect()
    cut = blocked_scan(df, ["k"], "pos", specs, block=64, levels=levels, fan=8).select(names).collect()
    assert set(plain) == set(cut) and len(cut) == 3000


def test_blocked_scan_without_keys(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    got = rows(blocked_scan(df, [], "pos", [("s", "v", "sum")], block=10, levels=3, fan=7), "pos", "s")
    assert got == [(i, i * (i + 1) // 2) for i in range(1000)]


def test_strip_sums_and_prefix_of_a_small_cube(spark):
    """5 rows, 9 columns, 3 channels, strips of 3, rows turned bottom-up."""
    cube = np.random.default_rng(3).integers(0, 100, size=(5, 9, 3))
    data = [(r, c, k, int(cube[r, c, k])) for r in range(5) for c in range(9) for k in range(3)]
    df = spark.createDataFrame(data, "r int, c int, k int, x long")
    strips = ag.strip_cells(df, ["k"], "r", "c", 3, 5, F.sum("x"))
    want = cube[::-1].reshape(5, 3, 3, 3).sum(axis=2)
    assert rows(strips, "k", "col_id", "v", "value") == sorted(
        (k, s, v, int(want[v, s, k])) for k in range(3) for s in range(3) for v in range(5))
    pre = rows(series_scan(strips, ["k", "col_id"], "v", [("p", "value", "sum_before")]), "k", "col_id", "v", "p")
    cums = np.cumsum(want, axis=0) - want
    assert pre == sorted((k, s, v, int(cums[v, s, k])) for k in range(3) for s in range(3) for v in range(5))


def test_pack_dense_fills_gaps_and_rejects_positions_outside(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 7)], "k int, p int, v long")
    out = packed.pack_dense(df, ["k"], "p", {"v": ("v", None), "z": ("v", 0)}, 5).first()
    assert out["v"] == [5, None, None, 7, None] and out["z"] == [5, 0, 0, 7, 0]
    with pytest.raises(Exception, match="outside"):
        packed.pack_dense(df, ["k"], "p", {"v": ("v", 0)}, 3).collect()


def test_coarse_sum_equals_expanded_sum(spark):
    vals = [3, 1, 4, 1, 5]
    df = spark.createDataFrame([(vals, b, t) for b in range(16) for t in range(b, 16)], "a array<long>, b int, t int")
    got = df.select("b", "t", packed.coarse_range_sum(packed.prefix_array(F.col("a")), F.col("b"), F.col("t"), 4).alias("s"))
    assert all(r["s"] == sum(vals[i // 4] for i in range(r["b"], r["t"] + 1)) for r in got.collect())


def test_erf(spark):
    df = spark.range(-700, 701).select((F.col("id") / 100).alias("x"))
    got = df.select("x", erf(F.col("x")).alias("e")).collect()
    assert max(abs(r["e"] - math.erf(r["x"])) for r in got) < 1e-15


@pytest.mark.parametrize("old,new", [((7, 9), (5, 8)), ((4, 4), (10, 16)), ((64, 64), (48, 48))])
def test_resize_equals_sampling_rule(spark, old, new):
    df = spark.createDataFrame([(r, c, r * 100 + c) for r in range(old[0]) for c in range(old[1])], "r int, c int, v int")
    got = rows(resample.resize_nearest(df, "r", "c", old, new), "r", "c", "v")
    want = sorted((y, x, int((y + 0.5) * old[0] / new[0]) * 100 + int((x + 0.5) * old[1] / new[1]))
                  for y in range(new[0]) for x in range(new[1]))
    assert got == want


def test_block_mode_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(0, 0, 9), (0, 1, 4), (1, 0, 9), (1, 1, 4)], "r int, c int, v int")
    assert rows(resample.block_mode(df, [], "r", "c", "v", 2), "v") == [(4,)]
    with pytest.raises(ValueError):
        resample.block_mode(df, [], "r", "c", "v", 3)


def test_label_remap_round_trip(spark):
    df = spark.range(19).select(F.col("id").cast("int").alias("c"))
    out = df.select("c", resample.to_train_id(resample.to_label_id(F.col("c"))).alias("b"))
    assert all(r["c"] == r["b"] for r in out.collect())


def test_group_median_variants(spark):
    df = spark.createDataFrame([(1, v) for v in (4, 1, 3, 2)] + [(2, v) for v in (5, 5, 9)], "k int, v long")
    assert rows(ag.group_median(df, ["k"], "v", lower=False), "k", "median") == [(1, 2.5), (2, 5.0)]
    assert rows(ag.group_median(df, ["k"], "v", lower=True), "k", "median") == [(1, 2), (2, 5)]


def test_line_votes_find_a_straight_line(spark):
    pts = spark.createDataFrame([(0, x, 20 - x // 2) for x in range(0, 40)], "f int, x int, y int")
    peaks = lines.mark_peaks(lines.line_votes(pts, ["f"], "x", "y", 10), ["f"])
    best = peaks.orderBy(F.desc("votes")).first()
    assert best["peak"] and abs(best["theta"] - 63) <= 2


def test_segment_text_round_trip_and_label_rules(spark):
    lines_df = spark.createDataFrame([
        (0, "1,0,9,3.5,13,2.5,1.0,2.0,7;0,10,12,1.0,0,1.0,0.0,0.0;"), (1, ""), (2, "1,0,5,2.0;"), (3, "1,0,5,2.0,5,1,1,1,3;"),
        (4, "1,0,5,2.0,12,1,1,1,1000;"), (9, "groundplane0.25,40")], "col_id int, line string")
    segs = segment_text.parse_segments(lines_df, ["col_id"])
    got = {(r["col_id"], r["seg_idx"]): r for r in segs.collect()}
    assert len(got) == 5
    assert got[0, 0]["label"] == 13007 and got[0, 1]["label"] is None and got[0, 0]["mean_y"] == 2.0
    assert got[2, 0]["class_id"] is None and got[3, 0]["bad_label"] and got[4, 0]["label"] == -1
    plane = segment_text.parse_ground(lines_df, ["col_id"]).first()
    assert (plane["alpha_ground"], plane["vhor"]) == (0.25, 40)


def test_frame_catalog_statuses(spark):
    files = spark.createDataFrame([("a", "image", "p1"), ("a", "image", "p0"), ("a", "depth", "d"), ("b", "image", "q"),
                                   ("c", "image", "r"), ("c", "depth", "s")], "stem string, kind string, path string")
    out = {r["stem"]: r for r in catalog.frame_catalog(files, ("image", "depth")).collect()}
    assert {k: v["status"] for k, v in out.items()} == {"a": "warning", "b": "error", "c": "ok"} and out["a"]["image"] == "p0"


def test_file_listing_reads_no_contents(spark, tmp_path):
    for n in ("x_000001_000002_image.png", "y.txt"):
        (tmp_path / n).write_bytes(b"data")
    df = catalog.list_files(spark, str(tmp_path), "*.png")
    assert df.count() == 1 and "content" not in df.columns


def test_camera_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"extrinsic": {"baseline": 0.2},\n "intrinsic": {"fx": 1.0, "fy": 2.0, "u0": 3.0, "v0": 4.0}}')
    row = gates.read_cameras(spark, str(tmp_path)).first()
    assert row["extrinsic"]["baseline"] == 0.2 and row["intrinsic"]["v0"] == 4.0


def test_tail_match_only_sees_the_last_lines(spark):
    log = spark.createDataFrame(
        [(1, i, "Score 0.111" if i == 1 else "Score 0.222" if i == 18 else "x") for i in range(1, 21)] + [(2, 1, "none")]
        + [(3, 1, "Score high")], "run int, n int, line string")
    got = rows(gates.tail_match(log, ["run"], "n", "line", "Score", "([0-9][.][0-9]{3})", 5), "run", "value")
    assert got == [(1, 0.222), (2, -1.0), (3, -1.0)]


def test_rectangle_join_brute_force(spark):
    rnd = random.Random(5)
    segs = [(f, c, i, b, b + rnd.randrange(0, 20)) for f in range(2) for c in range(4) for i, b in enumerate(range(0, 40, 21))]
    cells = [(f, rnd.randrange(64), rnd.randrange(32), i) for i, f in enumerate([0] * 300 + [1] * 50)]
    s = spark.createDataFrame(segs, "f int, col_id int, i int, v_b int, v_t int")
    c = spark.createDataFrame(cells, "f int, r int, c int, id int")
    got = rows(jn.rectangle_join(s, c, ["f"], 8, 64), "f", "col_id", "i", "id")
    want = sorted((f, k, i, cid) for f, k, i, b, t in segs for g, r, x, cid in cells
                  if f == g and x // 8 == k and 63 - t <= r <= 63 - b)
    assert got == want


def test_majority_ties_and_share(spark):
    segs = spark.createDataFrame([(0, 0, 0, 12, 0, 1), (0, 1, 0, 12, 0, 63)], "frame_id int, col_id int, seg_idx int, class_id int, v_b int, v_t int")
    cells = spark.createDataFrame([(0, 63, 0, 25001, 12), (0, 62, 0, 25002, 12), (0, 60, 9, 25003, 12)],
                                  "frame_id int, r int, c int, inst int, cell_class int")
    out = jn.majority_assign(segs, cells, ["frame_id"], ["frame_id", "col_id", "seg_idx"], "inst", 8, 64)
    assert rows(out, "col_id", "label") == [(0, 12001), (1, -1)]


def test_asof_takes_the_last_change_at_or_before(spark):
    rnd = random.Random(2)
    ev = [(i, rnd.randrange(10_000)) for i in range(500)]
    cfg = [(t, t * 10) for t in rnd.sample(range(100, 10_000), 40)]
    out = jn.asof_config(spark.createDataFrame(ev, "id int, us long"), spark.createDataFrame(cfg, "us long, p long"), "us", ["p"])
    want = {i: max((t * 10 for t, _ in cfg if t <= us), default=None) for i, us in ev}
    assert {r["id"]: r["p"] for r in out.collect()} == want


def test_votes_are_dealt_by_points(spark, monkeypatch):
    """how many tasks sum up votes follows the number of points, whatever their bytes are."""
    monkeypatch.setattr(lines, "TASK_POINTS", 100)
    pts = spark.range(1000).selectExpr("id % 50 AS f", "CAST(id % 40 AS INT) AS x", "CAST(id % 31 AS INT) AS y")
    votes = lines.line_votes(pts, ["f"], "x", "y", 1)
    assert votes.rdd.getNumPartitions() == 11
    assert votes.agg({"votes": "sum"}).first()[0] == 1000 * 180
