"""Clustering and synchronisation against brute force, with hot places and keys."""

import os
import random
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colonnade.operators import boxes
from colonnade.operators import cluster as cl
from colonnade.operators import components
from colonnade.operators import evaluation as ev
from colonnade.operators.components import connected_components
from colonnade.plans.registry import Tables, load_all
from colonnade.session import cut_lineage, settings, shared_dir
from colonnade.streaming import sync


def brute(points, eps, min_samples, counts, may_core, dims):
    """Plain quadratic clustering by definition."""
    def near(a, b):
        return a["cls"] == b["cls"] and sum((a[d] - b[d]) ** 2 for d in dims) <= eps * eps

    core = [p for p in points if may_core(p) and sum(1 for q in points if counts(q) and near(p, q)) >= min_samples]
    root = {p["id"]: p["id"] for p in core}
    changed = True
    while changed:
        changed = False
        for a in core:
            for b in core:
                if root[b["id"]] < root[a["id"]] and near(a, b):
                    root[a["id"]], changed = root[b["id"]], True
    number = {}
    for cls in {p["cls"] for p in core}:
        for i, r in enumerate(sorted({root[p["id"]] for p in core if p["cls"] == cls})):
            number[r] = i
    out = {}
    for p in points:
        if p["id"] in root:
            out[p["id"]] = (number[root[p["id"]]], True)
            continue
        best = min(((sum((p[d] - c[d]) ** 2 for d in dims), c["id"]) for c in core if near(p, c)), default=None)
        out[p["id"]] = (number[root[best[1]]] if best else -1, False)
    return out


def sample(seed, dims):
    """A third of the points in one small spot, copies among them, the rest spread."""
    rnd = random.Random(seed)
    pts = []
    for i in range(180):
        hot = i % 3 == 0
        p = {"id": i, "cls": 11 if hot else rnd.choice((11, 12)), "size": rnd.randrange(100)}
        p.update({d: rnd.randrange(40, 46) if hot else rnd.randrange(0, 120 if len(dims) == 2 else 60) for d in dims})
        pts.append(p)
    return pts


@pytest.mark.parametrize("seed,dims,eps", [(1, ("x", "y"), 7), (2, ("x", "y"), 12), (3, ("x", "y", "z"), 11)])
def test_both_variants_equal_brute_force(spark, seed, dims, eps):
    pts = sample(seed, dims)
    df = spark.createDataFrame([tuple(p.values()) for p in pts], "id long, cls int, size int, " + ", ".join(f"{d} long" for d in dims))
    large = lambda p: p["size"] >= 40
    got = cl.dbscan_core_only(df, "id", "cls", dims, "size", eps, 4, 40)
    assert {r["id"]: (r["cluster"], r["is_core"]) for r in got.collect()} == brute(pts, eps, 4, large, large, dims)
    got = cl.dbscan_masked(df, "id", "cls", dims, "size", eps, 4, 40)
    assert {r["id"]: (r["cluster"], r["is_core"]) for r in got.collect()} == brute(pts, eps, 4, lambda p: True, large, dims)


def test_full_squares_are_dealt_out_without_changing_counts(spark, monkeypatch):
    pts = sample(4, ("x", "y"))
    df = spark.createDataFrame([tuple(p.values()) for p in pts], "id long, cls int, size int, x long, y long")
    grid = cl.Grid("cls", ("x", "y"), 9)
    sites = cl.make_sites(grid, df, "id", F.lit(True), F.lit(True))
    plain = sorted(cl.neighbour_weight(grid, sites, sites).collect())
    monkeypatch.setattr(cl, "PART_SITES", 3)
    assert sorted(cl.neighbour_weight(grid, sites, sites).collect()) == plain


@pytest.mark.parametrize("dims", [("x", "y"), ("x", "y", "z")])
def test_degrees_by_lines_equal_pairs(spark, dims):
    pts = sample(5, dims)
    df = spark.createDataFrame([tuple(p.values()) for p in pts], "id long, cls int, size int, " + ", ".join(f"{d} long" for d in dims))
    grid = cl.Grid("cls", dims, 9)
    sites = cl.make_sites(grid, df, "id", F.col("size") >= 30, F.lit(True))
    got = {tuple(r)[:-1]: r["degree"] for r in cl.degree_by_lines(grid, sites).collect() if r["degree"]}
    assert got == {tuple(r)[:-1]: r["degree"] for r in cl.neighbour_weight(grid, sites, sites).collect()}


def real_sample(seed, dims, n):
    """Real positions; half of them in two crowded cells whose gap is close to the radius."""
    rnd = random.Random(seed)
    pts = []
    for i in range(n):
        p = {"id": i, "cls": rnd.choice((11, 12)), "size": rnd.randrange(100)}
        p.update({d: rnd.uniform(0, 60) for d in dims})
        if i % 2:
            p.update({"cls": 11, dims[0]: 100 + 9.5 * (i // 2 % 2) + rnd.uniform(0, 1) ** 3, dims[1]: rnd.uniform(0, 3)})
        pts.append(p)
    return pts


@pytest.mark.parametrize("dims, eps, leaf", [(("x", "y"), 8.9, 2), (("x", "y"), 9.2, 16), (("x", "y", "z"), 9.1, 4)])
def test_real_coordinates_equal_brute_force(spark, monkeypatch, dims, eps, leaf):
    monkeypatch.setattr(boxes.build, "__defaults__", (leaf, boxes.FAN))
    pts = real_sample(7, dims, 240)
    df = spark.createDataFrame([tuple(p.values()) for p in pts], "id long, cls int, size int, " + ", ".join(f"{d} double" for d in dims))
    large = lambda p: p["size"] >= 40
    got = cl.dbscan_core_only(df, "id", "cls", dims, "size", eps, 4, 40)
    assert {r["id"]: (r["cluster"], r["is_core"]) for r in got.collect()} == brute(pts, eps, 4, large, large, dims)
    grid = cl.Grid("cls", dims, eps)
    sites = cl.make_sites(grid, df, "id", F.lit(True), F.lit(True))
    degree = df.join(cl.degrees(grid, sites), ["cls", *dims])
    near = lambda a, b: a["cls"] == b["cls"] and sum((a[d] - b[d]) ** 2 for d in dims) <= eps * eps
    assert {r["id"]: r["degree"] for r in degree.collect()} == {p["id"]: sum(near(p, q) for q in pts) for p in pts}


def test_points_without_the_third_feature_take_no_part(spark):
    pts = [p | {"z": 0.0 if p["id"] % 5 == 0 else p["z"]} for p in real_sample(8, ("x", "y", "z"), 160)]
    df = spark.createDataFrame([tuple(p.values()) for p in pts], "id long, cls int, size int, x double, y double, z double")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in cl.dbscan_measured(df, "id", "cls", ("x", "y"), "z", "size", 9.0, 4, 40).collect()}
    large = lambda p: p["size"] >= 40
    known = brute([p for p in pts if p["z"]], 9.0, 4, large, large, ("x", "y", "z"))
    assert got == {p["id"]: known.get(p["id"], (-1, False)) for p in pts}


def test_two_crowded_cells_meet_by_boxes(spark):
    """Of 40,000 x 40,000 pairs across the gap only boxes along it are looked at, whether or not the cells touch."""
    side = cl.Grid("cls", ("x", "y"), 10.0).side
    rows = spark.range(80_000).select(
        (F.col("id") % 2).alias("v"), ((F.col("id") % 2) * (side + 4.0) + F.rand(3) * 3.0).alias("x"), (F.rand(4) * side * 0.9).alias("y"), F.lit(1).cast("long").alias("w"),
        ((F.col("id") % 2) * side).alias("cx"), F.lit(0.0).alias("cy"))
    rows = cut_lineage(rows)
    tree = boxes.build(rows, "v", ("x", "y"), ["cx", "cy"], side)
    assert len(tree.levels) == 5
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    ends = rows.groupBy("v").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("v").collect()
    gap = ends[1]["lo"] - ends[0]["hi"]
    assert boxes.touching(tree, "v", pairs, (gap * 0.999) ** 2).count() == 0
    assert boxes.touching(tree, "v", pairs, (gap * 1.05) ** 2).count() == 1


def test_crowded_cells_give_the_same_clusters(spark):
    pts = sample(6, ("x", "y"))
    df = spark.createDataFrame([tuple(p.values()) for p in pts], "id long, cls int, size int, x long, y long")
    large = lambda p: p["size"] >= 40
    got = cl.dbscan_core_only(df, "id", "cls", ("x", "y"), "size", 12, 4, 40)
    assert {r["id"]: (r["cluster"], r["is_core"]) for r in got.collect()} == brute(pts, 12, 4, large, large, ("x", "y"))


def test_too_few_large_points_give_no_cluster(spark):
    df = spark.createDataFrame([(i, 11, 90, i, 0) for i in range(4)], "id long, cls int, size int, x long, y long")
    assert {r["cluster"] for r in cl.dbscan_core_only(df, "id", "cls", ("x", "y"), "size", 10, 4, 50).collect()} == {-1}
    assert {r["cluster"] for r in cl.dbscan_core_only(df, "id", "cls", ("x", "y"), "size", 10, 3, 50).collect()} == {0}


def test_components_of_a_long_path_and_a_star(spark):
    ids = list(range(300))
    random.Random(8).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(1000, i) for i in range(1001, 1100)]
    v = spark.createDataFrame([(i,) for i in [*ids, *range(1000, 1100), 5000]], "v long")
    got = {r["v"]: r["root"] for r in connected_components(v, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in ids} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and got[5000] == 5000


def test_components_write_a_few_times_the_graph_however_long_a_chain_is(spark, monkeypatch):
    """The graph of a round shrinks, so all rounds together write little more than the first."""
    rows, write = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: rows.append((out := write(df)).count()) or out)
    n = 3000
    ids = random.Random(9).sample(range(10**12), n)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got = connected_components(spark.createDataFrame([(i,) for i in ids], "v long"), edges).collect()
    assert len(got) == n and {r["root"] for r in got} == {min(ids)}
    assert sum(rows) < 9 * n
    rows.clear()
    path = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in connected_components(spark.range(n + 1).withColumnRenamed("id", "v"), path).collect()} == {0}
    assert sum(rows) < 9 * n


def test_sites_meet_boxes_in_blocks_and_are_judged_there(spark, monkeypatch):
    """boxes go to few blocks, the highest level is not shuffled again, and parts of a full block change nothing."""
    pts = spark.createDataFrame([(p["id"], p["cls"], p["size"], p["x"], p["y"]) for p in real_sample(5, ("x", "y"), 300)],
                                "id long, cls int, size int, x double, y double")
    grid = cl.Grid("cls", ("x", "y"), 9.1)
    sites, core, tree = cl.core_structure(grid, pts, "id", 4, F.lit(True), F.col("size") >= 40)
    near = cl.nearest_core(grid, sites, core, tree)
    plain = sorted(near.collect())
    plan = near._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 4 * len(tree.levels) + 1  # two sides a level, limits of all but the highest, the answer
    monkeypatch.setattr(cl, "PART_SITES", 7)
    assert sorted(cl.nearest_core(grid, sites, core, tree).collect()) == plain and plain


def test_summary_lists_every_member_of_every_label(spark, monkeypatch):
    """points without a cluster have a label too, and all members are listed, however many rows they take."""
    monkeypatch.setattr(cl, "LISTED", 7)
    monkeypatch.setattr(cl, "STRETCH_BITS", 3)
    rnd = random.Random(10)
    rows = [(rnd.choice((11, 12, None)), rnd.choice((-1, -1, 0, 1, 2)), i, rnd.randrange(9), rnd.randrange(9)) for i in rnd.sample(range(10**12), 150)]
    rows += [(11, -1, 5, None, 3), (13, 0, 6, 1, 1)]
    df = spark.createDataFrame(rows, "cls int, cluster int, id long, x long, y long")
    got = cl.cluster_summary(df, ["cls", "cluster"], "id", ("x", "y")).collect()
    labels = {r[:2] for r in rows}
    assert {(r.cls, r.cluster) for r in got} == labels and (11, -1) in labels
    for label in labels:
        want = sorted(r[2:] for r in rows if r[:2] == label)
        own = sorted((r for r in got if (r.cls, r.cluster) == label), key=lambda r: r.part)
        assert [tuple(m) for r in own for m in r.members] == want
        assert [(r.part, len(r.members)) for r in own] == [(i, len(want[i * 7:i * 7 + 7])) for i in range(len(own))]
        xs = [m[1] for m in want if m[1] is not None]
        assert {(r.n, r.first_id, r.min_x, r.max_x, round(r.mid_x, 6)) for r in own} == {(len(want), want[0][0], min(xs), max(xs), round(sum(xs) / len(xs), 6))}


def test_summary_query_gives_all_points_their_colour(spark):
    """the rows to overlay hold each point once; white are those without a cluster."""
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = load_all()["q_cluster_summary"].run(t).collect()
    points = sorted((p.class_id, f"{p.pt_id}:{p.x}:{p.y}") for p in t.fx_points.collect())
    assert sorted((r.class_id, m) for r in rows for m in r.members.split(" ")) == points
    white = {(r.r, r.g, r.b) == (255, 255, 255) for r in rows if r.cluster < 0}, {(r.r, r.g, r.b) == (255, 255, 255) for r in rows if r.cluster >= 0}
    assert white == ({True}, {False})


def test_label_that_does_not_fit_is_an_error(spark):
    df = spark.createDataFrame([(12, 1000)], "c int, n int")
    with pytest.raises(Exception, match="does not fit"):
        df.select(cl.encode_label(F.col("c"), F.col("n"))).collect()


def test_sync_equals_brute_force_with_a_busy_key(spark):
    rnd = random.Random(6)
    msgs = [(0 if rnd.random() < 0.4 else rnd.randrange(4), rnd.choice("abc"), rnd.randrange(20_000), i) for i in range(600)]
    df = spark.createDataFrame(msgs, "k int, topic string, us long, id long")
    tol = 60

    def nearest(m, topic):
        return min(((abs(m[2] - o[2]), o[2], o[3], o) for o in msgs if o[0] == m[0] and o[1] == topic), default=(None,) * 4)[3]

    want = set()
    for m in (m for m in msgs if m[1] == "a"):
        found = [nearest(m, t) for t in "bc"]
        if all(o and abs(o[2] - m[2]) <= tol and nearest(o, "a")[3] == m[3] for o in found):
            want.add((m[3], found[0][3], found[1][3]))
    got = sync.sync_batch(df, ["k"], "topic", "us", "id", "a", ["b", "c"], tol, 400)
    assert {(r["a"], r["b"], r["c"]) for r in got.collect()} == want and want


def test_average_precision_of_perfect_and_missing_instances(spark):
    cells = [(0, r, 0, 24000 if r < 10 else 24001, 24000 if r < 10 else 5) for r in range(20)]
    df = spark.createDataFrame(cells, "f int, r int, c int, gt int, pred int")
    out = ev.average_precision(df, "f", "gt", "pred").collect()
    assert len(out) == 10 and all((r["tp"], r["n_gt"], r["n_pred"], r["ap"]) == (1, 2, 1, 0.5) for r in out)


def test_iou_bounds(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1)], "gt int, pred int")
    out = {r["cls"]: r["iou"] for r in ev.iou_from_confusion(ev.confusion(df, "gt", "pred"), "gt", "pred").collect()}
    assert out == {1: pytest.approx(1 / 3), 2: 0.5, 3: 0.0}


def test_nothing_that_grows_is_broadcast(spark):
    """a side whose files are small is shuffled however small the planner takes it for; cells are what it underrates most."""
    pts = spark.createDataFrame([(p["id"], p["cls"], p["size"], p["x"], p["y"], p["z"]) for p in real_sample(3, ("x", "y", "z"), 60)],
                                "id long, cls int, size int, x double, y double, z double")
    grid = cl.Grid("cls", ("x", "y", "z"), 9.1)
    sites, core, tree = cl.core_structure(grid, pts, "id", 4, F.lit(True), F.lit(True))
    near = cl.nearest_core(grid, sites, core, tree)
    count = cl.neighbour_weight(grid, sites, sites)
    for df in (near, count):
        assert df.count() and "BroadcastHashJoin" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", ["cells", "sites"])
def test_either_set_of_cells_may_be_shifted(spark, few):
    """sites meet the same boxes whether their own cells are fewer or those they look for."""
    grid = cl.Grid("cls", ("x", "y"), 5.0)
    pts = lambda n, k: spark.range(n).selectExpr("11 AS cls", f"(id * {k}) % 40.0 AS x", f"(id * {k + 4}) % 31.0 AS y", "id AS cid")
    a, b = (pts(200, 3), pts(9, 5)) if few == "cells" else (pts(9, 5), pts(200, 3))
    _, core, tree = cl.core_structure(grid, b, "cid", 1, F.lit(True), F.lit(True))
    got = {(r.x, r.y): r.sq for r in cl.nearest_core(grid, grid.with_cell(a.select("cls", "x", "y").distinct()), core, tree).collect()}
    far = {(p.x, p.y): min((p.x - q.x) ** 2 + (p.y - q.y) ** 2 for q in b.collect()) for p in a.collect()}
    assert got == {k: v for k, v in far.items() if v <= 25}


def test_few_edges_leave_few_files(spark):
    """Only the first and the last table of the components have a file per partition, and what a cut shuffled is gone after it."""
    place, n = Path(shared_dir(spark)), 300
    local = Path(spark.conf.get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir())))
    found = lambda: (set(place.glob("cut-*/part-*")), set(local.glob("blockmgr-*/*/shuffle_*")))
    path = spark.range(n).select(F.xxhash64(F.col("id")).alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    ends = spark.range(n + 1).select(F.xxhash64(F.col("id")).alias("v"))
    with settings(spark, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        tables, _ = found()
        got = connected_components(ends, path)
        assert len(found()[0] - tables) <= 2 * 40 + 50
        assert got.select("root").distinct().count() == 1 and got.count() == n + 1
        _, shuffles = found()
        cut_lineage(path.groupBy("a").count())
        for _ in range(50):  # they go in the background
            if not found()[1] - shuffles:
                return
            time.sleep(0.2)
    raise AssertionError("shuffle files are left")
