"""Optimal segmentation of columns into ground, object and sky segments.

The input is one row per column with dense arrays, whose length the grid height
bounds.  Spark prepares the prefix sums that give the cost of any segment, and reads
class, mean and scatter of the chosen segments off the same sums afterwards.

* Pairwise, the fold over the top row is sequential: it alone runs in Python, over the
  columns of an Arrow batch together.  Candidate segments exist only inside that step.
* Unary, the cost of a segment does not depend on what lies below, so the best one per
  top row and type is a minimum over bottom rows, and the type below a join.

The way back is walked either where the fold ran, or by pointer jumping over all best
segments, in rounds as many as the logarithm of the segments.

All costs are whole millionths (see ``models``), so results do not depend on the
batching.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import colonnade
from colonnade.functions.constants import GROUND, MAX_COST, OBJECT, SKY
from colonnade.operators.models import IMPOSSIBLE, MICRO, Model, micro
from colonnade.operators.packed import prefix_array, range_sum
from colonnade.operators.segments import object_table
from colonnade.session import cut_lineage, dealt

#: A step of the way back: type, first and last row and cost of a segment, from the top down.
PATH = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("v_b", T.IntegerType()),
                                 T.StructField("v_t", T.IntegerType()), T.StructField("paid", T.LongType())]))
#: Prefix sums per row that a segment's cost is read off.
SUMS = ("valid", "total", "ground", "sky", "energy", "x", "y", "xx", "yy")
# the fold travels to the tasks by value, so workers need not have the package installed
cloudpickle.register_pickle_by_value(colonnade)

BATCH_CELLS = 8_000_000  # entries of the largest array held per step


@dataclass(frozen=True)
class Weights:
    disparity: float = 1.0
    prior: float = 1.0
    segmentation: float = 0.02
    instance: float = 0.001

    @property
    def relative_instance(self) -> float:
        """Instance weight inside the class cost, which is weighted as a whole later."""
        if self.segmentation <= 1e-5 or self.instance < 1e-8:
            return 0.0
        return self.instance / self.segmentation


@dataclass(frozen=True)
class Roles:
    """Which class channels belong to which geometric type."""

    ground: tuple[int, int] = (0, 1)
    plain: tuple[int, ...] = tuple(range(2, 10))
    instance: tuple[int, ...] = tuple(range(11, 19))
    sky: int = 10


@dataclass(frozen=True)
class Task:
    model: Model
    weights: Weights
    roles: Roles
    factor: int = 8
    pairwise: bool = True
    min_height: int = 1


def with_sums(packed: DataFrame, task: Task) -> DataFrame:
    """Adds the prefix sums ``s_...`` of a column, one entry more than rows, and ``s_class``, one array per class channel.

    Coarse channels count for every fine row in reach.
    """
    n, factor = task.model.rows, task.factor
    index = F.sequence(F.lit(0), F.lit(n - 1))

    def fine(name: str, channel: int = 0) -> Column:
        return F.transform(index, lambda i: F.element_at(name, channel * F.size("offset_energy") + F.floor(i / factor).cast("int") + 1))

    def whole(name: str, f) -> Column:
        return F.transform(name, lambda v: f(v).cast("bigint"))

    values = {"valid": whole("d", lambda v: F.when(v >= 0, 1).otherwise(0)), "total": whole("d", lambda v: F.greatest(v, F.lit(0))),
              "ground": F.col("ground_cost"), "sky": F.col("sky_cost"), "energy": fine("offset_energy"),
              "x": whole("x", lambda v: v), "y": whole("y", lambda v: v), "xx": whole("x", lambda v: v * v), "yy": whole("y", lambda v: v * v)}
    channels = 1 + max(*task.roles.ground, *task.roles.plain, *task.roles.instance, task.roles.sky)
    return packed.withColumns({f"s_{k}": prefix_array(values[k]) for k in SUMS}
                              | {"s_class": F.array(*[prefix_array(fine("class_cost", c)) for c in range(channels)])})


def cost_table(spark, m: Model) -> list[list[int]]:
    """Object cost per model value and observed value, a missing one last; its size is that of the table of levels."""
    table = [[0] * (m.max_dis + 1) for _ in range(m.max_dis)]
    for r in object_table(spark, m).collect():  # max_dis x (max_dis + 1) rows, checked there
        table[r["fn"]][r["d"]] = r["cost"]
    return table


def segment_mean(b: Column, t: Column) -> Column:
    count = range_sum(F.col("s_valid"), b, t)
    return F.when(count > 0, range_sum(F.col("s_total"), b, t) / count).otherwise(F.lit(0.0))


def offset_costs(task: Task, b: Column, t: Column) -> tuple[Column, Column]:
    """(moving, still): what instance and other classes pay for the offsets of a segment."""
    w = task.weights.relative_instance
    if w == 0.0:
        return F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    h = t - b + 1
    x, y = range_sum(F.col("s_x"), b, t), range_sum(F.col("s_y"), b, t)
    scatter = (range_sum(F.col("s_xx"), b, t) - x * x / h) + (range_sum(F.col("s_yy"), b, t) - y * y / h)
    return micro(w * scatter), micro(w * range_sum(F.col("s_energy"), b, t).cast("double"))


def class_cost(c: int, b: Column, t: Column) -> Column:
    return range_sum(F.col("s_class")[c], b, t) * MICRO


def described(each: DataFrame, keys: list[str], task: Task) -> DataFrame:
    """Adds mean, class and centre to segments (``seg_idx``, ``kind``, ``v_b``, ``v_t``, ``paid``), read off the sums of their column."""
    r = task.roles
    b, t = F.col("v_b"), F.col("v_t")
    moving, still = offset_costs(task, b, t)
    each = each.withColumns({"disparity": segment_mean(b, t), "moving": moving, "still": still})
    shown = F.when((F.col("kind") == OBJECT) & (F.col("disparity") < 1.0), SKY).otherwise(F.col("kind"))
    ground = F.when(class_cost(r.ground[0], b, t) < class_cost(r.ground[1], b, t), r.ground[0]).otherwise(r.ground[1])
    paid = [F.struct((class_cost(c, b, t) + F.col("still" if c in r.plain else "moving")).alias("cost"), F.lit(k).alias("k"), F.lit(c).alias("c"))
            for k, c in enumerate(r.plain + r.instance)]
    cheapest = (F.least(*paid) if len(paid) > 1 else paid[0])["c"]
    cls = F.when(shown == GROUND, ground).when(shown == SKY, r.sky).otherwise(cheapest)
    mid = {f"mean_{a}": range_sum(F.col(f"s_{a}"), b, t) / (t - b + 1) for a in "xy"}
    return each.select(*keys, "seg_idx", shown.cast("int").alias("type"), "v_b", "v_t", "disparity", cls.cast("int").alias("class_id"),
                       F.least("paid", F.lit(int(MAX_COST * MICRO))).alias("cost"), *[v.alias(k) for k, v in mid.items()])


# --- unary: best segments as a set ---

def unary_nodes(sums: DataFrame, keys: list[str], task: Task) -> DataFrame:
    """Per key, top row ``t`` and type ``kind`` the cost and first row ``start`` of the best segment, and the type below it.

    All segments of a column are generated where the column lies and reduced there to one
    minimum per top row; cost and bottom row share one number, so the lowest bottom wins a tie.
    """
    m, w, r, n = task.model, task.weights, task.roles, task.model.rows
    bits = 11
    if n > 1 << bits:
        raise ValueError(f"at most {1 << bits} rows fit beside a cost")
    table = F.lit(cost_table(sums.sparkSession, m))
    objects = F.transform(table, lambda costs: prefix_array(F.transform("d", lambda v: F.when(v < 0, costs[m.max_dis]).otherwise(costs[v.cast("int")]))))
    h = task.min_height
    tops = sums.withColumn("s_object", objects).withColumn("t", F.explode(F.sequence(F.lit(h - 1), F.lit(n - 1), F.lit(h))))
    pairs = tops.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("t"), F.lit(h))))
    b, t = F.col("b"), F.col("t")
    moving, still = offset_costs(task, b, t)
    pairs = pairs.withColumns({"fn": F.floor(segment_mean(b, t)).cast("int"), "moving": moving, "still": still,
                               "height": micro(w.prior / (t - b + 1.0))})
    of_model = F.col("s_object")[F.col("fn")]

    def total(data: Column, cost: Column) -> Column:
        weighed = data if w.disparity == 1.0 else F.floor(w.disparity * data + 0.5)
        return weighed + F.floor(w.segmentation * cost + 0.5) + F.col("height")

    def cheapest(classes) -> Column:
        costs = [class_cost(c, b, t) for c in classes]
        return F.least(*costs) if len(costs) > 1 else costs[0]

    low = (b - 1) < F.col("vhor")
    best = {
        GROUND: F.when(F.when(b == 0, t <= F.col("vhor")).otherwise(low), total(range_sum(F.col("s_ground"), b, t), cheapest(r.ground) + F.col("still"))),
        OBJECT: total(range_sum(of_model, b, t), F.least(cheapest(r.plain) + F.col("still"), cheapest(r.instance) + F.col("moving"))),
        SKY: F.when((b > 0) & ~low, total(range_sum(F.col("s_sky"), b, t), cheapest((r.sky,)) + F.col("still")))}
    one = {f"k{k}": F.when(c < IMPOSSIBLE, F.shiftleft(c, bits) + b) for k, c in best.items()}
    least = cut_lineage(pairs.select(*keys, "t", *[c.alias(k) for k, c in one.items()]).groupBy(*keys, "t").agg(*[F.min(k).alias(k) for k in one]))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.shiftright(f"k{k}", bits), F.lit(IMPOSSIBLE)).alias("cost"),
                               F.coalesce(F.col(f"k{k}").bitwiseAND(F.lit((1 << bits) - 1)), F.lit(0)).cast("int").alias("start")) for k in (GROUND, OBJECT, SKY)])
    nodes = least.select(*keys, "t", F.explode(kinds).alias("x")).select(*keys, "t", "x.*")
    under = least.select(*keys, (F.col("t") + 1).alias("start"), *[F.coalesce(F.shiftright(f"k{k}", bits), F.lit(IMPOSSIBLE)).alias(f"on{k}") for k in (GROUND, OBJECT, SKY)])
    below = F.when((F.col("kind") == OBJECT) & (F.col(f"on{SKY}") < F.least(f"on{GROUND}", f"on{OBJECT}")), SKY).when(
        F.col(f"on{GROUND}") < F.col(f"on{OBJECT}"), GROUND).otherwise(OBJECT)
    return nodes.join(dealt(under), [*keys, "start"], "left").select(*keys, "t", "kind", "cost", "start", below.alias("below"))


# --- the way back, by pointer jumping ---

def jump_path(nodes: DataFrame, keys: list[str], last: int) -> DataFrame:
    """The best segments that follow each other from row ``last`` down: ``seg_idx``, ``kind``, ``v_b``, ``v_t``, ``paid``.

    Every best segment points to the one below.  A round adds, to all that is known of the
    path, what lies 2^k segments further, and doubles the pointers; so there are as many
    rounds as the logarithm of the longest path, however many rows a series has.
    """
    node = (F.col("t") * 3 + F.col("kind")).alias("node")
    below = F.when((F.col("start") > 0), (F.col("start") - 1) * 3 + F.col("below"))
    jumps = cut_lineage(nodes.select(*keys, node, below.alias("next")))
    ends = nodes.where(F.col("t") == last).groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col("cost"))).alias(f"c{k}") for k in (GROUND, OBJECT, SKY)])
    first = F.when(F.col(f"c{SKY}") < F.least(f"c{GROUND}", f"c{OBJECT}"), SKY).when(F.col(f"c{GROUND}") < F.col(f"c{OBJECT}"), GROUND).otherwise(OBJECT)
    path = cut_lineage(ends.select(*keys, (last * 3 + first).alias("node"), F.lit(0).alias("seg_idx")))
    step = 1
    while True:
        found = cut_lineage(path.join(dealt(jumps.where("next IS NOT NULL")), [*keys, "node"]).select(
            *keys, F.col("next").alias("node"), (F.col("seg_idx") + step).alias("seg_idx")))
        if found.isEmpty():
            break
        path = path.unionByName(found)
        further = jumps.select(*keys, F.col("node").alias("next"), F.col("next").alias("_next"))
        jumps = cut_lineage(jumps.where("next IS NOT NULL").join(dealt(further), [*keys, "next"]).select(*keys, "node", F.col("_next").alias("next")))
        step *= 2
    return path.join(dealt(nodes.withColumn("node", node)), [*keys, "node"]).select(
        *keys, "seg_idx", F.col("kind").cast("int").alias("kind"), F.col("start").cast("int").alias("v_b"), F.col("t").cast("int").alias("v_t"), F.col("cost").alias("paid"))


# --- pairwise: the ordered fold ---

def to_micro(x) -> np.ndarray:
    """Millionths, halves away from zero; impossible stays impossible."""
    x = np.asarray(x, dtype=float)
    whole = np.sign(x) * np.floor(np.abs(np.where(np.isfinite(x), x, 0.0)) * MICRO + 0.5)
    return np.where(np.isfinite(x), whole, IMPOSSIBLE).astype(np.int64)


class Columns:
    """The sums of a batch of columns, as Spark prepared them, and the cost of the segments that end at a row."""

    def __init__(self, task: Task, a: dict[str, np.ndarray], table: np.ndarray):
        m, self.task = task.model, task
        self.vhor, self.ground = a["vhor"], a["ground_fn"]
        size, n = a["d"].shape
        self.valid, self.total = a["s_valid"], a["s_total"]
        self.data = {GROUND: a["s_ground"], SKY: a["s_sky"]}
        self.object_data = np.zeros((size, n + 1, m.max_dis), np.int64)  # [column, row, model value]
        np.cumsum(table.T[np.where(a["d"] < 0, m.max_dis, a["d"])], axis=1, out=self.object_data[:, 1:])
        self.classes, self.energy = a["s_class"].reshape(size, -1, n + 1), a["s_energy"]
        self.sums = {k: a[f"s_{k}"] for k in ("x", "y", "xx", "yy")}
        self.range = np.array([v - m.focal * m.baseline / (m.focal * m.baseline / v + m.p["range_objects_z"])
                               if v else 0.0 for v in range(m.max_dis)])

    def mean(self, n_valid: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(n_valid > 0, total / np.maximum(n_valid, 1), 0.0)

    def offset_terms(self, energy, x, y, xx, yy, h):
        """(moving, still): what instance and other classes pay for the offsets of a segment."""
        w = self.task.weights.relative_instance
        if w == 0.0:
            return 0, 0
        scatter = (xx - x * x / h) + (yy - y * y / h)
        return to_micro(w * scatter), to_micro(w * energy.astype(float))

    def weigh(self, micro_cost: np.ndarray) -> np.ndarray:
        return np.floor(self.task.weights.segmentation * micro_cost + 0.5).astype(np.int64)

    def weigh_data(self, cost: np.ndarray) -> np.ndarray:
        w = self.task.weights.disparity
        return cost if w == 1.0 else np.floor(w * cost + 0.5).astype(np.int64)

    def segment_terms(self, t: int):
        """Data plus class cost per type of all segments that end at row ``t``, and their means."""
        r, b = self.task.roles, slice(0, t + 1, self.task.min_height)
        upto = lambda p: p[:, t + 1][:, None] - p[:, b]
        mean = self.mean(upto(self.valid), upto(self.total))
        fn = mean.astype(np.int64)
        starts = np.arange(t + 1)[b]
        rows = np.arange(len(self.vhor))[:, None]
        data = {k: upto(p) for k, p in self.data.items()}
        data[OBJECT] = np.take_along_axis(self.object_data[:, t + 1], fn, axis=1) - self.object_data[rows, starts[None, :], fn]

        def cheapest(channels):
            p = self.classes[:, list(channels)]
            return (p[:, :, t + 1][:, :, None] - p[:, :, b]).min(axis=1) * MICRO

        moving, still = self.offset_terms(upto(self.energy), *(upto(self.sums[k]) for k in ("x", "y", "xx", "yy")), t + 1 - starts)
        cls = {GROUND: cheapest(r.ground) + still, SKY: cheapest((r.sky,)) + still,
               OBJECT: np.minimum(cheapest(r.plain) + still, cheapest(r.instance) + moving)}
        return {k: self.weigh_data(data[k]) + self.weigh(cls[k]) for k in data}, mean


def neg_log(p: float, width: np.ndarray) -> np.ndarray:
    return np.where(width > 0, -math.log(p) + np.log(np.where(width > 0, width, 1.0)), np.inf)


class Entries:
    """Cost of starting a segment at each row, given the best that ends just below.

    A row is settled once; what then still depends on the new segment is only on
    which side of a threshold its mean lies.
    """

    def __init__(self, c: Columns, n: int):
        size = len(c.vhor)
        cost = lambda: np.full((size, n), IMPOSSIBLE, dtype=np.int64)
        self.c = c
        self.ground, self.sky = cost(), cost()
        self.below = {k: np.full((size, n), OBJECT) for k in (GROUND, SKY)}
        self.near_ground = [cost() for _ in range(3)]  # mean above, below, within the ground value
        self.near_object = [cost() for _ in range(3)]
        self.over_sky = cost()
        self.ground_hi, self.ground_lo, self.object_hi, self.object_lo = (np.zeros((size, n)) for _ in range(4))
        self.sky_limit = c.task.model.p["epsilon"] if c.task.pairwise else -1.0

    def settle(self, p: int, best: np.ndarray, below_mean: np.ndarray) -> None:
        """Fixes the entries of row ``p + 1`` from the best costs [column, type] at row ``p``."""
        c, b, m = self.c, p + 1, self.c.task.model
        low = p < c.vhor
        on = {k: best[:, k] for k in (GROUND, OBJECT, SKY)}
        q, eps, top, g = m.p, m.p["epsilon"], float(m.max_dis), c.ground[:, p]
        gp, r = np.maximum(g, 0.0), np.maximum(c.range[np.floor(below_mean).astype(np.int64)], 0.0)
        u, ln2 = math.log(float(m.rows) - b), math.log(2.0)

        def via(kind: int, prior) -> np.ndarray:
            if not c.task.pairwise:
                return on[kind]
            return np.minimum(on[kind] + to_micro(c.task.weights.prior * prior), IMPOSSIBLE)

        stay = -math.log(0.3) + u
        options = {GROUND: (via(GROUND, stay), via(OBJECT, stay)),
                   SKY: (via(GROUND, np.where(g < 1.0, u, np.inf)), via(OBJECT, np.where(below_mean >= eps, ln2 + u, np.inf)))}
        for kind, table, allowed in ((GROUND, self.ground, low), (SKY, self.sky, ~low)):
            x, y = options[kind]
            table[:, b] = np.where(allowed, np.minimum(x, y), IMPOSSIBLE)
            self.below[kind][:, b] = np.where(x < y, GROUND, OBJECT)
        rise = -math.log(0.7) + u
        for table, prior in zip(self.near_ground, (neg_log(q["pgrav"], top - gp - eps), neg_log(q["pblg"], gp - eps),
                                                   -math.log(1 - q["pgrav"] - q["pblg"]) + math.log(2 * eps))):
            table[:, b] = via(GROUND, rise + prior)
        stack = np.where(low, -math.log(0.7), ln2) + u
        for table, prior in zip(self.near_object, (neg_log(q["pord"], top - below_mean - r), neg_log(1 - q["pord"], below_mean - r), np.inf)):
            table[:, b] = via(OBJECT, stack + prior)
        self.over_sky[:, b] = via(SKY, math.log(top - eps) + u)
        self.ground_hi[:, b], self.ground_lo[:, b] = gp + eps, gp - eps
        self.object_hi[:, b], self.object_lo[:, b] = below_mean + r, below_mean - r

    def object_options(self, b, mean: np.ndarray) -> list[np.ndarray]:
        """Cost on ground, on an object and on sky for new objects with these means."""
        at = lambda table: table[b] if isinstance(b, tuple) else table[:, b]
        pick = lambda tables, hi, lo: np.where(mean > at(hi), at(tables[0]), np.where(mean < at(lo), at(tables[1]), at(tables[2])))
        return [pick(self.near_ground, self.ground_hi, self.ground_lo), pick(self.near_object, self.object_hi, self.object_lo),
                np.where(mean > self.sky_limit, at(self.over_sky), IMPOSSIBLE)]


def first_priors(c: Columns, t: int):
    m = c.task.model
    low = t <= c.vhor
    rows = math.log(m.rows)
    ground = np.where(low, math.log(2.0) + rows, np.inf)
    obj = rows + np.where(low, math.log(2.0), 0.0) + math.log(m.max_dis)
    return {GROUND: ground, OBJECT: obj, SKY: np.full(len(c.vhor), np.inf)}


def fold(c: Columns, n: int):
    """Best cost [column, top, type], where that segment starts, and the type below it."""
    size, h, w, pairwise = len(c.vhor), c.task.min_height, c.task.weights.prior, c.task.pairwise
    cost = np.full((size, n, 3), IMPOSSIBLE, dtype=np.int64)
    start = np.zeros((size, n, 3), dtype=np.int64)
    below = np.full((size, n, 3), OBJECT, dtype=np.int64)
    entries, every = Entries(c, n), np.arange(size)
    for t in range(h - 1, n, h):
        b = slice(0, t + 1, h)
        starts = np.arange(t + 1)[b]
        terms, mean = c.segment_terms(t)
        entry = {GROUND: entries.ground[:, b], SKY: entries.sky[:, b],
                 OBJECT: np.minimum.reduce(entries.object_options(b, mean))}
        height_cost = to_micro(w / (t - starts + 1.0))
        first = first_priors(c, t)
        for k in (GROUND, OBJECT, SKY):
            if not pairwise:
                paid = np.where((entry[k] < IMPOSSIBLE) | (k == OBJECT) | allowed_start(c, k, starts), height_cost[None, :], IMPOSSIBLE)
            elif w == 1.0:
                paid = entry[k].copy()
            else:
                paid = np.where(entry[k] >= IMPOSSIBLE, IMPOSSIBLE, np.floor(w * entry[k] + 0.5)).astype(np.int64)
            paid[:, 0] = to_micro(w * first[k]) if pairwise else np.where(np.isfinite(first[k]), height_cost[0], IMPOSSIBLE)
            total = np.minimum(terms[k] + paid, IMPOSSIBLE)
            i = total.argmin(axis=1)
            cost[:, t, k], start[:, t, k] = total[every, i], starts[i]
        for k in (GROUND, SKY):
            below[:, t, k] = entries.below[k][every, start[:, t, k]]
        s = start[:, t, OBJECT]
        on_ground, on_object, on_sky = entries.object_options((every, s), mean[every, s // h])
        kind = np.where(on_ground < on_object, GROUND, OBJECT)
        below[:, t, OBJECT] = np.where(on_sky < np.minimum(on_ground, on_object), SKY, kind)
        below[:, t] = np.where((cost[:, t] < IMPOSSIBLE) & (start[:, t] > 0), below[:, t], OBJECT)
        if t + 1 < n:
            entries.settle(t, cost[:, t], mean[every, s // h])
    return cost, start, below


def allowed_start(c: Columns, kind: int, starts: np.ndarray) -> np.ndarray:
    """Ground starts below the horizon, sky from it on, objects anywhere."""
    low = (starts - 1)[None, :] < c.vhor[:, None]
    return low if kind == GROUND else ~low


def trace(c: Columns, n: int) -> list[list[dict]]:
    """Per column the segments from the top down."""
    cost, start, below = fold(c, n)
    last = cost[:, n - 1]
    kind = np.where(last[:, GROUND] < last[:, OBJECT], GROUND, OBJECT)
    kind = np.where(last[:, SKY] < np.minimum(last[:, GROUND], last[:, OBJECT]), SKY, kind)
    paths = []
    for i, k in enumerate(kind.tolist()):
        t, path = n - 1, []
        while t >= 0:
            b = int(start[i, t, k])
            path.append({"kind": k, "v_b": b, "v_t": t, "paid": int(cost[i, t, k])})
            t, k = b - 1, int(below[i, t, k])
        paths.append(path)
    return paths


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column, size = batch.column(name), batch.num_rows
    while pa.types.is_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).reshape(size, -1)


def folded(sums: DataFrame, task: Task, added: T.StructType, take) -> DataFrame:
    """``sums`` with what ``take(columns, rows)`` says of the folded columns: arrays for the fields ``added``."""
    m = task.model
    n, per_column = m.rows, max(m.rows * m.max_dis, m.rows * 24)
    chunk = max(1, BATCH_CELLS // per_column)
    table = np.array(cost_table(sums.sparkSession, m), np.int64)
    names = ["d", "ground_fn", "s_class", *[f"s_{k}" for k in SUMS]]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                part = batch.slice(lo, chunk)
                a = {name: _matrix(part, name) for name in names} | {"vhor": part.column("vhor").to_numpy(zero_copy_only=False)}
                yield pa.RecordBatch.from_arrays([*part.columns, *take(Columns(task, a, table), n)], names=[*part.schema.names, *added.names])

    return sums.mapInArrow(run, T.StructType([*sums.schema.fields, *added.fields]))


def fold_paths(sums: DataFrame, task: Task) -> DataFrame:
    """Adds ``path``, walked back where the fold ran."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("v_b", pa.int32()), ("v_t", pa.int32()), ("paid", pa.int64())]))
    return folded(sums, task, T.StructType([T.StructField("path", PATH)]), lambda c, n: [pa.array(trace(c, n), kind)])


def fold_nodes(sums: DataFrame, keys: list[str], task: Task) -> DataFrame:
    """The table of all best segments, as ``unary_nodes`` gives it, from the fold."""
    fields = T.StructType([T.StructField(k, T.ArrayType(T.LongType())) for k in ("cost", "start", "below")])

    def take(c: Columns, n: int) -> list[pa.Array]:
        return [pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.int64())) for x in fold(c, n)]

    each = folded(sums, task, fields, take).select(*keys, F.posexplode(F.arrays_zip("cost", "start", "below")).alias("node", "x"))
    return each.select(*keys, F.floor(F.col("node") / 3).cast("int").alias("t"), (F.col("node") % 3).alias("kind"), "x.*")


def segment_columns(packed: DataFrame, keys: list[str], task: Task, jumps: bool = False) -> DataFrame:
    """Segments of packed columns: ``seg_idx`` from the top, ``type``, ``v_b``, ``v_t``, ``disparity``, ``class_id``, ``cost``, ``mean_x``, ``mean_y``.

    ``packed`` has the keys, ``vhor`` and the arrays ``d`` (-1 if missing),
    ``ground_fn``, ``ground_cost``, ``sky_cost``, ``x``, ``y`` per row, and per coarse
    row ``offset_energy`` and ``class_cost`` (channels one after the other).  With
    ``jumps`` the way back is found by pointer jumping; without, a pairwise fold walks it.
    """
    sums = with_sums(packed, task)
    if task.pairwise and not jumps:
        walked = fold_paths(sums, task)
        each = walked.select(*sums.columns, F.posexplode("path").alias("seg_idx", "p")).select(*sums.columns, "seg_idx", "p.*")
        return described(each, keys, task)
    sums = cut_lineage(sums)
    nodes = cut_lineage(fold_nodes(sums, keys, task) if task.pairwise else unary_nodes(sums, keys, task))
    return described(sums.join(dealt(jump_path(nodes, keys, task.model.rows - 1)), keys), keys, task)
