"""The segmentation of columns a second time, in numpy from end to end: what the Spark form is held against."""

import math

import numpy as np

from colonnade.functions.constants import GROUND, MAX_COST, OBJECT, SKY
from colonnade.operators.models import IMPOSSIBLE, MICRO
from colonnade.operators.segmentation import Columns, fold, to_micro


def object_lut(m):
    """Object cost [model value, observed value], last column for a missing value."""
    fn, d = np.arange(m.max_dis, dtype=float), np.arange(m.max_dis, dtype=float)
    var = m.p["sigma_disparity_object"] ** 2 + (fn * fn * m.p["range_objects_z"] / (m.focal * m.baseline)) ** 2
    sigma = np.sqrt(var)
    erf = np.vectorize(math.erf)
    mass = 0.5 * (erf((m.max_dis - fn) / (sigma * math.sqrt(2))) - erf(-fn / (sigma * math.sqrt(2))))
    norm = np.log(mass) - np.log((1 - m.p["pout"]) / (sigma * math.sqrt(2 * 3.1416)))
    exists, not_exists = m.log_exists("object")
    cost = not_exists + np.minimum(m.uniform, norm[:, None] + (d[None, :] - fn[:, None]) ** 2 / (2 * var)[:, None])
    return to_micro(np.column_stack([cost, np.full(m.max_dis, exists)]))


def prefix(a, axis=-1):
    pad = [(0, 0)] * a.ndim
    pad[axis] = (1, 0)
    return np.pad(np.cumsum(a, axis=axis), pad)


def columns(task, a):
    """The sums that Spark prepares, from raw arrays [column, row]."""
    n, size = task.model.rows, len(a["d"])
    sums = {"valid": (a["d"] >= 0).astype(np.int64), "total": np.maximum(a["d"], 0), "ground": a["ground_cost"], "sky": a["sky_cost"],
            "energy": np.repeat(a["offset_energy"], task.factor, axis=1)[:, :n], "x": a["x"], "y": a["y"], "xx": a["x"] ** 2, "yy": a["y"] ** 2}
    classes = prefix(np.repeat(a["class_cost"], task.factor, axis=2)[:, :, :n]).reshape(size, -1)
    return Columns(task, a | {f"s_{k}": prefix(v) for k, v in sums.items()} | {"s_class": classes}, object_lut(task.model))


def best_class(c, i, b, t, kind):
    """Ground ties to the second ground class, objects to the lowest."""
    r, w = c.task.roles, c.task.weights.relative_instance
    over = lambda p: int(p[i, t + 1] - p[i, b])
    h, x, y = t - b + 1, over(c.sums["x"]), over(c.sums["y"])
    moving = int(to_micro(w * ((over(c.sums["xx"]) - x * x / h) + (over(c.sums["yy"]) - y * y / h)))) if w else 0
    still = int(to_micro(w * float(over(c.energy)))) if w else 0
    cost = {k: int(c.classes[i, k, t + 1] - c.classes[i, k, b]) * MICRO for k in range(c.classes.shape[1])}
    if kind == GROUND:
        return r.ground[0] if cost[r.ground[0]] < cost[r.ground[1]] else r.ground[1]
    if kind == SKY:
        return r.sky
    return min(r.plain + r.instance, key=lambda k: cost[k] + (still if k in r.plain else moving))


def solve(task, a):
    """Per column the segments from the top down, as dicts."""
    c, n = columns(task, a), task.model.rows
    cost, start, below = fold(c, n)
    out = []
    for i in range(len(c.vhor)):
        g, o, s = cost[i, n - 1]
        k = SKY if s < min(g, o) else GROUND if g < o else OBJECT
        t, segs = n - 1, []
        while t >= 0:
            b = int(start[i, t, k])
            count = int(c.valid[i, t + 1] - c.valid[i, b])
            mean = float(c.total[i, t + 1] - c.total[i, b]) / count if count else 0.0
            shown = SKY if k == OBJECT and mean < 1.0 else k
            segs.append({"seg_idx": len(segs), "type": shown, "v_b": b, "v_t": t, "disparity": mean, "class_id": best_class(c, i, b, t, shown),
                         "cost": min(int(cost[i, t, k]), int(MAX_COST * MICRO)), "mean_x": float(c.sums["x"][i, t + 1] - c.sums["x"][i, b]) / (t - b + 1),
                         "mean_y": float(c.sums["y"][i, t + 1] - c.sums["y"][i, b]) / (t - b + 1)})
            t, k = b - 1, int(below[i, t, k])
        out.append(segs)
    assert cost.max() <= IMPOSSIBLE
    return out
