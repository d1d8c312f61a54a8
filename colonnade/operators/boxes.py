"""Boxes over points in cells: distances are asked of boxes first, and of points only where a box cannot tell.

The points of a cell are put in order along a curve that fills it, and cut into blocks of
equally many points; a block has the tight box around its points, and blocks are boxed in
turn.  So a cell of any number of points is a tree whose depth is the logarithm of that
number, wherever the points lie, and no task ever holds a cell.  All levels are tables;
going down a level is a join.

Coordinates may be whole numbers or doubles.  A box's least and greatest distance are
computed like the distance of two points, and every step rounds in one direction for all
of them, so a box never contradicts its points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.operators.scan import numbered
from colonnade.session import cut_lineage, dealt

LEAF, FAN = 16, 8  # points of the lowest boxes, boxes in a box
CURVE_BITS = 10


@dataclass(frozen=True)
class Tree:
    """``points`` has the cell id, the block ``_k`` and what was carried along; ``levels`` the boxes, lowest first."""

    dims: tuple[str, ...]
    points: DataFrame
    levels: list[DataFrame]


def curve(dims: tuple[str, ...], corner: list[str], side: float) -> Column:
    """Place on a curve through the cell: the digits of all coordinates in turn."""
    top = (1 << CURVE_BITS) - 1
    code = F.lit(0).cast("bigint")
    for i, (x, c) in enumerate(zip(dims, corner)):
        u = F.least(F.greatest(F.floor((F.col(x) - F.col(c)) / side * (top + 1)).cast("bigint"), F.lit(0)), F.lit(top))
        for b in range(CURVE_BITS):
            code = code + F.shiftleft(F.shiftright(u, b).bitwiseAND(F.lit(1)), b * len(dims) + i)
    return code


def build(points: DataFrame, cell: str, dims: tuple[str, ...], corner: list[str], side: float, leaf: int = LEAF, fan: int = FAN,
          *, also: tuple[str, ...] = ()) -> Tree:
    """A tree over distinct ``points`` with the id ``cell`` of their cell, the columns of its ``corner`` and a weight ``w``.

    Boxes carry the columns ``also``, which are the same all over a cell.
    """
    ordered = points.withColumn("_z", curve(dims, corner, side)).drop(*corner)
    placed = cut_lineage(numbered(ordered, [cell, "_z", *dims], "_no").withColumn("_k", F.expr(f"_no div {leaf}")).drop("_z", "_no"))
    most = placed.groupBy(cell).count().agg(F.max("count").alias("n")).first()["n"] or 0
    ends = [f(c).alias(n) for x in dims for f, c, n in ((F.min, f"_lo_{x}", f"_lo_{x}"), (F.max, f"_hi_{x}", f"_hi_{x}"))] + [F.min(c).alias(c) for c in also]
    lowest = placed.withColumns({f"_{e}_{x}": F.col(x) for x in dims for e in ("lo", "hi")})
    levels = [cut_lineage(lowest.groupBy(cell, "_k").agg(F.sum("w").alias("w"), *ends))]
    size = leaf
    while size < most:
        levels.append(cut_lineage(levels[-1].withColumn("_k", F.expr(f"_k div {fan}")).groupBy(cell, "_k").agg(F.sum("w").alias("w"), *ends)))
        size *= fan
    return Tree(dims, placed, levels)


def below(tree: Tree, level: int, fan: int = FAN) -> DataFrame:
    """The boxes under those of ``level``, with ``_up``, the block they lie in; under the lowest the points, boxed each on its own."""
    if level:
        return tree.levels[level - 1].withColumn("_up", F.expr(f"_k div {fan}"))
    ends = {f"_{e}_{x}": F.col(x) for x in tree.dims for e in ("lo", "hi")}
    return tree.points.withColumns(ends | {"_up": F.col("_k")}).drop(*tree.dims)


def prefixed(df: DataFrame, mark: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(mark + c) for c in df.columns])


def least(dims: tuple[str, ...], a: str, b: str) -> Column:
    """Square of the least distance of two boxes, whose columns are marked ``a`` and ``b``."""
    total = F.lit(0)
    for x in dims:
        gap = F.greatest(F.col(f"{b}_lo_{x}") - F.col(f"{a}_hi_{x}"), F.col(f"{a}_lo_{x}") - F.col(f"{b}_hi_{x}"), F.lit(0))
        total = total + gap * gap
    return total


def most(dims: tuple[str, ...], a: str, b: str) -> Column:
    """Square of the greatest distance of two boxes."""
    total = F.lit(0)
    for x in dims:
        gap = F.greatest(F.col(f"{b}_hi_{x}") - F.col(f"{a}_lo_{x}"), F.col(f"{a}_hi_{x}") - F.col(f"{b}_lo_{x}"))
        total = total + gap * gap
    return total


def _ends(dims: tuple[str, ...]) -> list[str]:
    return [f"_{e}_{x}" for x in dims for e in ("lo", "hi")]


def touching(tree: Tree, cell: str, pairs: DataFrame, square: float) -> DataFrame:
    """The pairs (``a``, ``b``) of cells that hold points within the square root of ``square`` of each other."""
    dims = tree.dims
    top = tree.levels[-1].select(cell, "_k", *_ends(dims))
    a, b = prefixed(top, "a"), prefixed(top, "b")
    open_ = pairs.join(dealt(a.withColumnRenamed("a" + cell, "a")), "a").join(dealt(b.withColumnRenamed("b" + cell, "b")), "b").where(least(dims, "a", "b") <= square)
    return touching_boxes(tree, cell, open_, square)


def touching_boxes(tree: Tree, cell: str, open_: DataFrame, square: float) -> DataFrame:
    """The same from pairs of cells with their highest boxes, marked ``a`` and ``b``, where these are near enough."""
    dims = tree.dims
    found = []
    for level in range(len(tree.levels) - 1, -1, -1):
        open_ = cut_lineage(open_.withColumn("_sure", most(dims, "a", "b") <= square))
        sure = cut_lineage(open_.where("_sure").select("a", "b").distinct())
        found.append(sure)
        rest = open_.join(dealt(sure), ["a", "b"], "left_anti").select("a", "b", "a_k", "b_k")
        under = below(tree, level).select(cell, "_up", "_k", *_ends(dims))
        ua = prefixed(under, "a").withColumnRenamed("a" + cell, "a").withColumnRenamed("a_k", "a_n").withColumnRenamed("a_up", "a_k")
        ub = prefixed(under, "b").withColumnRenamed("b" + cell, "b").withColumnRenamed("b_k", "b_n").withColumnRenamed("b_up", "b_k")
        open_ = (rest.join(dealt(ua), ["a", "a_k"]).join(dealt(ub), ["b", "b_k"]).where(least(dims, "a", "b") <= square)
                 .drop("a_k", "b_k").withColumnsRenamed({"a_n": "a_k", "b_n": "b_k"}))
    edges = open_.select("a", "b").distinct()
    for sure in found:
        edges = edges.unionByName(sure)
    return edges.distinct()


def top(tree: Tree, cell: str) -> DataFrame:
    """The highest boxes of every cell, marked ``b``."""
    return prefixed(tree.levels[-1], "b", (cell,))


def ask(targets: DataFrame, dims: tuple[str, ...], mark: str = "t") -> DataFrame:
    """Targets as boxes of one point."""
    return targets.withColumns({f"{mark}_{e}_{x}": F.col(x) for x in dims for e in ("lo", "hi")})


def nearest(tree: Tree, cell: str, targets: DataFrame, key: list[str], square: float, ident: str, carry: list[str],
            place: list[str]) -> DataFrame:
    """Per target (``key``) its nearest point within reach: ``sq``, the least ``ident`` on a tie, and ``carry``.

    ``targets`` come once per highest box that may hold it, with the columns of that box
    (see ``top``).  On every level a target keeps the boxes that are not farther than the
    greatest distance of its best one.  All rows of a target have the same ``place``; where
    they come dealt out by it, the highest level is judged where they lie.
    """
    dims = tree.dims
    open_ = ask(targets, dims).where(least(dims, "t", "b") <= square)
    for level in range(len(tree.levels) - 1, -1, -1):
        met = open_.select(*place, *key, cell, F.col("b_k").alias("_up"), least(dims, "t", "b").alias("_least"), most(dims, "t", "b").alias("_most"))
        limit = F.min("_most").over(W.partitionBy(*place, *key))
        kept = met.withColumn("_limit", limit).where("_least <= _limit").select(*key, cell, "_up")
        place = []
        under = below(tree, level).drop("w")
        under = prefixed(under, "b", (cell, "_up"))
        open_ = ask(kept.join(dealt(under), [cell, "_up"]), dims).where(least(dims, "t", "b") <= square)
    best = F.min(F.struct(most(dims, "t", "b").alias("sq"), F.col(f"b{ident}").alias("id"), *[F.col(f"b{c}").alias(c) for c in carry]))
    return open_.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.sq", F.col("_b.id").alias(ident), *[F.col(f"_b.{c}").alias(c) for c in carry])


def weight_within(tree: Tree, cell: str, targets: DataFrame, key: list[str], square: float) -> DataFrame:
    """Per target the weight of all points within reach, ``degree``: whole boxes where they lie inside, points at the rim.

    ``targets`` come as in ``nearest``.
    """
    dims = tree.dims
    open_ = ask(targets, dims)
    parts = []
    for level in range(len(tree.levels) - 1, -1, -1):
        known = cut_lineage(open_.where(least(dims, "t", "b") <= square).select(
            *key, cell, "b_k", "bw", (most(dims, "t", "b") <= square).alias("_inside")))
        parts.append(known.where("_inside").groupBy(*key).agg(F.sum("bw").alias("degree")))
        under = prefixed(below(tree, level), "b", (cell, "_up"))
        open_ = ask(known.where("NOT _inside").select(*key, cell, F.col("b_k").alias("_up")).join(dealt(under), [cell, "_up"]), dims)
    total = open_.where(most(dims, "t", "b") <= square).groupBy(*key).agg(F.sum("bw").alias("degree"))
    for p in parts:
        total = total.unionByName(p)
    return total.groupBy(*key).agg(F.sum("degree").alias("degree"))
