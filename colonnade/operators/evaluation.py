"""Losses and scores of predicted grids against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.constants import FIRST_INSTANCE_CLASS, IGNORE_LABEL
from colonnade.operators.aggregate import group_median
from colonnade.session import cut_lineage

AP_THRESHOLDS = tuple(range(50, 100, 5))  # percent


def _background(instance: str) -> Column:
    return (F.col(instance) < FIRST_INSTANCE_CLASS) | (F.col(instance) == IGNORE_LABEL)


def _scaled_abs(*cols: Column) -> Column:
    return sum((F.abs(c) for c in cols), F.lit(0.0))


#: Terms that come in two ways: as a variance and as a mean absolute deviation.
SPREADS = ("offset_variance", "disparity_variance")


def instance_terms(cells: DataFrame, frame: str, instance: str, disparity: bool = False) -> DataFrame:
    """Loss terms per (frame, instance) of cells with a predicted offset; spreads also as ``..._absolute``.

    ``cells``: r, c, off_y, off_x and, with ``disparity``, pred_d and gt_d.  Means come
    from one aggregate and go back to the cells by an equi-join; deviations are summed
    map-side.
    """
    keys = [frame, instance]
    pos = cells.where(F.col(instance) > 1000).withColumns(
        {"_py": F.col("r") + F.col("off_y"), "_px": F.col("c") + F.col("off_x")})
    means = [F.avg("r").alias("_my"), F.avg("c").alias("_mx"), F.avg("_py").alias("_ay"), F.avg("_px").alias("_ax")]
    if disparity:
        means.append(F.avg("pred_d").alias("_ad"))
    ref = pos.groupBy(*keys).agg(*means)
    if disparity:
        med = group_median(pos.where("gt_d <> 0"), keys, "gt_d", lower=True).withColumnRenamed("median", "_med")
        ref = ref.join(med, keys, "left")
    j = pos.join(ref, keys)
    n = F.count("*")

    def away(y: str, x: str) -> Column:
        return F.sum(_scaled_abs(F.col("_py") - F.col(y), F.col("_px") - F.col(x))) / n / 2

    terms = [n.alias("n"), away("_my", "_mx").alias("offset_mean"), ((F.var_pop("_py") + F.var_pop("_px")) / 2).alias("offset_variance"),
             F.when(n > 2, away("_ay", "_ax")).otherwise(0.0).alias("offset_variance_absolute")]
    if disparity:
        terms += [F.coalesce(F.sum(F.abs(F.col("pred_d") - F.col("_med"))) / n, F.lit(0.0)).alias("disparity_mean"),
                  F.var_pop("pred_d").alias("disparity_variance"),
                  F.when(n > 2, F.sum(F.abs(F.col("pred_d") - F.col("_ad"))) / n).otherwise(0.0).alias("disparity_variance_absolute")]
    return j.groupBy(*keys).agg(*terms)


def frame_loss(cells: DataFrame, frame: str, instance: str, weights: dict[str, float], modes: tuple[str, ...] = ("variance",)) -> DataFrame:
    """Weighted loss per frame and mode: instance terms plus the offsets (and values) of background cells.

    A mode says how spreads are measured, by ``variance`` or ``absolute``; all modes come
    from one pass.  Cells of an instance class without an instance (11..1000 but 255)
    count nowhere.
    """
    disparity = "disparity_mean" in weights
    inst = instance_terms(cells, frame, instance, disparity)
    sums = inst.groupBy(frame).agg(*[F.sum(k).alias(k) for k in inst.columns if k not in (frame, instance, "n")])
    n = F.count("*")
    quiet = [(F.sum(_scaled_abs(F.col("off_y"), F.col("off_x"))) / n / 2).alias("_bg_offset")]
    if disparity:
        quiet.append((F.sum(F.abs("pred_d")) / n).alias("_bg_disparity"))
    back = cells.where(_background(instance)).groupBy(frame).agg(*quiet)
    j = sums.join(back, frame, "full_outer")
    rows = []
    for mode in modes:
        part = {k: F.coalesce(F.col(f"{k}_absolute" if mode == "absolute" and k in SPREADS else k), F.lit(0.0)) for k in weights}
        part["offset_mean"] = part["offset_mean"] + F.coalesce("_bg_offset", F.lit(0.0))
        if disparity:
            part["disparity_mean"] = part["disparity_mean"] + F.coalesce("_bg_disparity", F.lit(0.0))
        loss = sum((w * part[k] for k, w in weights.items()), F.lit(0.0))
        rows.append(F.struct(F.lit(mode).alias("mode"), *[c.alias(k) for k, c in part.items()], loss.alias("loss")))
    return j.select(frame, F.explode(F.array(*rows)).alias("_term")).select(frame, "_term.*")


def nll(costs: DataFrame, truth: DataFrame, cell: list[str], batch: str, cls: str, cost: str, absent: str) -> DataFrame:
    """Mean cost of the true class per batch; ignored cells are left out.

    A class without a cost row takes the cell's ``absent`` cost.
    """
    wanted = truth.where(F.col(cls) != IGNORE_LABEL)
    j = wanted.join(costs.select(*cell, cls, cost), [*cell, cls], "left")
    return j.groupBy(batch).agg(F.count("*").alias("n"), F.avg(F.coalesce(cost, absent)).alias("loss"))


def smooth_l1(x: Column) -> Column:
    return F.when(F.abs(x) < 1, 0.5 * x * x).otherwise(F.abs(x) - 0.5)


def confusion(cells: DataFrame, gt: str, pred: str) -> DataFrame:
    return cells.groupBy(gt, pred).agg(F.count("*").alias("n"))


def iou_from_confusion(conf: DataFrame, gt: str, pred: str) -> DataFrame:
    """TP / (TP + FP + FN) per class, from one pass over the (small) confusion matrix."""
    told = conf.select(F.explode(F.array(
        F.struct(F.col(gt).alias("cls"), F.col("n").alias("row"), F.lit(0).cast("bigint").alias("col")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("row"), F.col("n").alias("col")))).alias("s"),
        F.when(F.col(gt) == F.col(pred), F.col("n")).otherwise(0).alias("hit"))
    sums = told.groupBy("s.cls").agg(F.sum("s.row").alias("n_gt"), F.sum("s.col").alias("n_pred"), (F.sum("hit") / 2).alias("tp"))
    return sums.select("cls", "n_gt", "n_pred", (F.col("tp") / (F.col("n_gt") + F.col("n_pred") - F.col("tp"))).alias("iou"))


def pair_counts(cells: DataFrame, frame: str, gt: str, pred: str) -> DataFrame:
    """Cells per expected and predicted instance: the one pass over the cells, written, as areas and overlaps all read it."""
    return cut_lineage(cells.groupBy(frame, gt, pred).agg(F.count("*").alias("inter")))


def areas(pairs: DataFrame, frame: str, k: str) -> DataFrame:
    return pairs.where(F.col(k) > 1000).groupBy(frame, k).agg(F.sum("inter").alias(f"{k}_area"))


def instance_overlap(pairs: DataFrame, frame: str, gt: str, pred: str) -> DataFrame:
    """Intersections of expected and predicted instances of one class, with both areas, from ``pair_counts``."""
    same = F.floor(F.col(gt) / 1000) == F.floor(F.col(pred) / 1000)
    inter = pairs.where((F.col(gt) > 1000) & (F.col(pred) > 1000) & same)
    return inter.join(areas(pairs, frame, gt), [frame, gt]).join(areas(pairs, frame, pred), [frame, pred])


def average_precision(cells: DataFrame, frame: str, gt: str, pred: str) -> DataFrame:
    """AP per class and overlap threshold, all predictions with one confidence.

    Above half overlap a pair is unique, so matches are counted, not searched.  With a
    single confidence the curve runs from (recall 0, precision 1) to one point.
    """
    counted = pair_counts(cells, frame, gt, pred)
    pairs = instance_overlap(counted, frame, gt, pred).withColumn("cls", F.floor(F.col(gt) / 1000).cast("int"))
    union = F.col(f"{gt}_area") + F.col(f"{pred}_area") - F.col("inter")
    hits = [F.sum(F.when(F.col("inter") * 100 > union * th, 1).otherwise(0)) for th in AP_THRESHOLDS]
    tp = pairs.groupBy("cls").agg(F.array(*hits).alias("tp"))
    count = {}
    for k, name in ((gt, "n_gt"), (pred, "n_pred")):
        count[name] = areas(counted, frame, k).groupBy(F.floor(F.col(k) / 1000).cast("int").alias("cls")).agg(F.count("*").alias(name))
    per = count["n_gt"].join(count["n_pred"], "cls", "left").join(tp, "cls", "left")
    zeros = F.array(*[F.lit(0).cast("bigint")] * len(AP_THRESHOLDS))
    rows = per.select("cls", "n_gt", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.posexplode(F.coalesce("tp", zeros)).alias("k", "tp"))
    recall, precision = F.col("tp") / F.col("n_gt"), F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    return rows.select("cls", (50 + 5 * F.col("k")).alias("threshold"), "tp", "n_gt", "n_pred",
                       (recall * (1 + precision) / 2).alias("ap"))
