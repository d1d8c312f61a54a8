"""Approximate nearest neighbours by balanced posting lists.

Nearness is the inner product.  All vectors are lifted to one length by one more
coordinate, so that the largest inner product is the smallest distance.  Centroids are
fitted on a bounded sample by splitting clusters until none is larger than its share.
A vector goes to the list of its nearest centroid and, if it lies near a boundary, to those
of other centroids that are hardly farther (``copy_ratio``, ``copies`` lists at most).
Centroids stand in a neighbour graph in memory; a query walks it, and the lists whose
centroid is at most ``ratio`` times as far as the nearest are searched.  ``ratio`` is the
smallest at which a search of the sample finds ``aim`` of its true neighbours.

Every vector is indexed.  Lists are packed into bins of about ``BIN_ROWS`` rows; a list that
is larger is dealt out over several bins by id and vector.  A bin goes to its task once:
the task holds the bin and lets the queries pass that ask for it, so what is shuffled is
linear in the vectors and in the lists that queries ask for.  Lists are ``most_lists`` at
most, since centroids travel with the tasks; beyond that they grow with the table, and the
cost of one query with them.

A query goes on until it has met as many different ids as it wants.  Where copies of a few
ids fill its lists, it is asked again with eight times as many rows, until it has enough.

* Vectors that are null, zero, or hold null or non-finite components take no part, and
  neither do rows without id.  A vector is searched among those of its own length.
* Repeated ids count once, with their largest inner product.  Ties go to the smaller id.
* With fewer candidates than asked for, a query gets them all; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

import colonnade.llm.common  # noqa: F401  code travels by value
from colonnade.session import cut_lineage

BIN_ROWS, LEAST_BINS = 32_768, 12


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # rows the centroids are fitted on
    most_lists: int = 4_096  # bound of what travels with the tasks
    list_rows: int = 400
    copies: int = 3
    copy_ratio: float = 1.1
    neighbours: int = 24  # of a centroid in the graph
    aim: float = 0.97
    seed: int = 11


def lift(x: np.ndarray, length: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(0.0, length ** 2 - (x ** 2).sum(axis=1)))))


def lift_query(q: np.ndarray, length: float) -> np.ndarray:
    return np.column_stack((q * (length / np.sqrt((q ** 2).sum(axis=1, keepdims=True))), np.zeros(len(q))))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x ** 2).sum(axis=1)[:, None] + (c ** 2).sum(axis=1) - 2 * x @ c.T))


def balanced_centroids(x: np.ndarray, most_rows: int, seed: int) -> np.ndarray:
    """Means of clusters that are split in up to eight, again and again, until each has ``most_rows`` rows or is one point."""
    rng, done, todo = np.random.default_rng(seed), [], [x]
    while todo:
        part = todo.pop()
        k = min(8, -(-len(part) // most_rows))
        distinct = np.unique(part, axis=0) if k > 1 else part[:1]
        if k == 1 or len(distinct) == 1:
            done.append(part.mean(axis=0))
            continue
        c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(8):
            own = distances(part, c).argmin(axis=1)
            c = np.stack([part[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        own = distances(part, c).argmin(axis=1)
        split = [part[own == j] for j in range(len(c)) if (own == j).any()]
        if len(split) == 1:
            done.append(part.mean(axis=0))
        else:
            todo += split
    return np.stack(done)


@dataclass
class Graph:
    """Centroids and the nearest others of each; a few far-spread ones are where searches enter."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(points: np.ndarray, neighbours: int) -> Graph:
        n = len(points)
        links = np.stack([np.argsort(row, kind="stable")[:neighbours + 1] for row in np.vstack([distances(points[i:i + 512], points) for i in range(0, n, 512)])])
        links = np.column_stack((links, (np.arange(n) + 1) % n))  # a ring, so that every centroid can be reached
        entries, far = [0], np.full(n, np.inf)
        while len(entries) < min(n, 16):
            far = np.minimum(far, distances(points[entries[-1:]], points)[0])
            entries.append(int(far.argmax()))
        return Graph(points, links, np.unique(entries))

    def search(self, x: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances from rows to the centroids they meet, infinite elsewhere: all rows walk at once.

        A row goes on from its nearest centroid not yet gone on from, until that is out of
        ``ratio`` times its best distance and at least ``least`` have been gone on from.
        """
        rows, n = np.arange(len(x)), len(self.points)
        squares = (self.points ** 2).sum(axis=1)
        met, open_ = np.full((len(x), n), np.inf), np.full((len(x), n), np.inf)

        def meet(who, nodes):
            fresh = np.isinf(met[who[:, None], nodes])
            d = np.sqrt(np.maximum(0.0, (x[who] ** 2).sum(axis=1)[:, None] + squares[nodes] - 2 * np.einsum("rd,rnd->rn", x[who], self.points[nodes])))
            met[who[:, None], nodes] = np.where(fresh, d, met[who[:, None], nodes])
            open_[who[:, None], nodes] = np.where(fresh, d, open_[who[:, None], nodes])

        meet(rows, np.broadcast_to(self.entries, (len(x), len(self.entries))))
        for step in range(n):
            best = open_[rows].argmin(axis=1)
            d = open_[rows, best]
            on = np.isfinite(d) & ((d <= ratio * met[rows].min(axis=1)) | (step < least))
            rows, best = rows[on], best[on]
            if not len(rows):
                break
            open_[rows, best] = np.inf
            meet(rows, self.links[best])
        return met


@dataclass
class Router:
    """Which lists a vector is kept in and which a query looks through."""

    graph: Graph
    length: float
    ratio: float
    settings: Settings

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        s = self.settings
        met = self.graph.search(lift(x, self.length), 1.0, 2 * s.copies)
        k = min(s.copies, met.shape[1])
        near = np.argsort(met, axis=1, kind="stable")[:, :k]
        d = np.take_along_axis(met, near, axis=1)
        return [n[ok] for n, ok in zip(near, d <= s.copy_ratio * d[:, :1] + 1e-12)]

    def lists(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> list[np.ndarray]:
        """By distance ratio, and on until the lists hold ``wanted`` ids."""
        lifted = lift_query(q, self.length)
        met, found = self.graph.search(lifted, self.ratio, 8), []
        for i, row in enumerate(met):
            take = np.flatnonzero(row <= self.ratio * row.min() + 1e-12)
            if sizes[take].sum() < wanted:  # too little within the ratio: by exact order, as far as needed
                order = np.argsort(distances(lifted[i:i + 1], self.graph.points)[0], kind="stable")
                take = order[np.cumsum(sizes[order]) - sizes[order] < wanted]
            found.append(take)
        return found


def best_of(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, vec_id, score) of the k best of each query: products choose, sums in one fixed order decide."""
    out, wanted = [[], [], []], k + len(v_ids) - len(np.unique(v_ids))  # repeated ids take no one's place
    for lo in range(0, len(q), 128):
        product = q[lo:lo + 128] @ v.T
        product[q_ids[lo:lo + 128, None] == v_ids[None, :]] = -np.inf
        for i, row in enumerate(product):
            bound = np.partition(row, -wanted)[-wanted] if len(row) > wanted else -np.inf
            at = np.flatnonzero(np.isfinite(row) & (row >= bound - 1e-9 * (1 + abs(bound)) if np.isfinite(bound) else np.isfinite(row)))
            score = (v[at] * q[lo + i]).sum(axis=1)
            keep = np.lexsort((v_ids[at], -score))
            if wanted > k:
                keep = keep[np.sort(np.unique(v_ids[at][keep], return_index=True)[1])]
            keep = keep[:k]
            out[0].append(np.full(len(keep), lo + i)), out[1].append(v_ids[at][keep]), out[2].append(score[keep])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def fit(sample: np.ndarray, length: float, rows: int, s: Settings) -> Router:
    """Centroids, graph and ratio from the sample; ``rows`` is how many vectors there are in all."""
    lists = int(np.clip(min(rows / s.list_rows, 16 + np.sqrt(rows) / 2), 1, s.most_lists))
    x = lift(sample, length)
    graph = Graph.build(balanced_centroids(x, max(1, -(-len(x) // lists)), s.seed), s.neighbours)
    router = Router(graph, length, 1.0, s)
    homes = router.homes(sample)
    kept = np.zeros((len(sample), len(graph.points)), bool)
    kept[np.repeat(np.arange(len(sample)), [len(h) for h in homes]), np.concatenate(homes)] = True
    pick = np.random.default_rng(s.seed).choice(len(sample), min(256, len(sample)), replace=False)
    product = sample[pick] @ sample.T
    product[np.arange(len(pick)), pick] = -np.inf
    true = np.argsort(-product, axis=1)[:, :min(20, max(1, len(sample) - 1))]
    met = distances(lift_query(sample[pick], length), graph.points)
    for ratio in np.arange(1.02, 2.0, 0.02):
        open_lists = met <= ratio * met.min(axis=1, keepdims=True)
        found = np.mean([(kept[t] & o).any(axis=1).mean() for t, o in zip(true, open_lists)])
        if found >= s.aim:
            break
    return Router(graph, length, float(ratio), s)


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    ok = vectors.where(F.col(ident).isNotNull() & v.isNotNull() & F.coalesce(finite & some, F.lit(False)))
    return ok.select(F.col(ident).cast("bigint").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, ident: str, vector: str, is_query: Column, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows where ``is_query`` (over ``vec_id``) holds, against all rows of the same length."""
    everything = cut_lineage(usable(vectors, ident, vector).dropDuplicates(["vec_id", "v"]))
    lengths = sorted(r[0] for r in everything.where(is_query).select(F.size("v")).distinct().collect())
    if not lengths:
        return everything.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    met = reduce(DataFrame.unionByName, [meetings(everything.where(F.size("v") == d), d, is_query, k, settings) for d in lengths])
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))  # k rows per bin at most
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def meetings(everything: DataFrame, d: int, is_query: Column, k: int, settings: Settings) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the best of every bin among vectors of the one length ``d``."""
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows, ids, length = everything.agg(F.count("*"), F.count_distinct("vec_id"), F.sqrt(F.max(squares))).first()
    length = length * (1 + 1e-12)
    drawn = everything.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(min(settings.sample, 8_000_000 // d + 64))
    router = fit(np.stack(drawn.toPandas()["v"].to_numpy()).astype(float), length, rows, settings)

    def assign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                homes = router.homes(matrix(part.column("v")))
                took = pa.array(np.repeat(np.arange(len(homes)), [len(h) for h in homes]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes).astype(np.int32)), part.column("vec_id").take(took), part.column("v").take(took)],
                                                 names=["list", "vec_id", "v"])

    element = everything.schema["v"].dataType
    kept = cut_lineage(everything.mapInArrow(assign, T.StructType().add("list", T.IntegerType()).add("vec_id", T.LongType()).add("v", element)))
    held, different = np.zeros((2, len(router.graph.points)), np.int64)
    for row in kept.groupBy("list").agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("ids")).collect():  # at most settings.most_lists rows
        held[row["list"]], different[row["list"]] = row["rows"], row["ids"]
    first_bin, bins_of = pack(held)
    n_bins = int((first_bin + bins_of).max())
    places = F.array(*[F.lit(int(b)) for b in first_bin]), F.array(*[F.lit(int(b)) for b in bins_of])
    put = places[0][F.col("list")] + F.pmod(F.xxhash64("vec_id", "v"), places[1][F.col("list")]).cast("int")
    meeting = T.StructType().add("bin", T.IntegerType()).add("side", T.IntegerType()).add("id", T.LongType()).add("v", element).add("lists", T.ArrayType(T.IntegerType()))
    binned = kept.select(put.alias("bin"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", F.array("list").alias("lists"))

    def routed(asked: DataFrame, wanted: int) -> DataFrame:
        """Queries once per bin that holds lists of theirs."""
        def route(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    out: list[tuple[int, int, list[int]]] = []
                    for i, chosen in enumerate(router.lists(matrix(part.column("v")), different, wanted)):
                        by_bin: dict[int, list[int]] = {}
                        for c in chosen.tolist():
                            for b in range(first_bin[c], first_bin[c] + bins_of[c]):
                                by_bin.setdefault(int(b), []).append(c)
                        out += [(i, b, c) for b, c in by_bin.items()]
                    took = pa.array([o[0] for o in out], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int32()), pa.array([1] * len(out), pa.int32()), part.column("vec_id").take(took),
                                                      part.column("v").take(took), pa.array([o[2] for o in out], pa.list_(pa.int32()))], names=meeting.names)

        return asked.select("vec_id", "v").mapInArrow(route, meeting)

    def meet(batches):
        """Rows come sorted by bin, its vectors before the queries: a bin is held, queries pass."""
        now, vectors, table = None, [], None
        for batch in batches:
            bins, sides = batch.column("bin").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(bins) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bins)]):
                part = batch.slice(lo, hi - lo)
                if bins[lo] != now:
                    now, vectors, table = bins[lo], [], None
                if not sides[lo]:
                    vectors.append((matrix(part.column("v")), part.column("id").to_numpy(), part.column("lists").flatten().to_numpy()))
                    continue
                if table is None and vectors:
                    table = tuple(np.concatenate(x) for x in zip(*vectors))
                if table is not None:
                    for some in range(0, part.num_rows, 2048):
                        yield best_in_bin(part.slice(some, 2048), *table, k)

    def found(asked: DataFrame, wanted: int) -> DataFrame:
        both = binned.unionByName(routed(asked, wanted))
        return both.repartition(n_bins, "bin").sortWithinPartitions("bin", "side").mapInArrow(meet, "query_id bigint, vec_id bigint, score double")

    queries, wanted = everything.where(is_query), 8 * k
    result = cut_lineage(found(queries, wanted))
    while wanted < different.sum():  # the last round asks for all there is
        few = result.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= min(k, ids - 1)).select(F.col("query_id").alias("vec_id"))
        short = cut_lineage(queries.join(few, "vec_id", "left_anti"))
        if short.isEmpty():
            break
        wanted *= 8
        result = result.unionByName(cut_lineage(found(short, wanted)))
    return result


def best_in_bin(queries: pa.RecordBatch, v: np.ndarray, v_ids: np.ndarray, lists: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` best of each query among the vectors of the lists that it asks for."""
    q, q_ids, wanted = matrix(queries.column("v")), queries.column("id").to_numpy(), queries.column("lists")
    owner = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
    asked, found = wanted.flatten().to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for c in np.unique(asked):
        who, at = owner[asked == c], np.flatnonzero(lists == c)
        if len(at):
            i, ids, score = best_of(q[who], q_ids[who], v[at], v_ids[at], k)
            found.append((q_ids[who][i.astype(np.int64)], ids, score))
    best = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*found)))))
    best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
    best = best.groupby("query_id", sort=False).head(k)
    return pa.RecordBatch.from_arrays([pa.array(best["query_id"].to_numpy(), pa.int64()), pa.array(best["vec_id"].to_numpy(), pa.int64()), pa.array(best["score"].to_numpy(), pa.float64())],
                                      names=["query_id", "vec_id", "score"])


def pack(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bin and number of bins of each list: large lists get bins of their own, the others share some."""
    bins_of = np.maximum(1, -(-sizes // BIN_ROWS))
    first, shared = np.zeros(len(sizes), np.int64), max(LEAST_BINS, int(-(-sizes[bins_of == 1].sum() // BIN_ROWS)))
    load = np.zeros(shared, np.int64)
    for c in np.argsort(-sizes, kind="stable"):
        if bins_of[c] == 1:
            first[c] = load.argmin()
            load[first[c]] += sizes[c]
    at = shared
    for c in np.flatnonzero(bins_of > 1):
        first[c], at = at, at + bins_of[c]
    return first, bins_of


def exact(vectors: DataFrame, ident: str, vector: str, is_query: Column, k: int) -> pd.DataFrame:
    """Brute force for small tables, to measure recall by."""
    data = usable(vectors, ident, vector).toPandas()
    v, ids = np.stack(data["v"].to_numpy()).astype(float), data["vec_id"].to_numpy()
    q_ids = np.array([r[0] for r in usable(vectors, ident, vector).where(is_query).select("vec_id").collect()])
    q = v[[int(np.flatnonzero(ids == i)[0]) for i in q_ids]]
    row, found, score = best_of(q, q_ids, v, ids, k)
    return pd.DataFrame({"query_id": q_ids[row.astype(int)], "vec_id": found, "score": score})
