"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the majority vote of the bits of its shingles' hashes.  The
fingerprint is cut into segments, each with a radius.  The table of a segment holds
every fingerprint under its own segment value; a fingerprint looks up all values in
the small Hamming ball around its own, and what it meets there is verified by the
complete distance.  If the radii plus one add up to more than the allowed distance,
some segment of any linked pair must be within its radius, so no link is lost.

Crowded values do not lead to all pairs.  Equal fingerprints are one class.  In a first
round all classes under one value are held against the smallest of them only, and the
links found are joined to components; the second round gives out links between
different components only.  Where a value is so crowded that even testing would be
quadratic, its classes meet at midpoints instead: two fingerprints differ in at most 2r
bits if and only if the balls of radius r around them share a point.

* Null and empty texts have the fingerprint zero, which is linked like any other.
* A text with fewer words than a shingle is one shingle.  Repeated shingles count again.
* Null ids come last; a component of nothing but null ids has a null name.
* Repeated rows have one fingerprint and so one component.  An empty table gives no rows.
* Texts of any length are hashed in pieces of bounded size, cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.common import bit_field, in_field, join_groups, text_of
from colonnade.operators.components import connected_components
from colonnade.session import cut_lineage

PIECE = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Counts in a profile of shingles, a power of two.
PROFILE = 256


@dataclass(frozen=True)
class Segment:
    """Bits ``shift`` to ``shift + width - 1`` of word ``word`` and the radius of the ball looked up."""

    word: int
    shift: int
    width: int
    radius: int

    def value(self) -> Column:
        return F.shiftrightunsigned(F.col("f")[self.word], self.shift).bitwiseAND(F.lit((1 << self.width) - 1))

    def ball(self) -> list[int]:
        flips = [b for r in range(self.radius + 1) for b in combinations(range(self.width), r)]
        return [sum(1 << x for x in b) for b in flips]


#: 64 bits, up to 4 of them different: (0 + 1) + (1 + 1) + (1 + 1) = 5 > 4.
FOUR_BITS = (Segment(0, 0, 22, 0), Segment(0, 22, 21, 1), Segment(0, 43, 21, 1))

def shingle_hashes(text: bytes, size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, A-Z lowered, in arrays of bounded length."""
    h, at, kept, some = xxhash.xxh64_intdigest, 0, [], False
    while at < len(text):
        cut = GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = kept + text[at:end].lower().split()
        at, last = end, end >= len(text)
        if len(words) < size:
            kept = words
            if last and words and not some:
                yield np.array([h(b" ".join(words), seed)], dtype="<u8")
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
        yield np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist())], dtype="<u8")
        some, kept = True, words[len(words) - size + 1:] if size > 1 else []


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of hash bits; word 0 is the hash itself, the others are scrambled from it."""
    if not k:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, size: int, words: int) -> list[int]:
    """``words`` signed 64-bit numbers; a bit is set if it is set in over half the hashes."""
    n, votes = 0, np.zeros((words, 64), dtype=np.int64)
    for h in shingle_hashes(text, size):
        n += len(h)
        for k in range(words):
            bits = np.unpackbits(mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, text: str, size: int, words: int = 1) -> DataFrame:
    """Adds ``f``, an array of ``words`` longs, and leaves out the text."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add("f", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            f = [fingerprint((t.as_py() or "").encode(), size, words) for t in texts]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(f, pa.list_(pa.int64()))], names=[*rest, "f"])

    return docs.select(*rest, text).mapInArrow(run, schema)


def distance(a: Column, b: Column, words: int) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(words)), F.lit(0))


def own_keys(segments) -> Column:
    return F.array(*[F.lit(i << 40).bitwiseOR(s.value()) for i, s in enumerate(segments)])


def ball_keys(segments) -> Column:
    return F.array(*[F.lit(i << 40).bitwiseOR(s.value().bitwiseXOR(F.lit(m))) for i, s in enumerate(segments) for m in s.ball()])


def roots_of(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` with ``root``; classes without a link are their own."""
    edges = cut_lineage(edges.distinct())
    ends = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    roots = connected_components(ends, edges).withColumnRenamed("v", "cls").withColumnRenamed("root", "c_root")
    return classes.join(roots, "cls", "left").withColumn("root", F.coalesce("c_root", "cls")).drop("c_root")


def link_classes(classes: DataFrame, segments=FOUR_BITS, limit: int = 4, crowded: int = 4096) -> DataFrame:
    """``cls`` and ``root`` for distinct one-word fingerprints ``f``, linked at ``limit`` or fewer different bits.

    ``cls`` is a long that names the class.  A value with over ``crowded`` classes goes
    by way of midpoints, which is exact as well.
    """
    entries = cut_lineage(classes.select("cls", "f", F.explode(own_keys(segments)).alias("key")))
    total = entries.count()
    buckets = cut_lineage(entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("cls", "f")).alias("least")).where("n > 1"))
    star = join_groups(entries, buckets, "key", "n", total).where(
        (F.col("cls") > F.col("least.cls")) & (distance(F.col("f"), F.col("least.f"), 1) <= limit))
    first = cut_lineage(star.select(F.col("cls").alias("a"), F.col("least.cls").alias("b")))
    tagged = cut_lineage(roots_of(classes, first))
    full = buckets.where(F.col("n") > crowded).select("key")
    table = tagged.select(F.explode(own_keys(segments)).alias("key"), F.col("cls").alias("t_cls"), F.col("f").alias("t_f"), F.col("root").alias("t_root"))
    probes = tagged.select(F.explode(ball_keys(segments)).alias("key"), "cls", "f", "root")
    some_full = full.take(1)
    if some_full:
        table = table.join(full, "key", "left_anti")
    met = (F.col("cls") < F.col("t_cls")) & (F.col("root") != F.col("t_root")) & (distance(F.col("f"), F.col("t_f"), 1) <= limit)
    links = probes.alias("p").join(table.alias("t"), (F.col("p.key") == F.col("t.key")) & met).select(
        F.least("root", "t_root").alias("a"), F.greatest("root", "t_root").alias("b"))
    if some_full:
        members = probes.join(full, "key", "left_semi").select("cls", "f", "root").distinct()
        links = links.unionByName(midpoint_links(members, limit))
    # what is left to join are the components of the first round, with one edge per pair of them
    joined = roots_of(tagged.select(F.col("root").alias("cls")).distinct(), links)
    return tagged.select("cls", F.col("root").alias("old")).join(joined.select(F.col("cls").alias("old"), "root"), "old").select("cls", "root")


def midpoint_links(members: DataFrame, limit: int) -> DataFrame:
    """Stars over shared midpoints: the component of every member is tied to the least one at each point in its ball."""
    if limit % 2:
        raise ValueError("midpoints need an even distance")
    ball = Segment(0, 0, 64, limit // 2).ball()
    signed = [m - (1 << 64) if m >> 63 else m for m in ball]
    points = members.select("root", F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("f")[0].bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("root").alias("a"), F.max("root").alias("most")).where("a < most")
    return points.join(least.drop("most"), "point").where("a < root").select("a", F.col("root").alias("b"))


def components(docs: DataFrame, ident: str, text: str, size: int = 4, limit: int = 4, crowded: int = 4096) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id reachable)."""
    marked = cut_lineage(fingerprints(docs.select(F.col(ident).alias("doc_id"), text_of(text).alias("t")), "t", size)
                         .select("doc_id", F.col("f")[0].alias("cls")))
    classes = cut_lineage(marked.groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")).withColumn("f", F.array("cls")))
    linked = cut_lineage(classes.drop("f").join(link_classes(classes.select("cls", "f"), limit=limit, crowded=crowded), "cls"))
    named = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(named, "root").select("cls", "rows", "component_id")
    return join_groups(marked, named, "cls", "rows", marked.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("cls"), 16, "0")).alias("fingerprint"), "component_id")


def parts(batches, rows: int = 512):
    """Batches of few rows, so that a worker holds the sets of a few texts at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def shingle_sets(docs: DataFrame, keep: list[str], text: str, size: int, wanted: tuple[str, np.ndarray] | None = None) -> DataFrame:
    """``keep`` and ``s``, the hashes of the text's distinct shingles; with ``wanted`` only of rows whose key the field may hold."""
    schema = docs.select(*keep).schema.add("s", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in parts(batches):
            if wanted:
                name, field = wanted
                batch = batch.filter(pa.array(in_field(field, batch.column(name).to_numpy())))
            sets = [np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes((t.as_py() or "").encode(), size)])).view("<i8") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(sets, pa.list_(pa.int64()))], names=[*keep, "s"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def common_shingles(docs: DataFrame, text: str, size: int, share: int = 16, least: int = 3, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in ``least`` or more texts of a ``share``-th of ``docs``, sorted, and in how many; at most ``most``, the commonest.

    They go last in the order of ``prefix``, which is right for any order; this one keeps
    passages that many texts share from bringing all of them together.
    """
    some = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(share)) == 0)
    found = shingle_sets(some.select(F.lit(0).alias("one"), text), ["one"], text, size).select(F.explode("s").alias("s"))
    counts = cut_lineage(found.groupBy("s").count().where(F.col("count") >= least))
    fewest, held = None, 0
    for row in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.col("count").desc()).collect():  # one row per count
        held += row["n"]
        if held > most:
            break
        fewest = row["count"]
    if fewest is None:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    common = counts.where(F.col("count") >= fewest).toPandas()
    s = common["s"].to_numpy().view("<u8")
    order = np.argsort(s)
    return s[order], common["count"].to_numpy()[order]


def prefix(shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a text's sorted distinct shingles: texts that are near share one of these.

    A near text holds at least ``similarity`` of the shingles, so it cannot do without all
    of the first ``n - ceil(similarity * n) + 1`` in an order that is the same for all texts.
    A text without words has the one shingle 0.
    """
    if not len(shingles):
        return np.zeros(1, "<u8")
    known, count = common
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        shingles = shingles[np.argsort(np.where(known[at] == shingles, count[at], 0), kind="stable")]
    n = len(shingles)
    return shingles[:n - int(np.ceil(similarity * n - 1e-9)) + 1]


def prefixes(docs: DataFrame, text: str, size: int, similarity: float, common: tuple[np.ndarray, np.ndarray], print_size: int = 0) -> DataFrame:
    """Adds ``n``, how many distinct shingles a text has, ``p``, the first of them, and ``h``, its profile; leaves out the text.

    The profile counts, in a byte each, the shingles with the same last ``log2(PROFILE)`` bits.
    With ``print_size`` also ``f``, the fingerprint over shingles of that size, from the same reading of the text.
    """
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add("n", T.IntegerType()).add("p", T.ArrayType(T.LongType())).add("h", T.BinaryType())
    if print_size:
        schema = schema.add("f", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in parts(batches):
            n, first, profile = [], [], []
            for t in batch.column(batch.num_columns - 1):
                s = np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes((t.as_py() or "").encode(), size)]))
                n.append(len(s)), first.append(prefix(s, similarity, common).view("<i8"))
                counts = np.bincount((s & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE)
                profile.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            added = {"n": pa.array(n, pa.int32()), "p": pa.array(first, pa.list_(pa.int64())), "h": pa.array(profile, pa.binary())}
            if print_size:
                texts = batch.column(batch.num_columns - 1)
                added["f"] = pa.array([fingerprint((t.as_py() or "").encode(), print_size, 1) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, *added.values()], names=[*rest, *added])

    return docs.select(*rest, text).mapInArrow(run, schema)


def alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """``a`` and ``b`` of the pairs (``a_n``, ``a_h``, ``b_n``, ``b_h``) whose profiles allow them to be near.

    Texts have no more shingles in common than the smaller counts of their profiles add
    up to, so no near pair goes.  Where both counts are full nothing is known.
    """
    def run(batches):
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(b"".join(column[c].to_pylist()), np.uint8).reshape(-1, PROFILE) for c in ("a_h", "b_h"))
            least = np.minimum(a, b)
            most = least.sum(axis=1, dtype=np.int64)
            n = column["a_n"].to_numpy().astype(np.int64) + column["b_n"].to_numpy()
            keep = ((least == 255).any(axis=1)) | (most * (1 + similarity) >= similarity * n - 1e-6)
            yield pa.RecordBatch.from_arrays([column[c].filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "a_n", "a_h", "b_n", "b_h").mapInArrow(run, "a long, b long")


def entries_of(classes: DataFrame, field: np.ndarray) -> DataFrame:
    """``key``, ``cls`` and ``pos`` of the prefix shingles that the field may hold; those that it surely does not are not shuffled."""
    def run(batches):
        for batch in batches:
            p = batch.column(1)
            held = np.diff(p.offsets.to_numpy())
            keys = p.flatten().to_numpy()
            cls = np.repeat(batch.column(0).to_numpy(), held)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(held) - held, held)
            keep = in_field(field, keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(cls[keep]), pa.array(pos[keep].astype(np.int32))], names=["key", "cls", "pos"])

    return classes.select("cls", "p").mapInArrow(run, "key long, cls long, pos int")


def may_be_near(similarity: float, n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Whether texts whose first common shingle stands at these places can have enough of them in common."""
    return F.least(n - pos, other_n - other_pos) * (1 + similarity) >= similarity * (n + other_n) - 1e-6


def near_links(classes: DataFrame, similarity: float, verified) -> DataFrame:
    """Links ``a``, ``b`` that have the same components as all near pairs of ``classes`` (``cls``, ``place``, ``n``, ``p``).

    Near texts share a shingle of their prefixes.  First all texts under a shingle are held
    against the first in place only, and what ``verified`` leaves of these pairs is joined to
    components.  Then all texts under a shingle are offered, but between different
    components only, so that a group of copies does not lead to all its pairs.
    """
    buckets = cut_lineage(classes.select(F.explode("p").alias("key")).groupBy("key").agg(F.count("*").alias("held")).where("held > 1"))
    entries = entries_of(classes, bit_field(buckets, "key"))
    total = classes.agg(F.sum(F.size("p"))).first()[0] or 0
    shared = join_groups(entries, buckets, "key", "held", total).select("key", "cls", "pos")
    shared = cut_lineage(shared.join(classes.select("cls", "place", "n"), "cls"))
    total = shared.count()
    least = shared.groupBy("key").agg(F.min(F.struct("place", "cls", "n", "pos")).alias("o"), F.count("*").alias("many"))
    star = join_groups(shared, cut_lineage(least), "key", "many", total).where(
        (F.col("cls") != F.col("o.cls")) & may_be_near(similarity, F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
    first = cut_lineage(verified(cut_lineage(star.select(F.least("cls", "o.cls").alias("a"), F.greatest("cls", "o.cls").alias("b")).distinct())))
    roots = roots_of(shared.select("cls").distinct(), first)
    tagged = cut_lineage(shared.select("key", "cls", "n", "pos").join(roots, "cls"))
    # whoever is not of a shingle's largest component meets all others under it
    largest = tagged.groupBy("key", "root").agg(F.count("*").alias("many")).groupBy("key").agg(
        F.max(F.struct("many", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.sum("many").alias("many")).where("roots > 1")
    open_ = cut_lineage(join_groups(tagged, cut_lineage(largest), "key", "many", total).select("key", "cls", "n", "pos", "root", "main"))
    x, y = open_.where(F.col("root") != F.col("main")).drop("main").alias("x"), open_.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once
                 & may_be_near(similarity, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    more = verified(cut_lineage(met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()))
    return first.unionByName(more)


def print_links(classes: DataFrame, limit: int) -> DataFrame:
    """Links ``a``, ``b`` that join the ``classes`` (``cls``, ``f``) of one SimHash component: a star around the least of each."""
    prints = cut_lineage(classes.select(F.col("f")[0].alias("print"), "cls"))
    groups = cut_lineage(prints.groupBy(F.col("print").alias("cls")).agg(F.min("cls").alias("least"), F.count("*").alias("held")))
    linked = cut_lineage(link_classes(groups.select("cls", F.array("cls").alias("f")), limit=limit))
    heads = cut_lineage(groups.join(linked, "cls").groupBy("root").agg(F.min("least").alias("head")))
    named = groups.join(linked, "cls").join(heads, "root").select(F.col("cls").alias("print"), "head", "held")
    star = join_groups(prints, cut_lineage(named), "print", "held", prints.count())
    return star.where(F.col("cls") != F.col("head")).select(F.col("head").alias("a"), F.col("cls").alias("b"))


def near_unique(docs: DataFrame, ident: str, text: str, size: int = 5, similarity: float = 0.8, print_size: int = 0, limit: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the smallest id stays.

    With ``print_size`` texts are linked by SimHash: fingerprints over shingles of that many
    words that differ in ``limit`` or fewer bits, found by multi-index hashing as in
    ``components``.  Few bits miss many texts with an edit, so these are linked as well:
    texts are near when ``similarity`` or more of their joint distinct ``size``-word
    shingles are common to both; groups are the components of all links.  Candidates come
    from the first shingles of every text in one order, which misses no near pair;
    profiles of the sets rule most of them out, and the rest is verified on the whole sets.
    Texts are not shuffled: where sets are needed, the texts are scanned, and only the
    sets of texts that a pair asks for go to a join.
    Texts without words are near each other.  Of rows that agree in id and text one stays.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(ident).alias("k_id"), F.xxhash64(text_of(text)).alias("k_text"), text_of(text).alias("t"))
    texts = keyed.select("k_id", "k_text", "t")
    same = F.col("k_id").eqNullSafe(F.col("r_id")) & (F.col("k_text") == F.col("r_text"))
    repeated = cut_lineage(texts.groupBy("k_id", "k_text").agg(F.count("*").alias("copies")).where("copies > 1").select(
        F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text")))
    once = texts.join(repeated, same, "left_anti").unionByName(
        texts.join(repeated, same, "left_semi").groupBy("k_id", "k_text").agg(F.first("t").alias("t")))
    place = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "cls")
    classes = cut_lineage(prefixes(once, "t", size, similarity, common_shingles(texts, "t", size), print_size)
                          .withColumn("cls", F.monotonically_increasing_id()).withColumn("place", place))

    def verified(pairs: DataFrame) -> DataFrame:
        """The near ones of the pairs ``a``, ``b`` of classes."""
        side = lambda k: classes.select(F.col("cls").alias(k), F.col("n").alias(f"{k}_n"), F.col("h").alias(f"{k}_h"))
        pairs = cut_lineage(alike(pairs.join(side("a"), "a").join(side("b"), "b"), similarity))
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        names = cut_lineage(classes.join(wanted, "cls").select("cls", F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text")))
        found = shingle_sets(texts, ["k_id", "k_text"], "t", size, ("k_text", bit_field(names, "r_text")))
        sets = cut_lineage(found.join(names, same).select("cls", "s"))
        if not repeated.isEmpty():
            sets = sets.dropDuplicates(["cls"])
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("a_s")), "a").join(
            sets.select(F.col("cls").alias("b"), F.col("s").alias("b_s")), "b")
        common = F.size(F.array_intersect("a_s", "b_s"))
        return both.where(common >= similarity * (F.size("a_s") + F.size("b_s") - common)).select("a", "b")

    edges = near_links(classes.select("cls", "place", "n", "p"), similarity, verified)
    if print_size:
        edges = edges.unionByName(print_links(classes.select("cls", "f"), limit))
    rooted = cut_lineage(roots_of(classes.select("cls", "k_id", "k_text"), edges))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "cls")).alias("best"))
    leaving = cut_lineage(rooted.join(best, "root").where(F.col("cls") != F.col("best.cls")).select(
        F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text")))
    kept = keyed.select("row", "k_id", "k_text").join(leaving, same, "left_anti")
    single = kept.join(repeated, same, "left_anti")
    several = kept.join(repeated, same, "left_semi").groupBy("k_text", "k_id").agg(F.first("row").alias("row"))
    return single.select("row.*").unionByName(several.select("row.*"))
