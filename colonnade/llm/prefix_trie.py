"""The trie of conversation prefixes, without building a tree.

A conversation is rebuilt as the first turns of its thread's base and its own turns
after them.  Every distinct sequence of first turns is a node.  A node is known by its
depth and the sums, over its turns, of 128 bits of a hash of turn and place; these are
prefix sums, so a conversation of any length is scanned in blocks.

Whole sequences come first: identical rebuilt conversations collapse into one weighted
sequence with the list of who ends there, and an anti-join with the proper prefixes
leaves those that are leaves.  All figures of a node are then sums over the weighted
sequences that pass through it.  So is what lies below it: of the sequences through a
node the one with the least id owns it, a sequence owns all of its nodes from some depth
on, and what a subtree holds once is the rest of each sequence from there.

* Turns stand by number, null numbers first; equal numbers by role, then text.  Repeated
  rows are turns of their own.  Null roles and texts count as empty.
* Rows without a conversation id take no part; the id is an integer.
* A conversation with no turn left after rebuilding ends at the root.
* No conversations, no nodes: not even the root.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import WORD, global_prefix, join_groups
from colonnade.operators.scan import blocked_scan
from colonnade.session import cut_lineage

PARTS = ("h1", "h2", "h3", "h4")
#: Turns of one conversation that a task scans at a time.
BLOCK = 1 << 14


def node_key(depth: Column, sums) -> Column:
    """Name of the sequence of ``depth`` turns whose hashes add up to ``sums``."""
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]))


def placed_hash(turn_hash: Column, place: Column) -> list[Column]:
    """Four 32-bit numbers that tell a turn at a place from any other."""
    digest = F.md5(F.concat_ws(":", place.cast("string"), turn_hash))
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(len(PARTS))]


def rebuild(turns: DataFrame, conv: str, turn: str, role: str, text: str, thread: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``, ``n_turns``) and their rebuilt turns (``conv_id``, ``d`` from 1, ``h1``..``h4``, ``words``).

    The base of conversation c is c - c % ``thread``; the number of turns taken from it is
    the crc32 of c as text, modulo ``heads``.
    """
    t = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumns({"words": F.regexp_count("text", F.lit(WORD)).cast("bigint"),
                       "turn_hash": F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))})
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = global_prefix(t, order, "words").select("conv_id", "words", "turn_hash", "g_index")
    found = placed.groupBy("conv_id").agg(F.count("*").alias("own"), F.min("g_index").alias("start")).select(
        "*", (F.col("conv_id") - F.col("conv_id") % thread).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    found = cut_lineage(found)
    bases = found.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = cut_lineage(found.join(bases, "base", "left").withColumn(
        "taken", F.least(F.col("h"), F.coalesce(F.col("base_own"), F.lit(0)))))
    total = convs.agg(F.sum("own")).first()[0] or 0
    at = join_groups(placed, convs, "conv_id", "own", total).withColumn("pos", F.col("g_index") - F.col("start") + 1)
    own = at.where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "turn_hash", "words")
    lead = at.where((F.col("conv_id") % thread == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), "pos", "turn_hash", "words")
    shared = lead.join(convs.select("conv_id", "base", "taken"), "base").where(F.col("pos") <= F.col("taken")).select(
        "conv_id", F.col("pos").alias("d"), "turn_hash", "words")
    rebuilt = own.unionByName(shared)
    hashes = dict(zip(PARTS, placed_hash(F.col("turn_hash"), F.col("d"))))
    return (convs.select("conv_id", (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("taken")).alias("n_turns")),
            cut_lineage(rebuilt.withColumns(hashes).drop("turn_hash")))


def end_lists(whole: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256``: the hash of the ids that end at a node, ascending, comma-joined.

    Ids are strung together by ranges of ids before they meet, and a node's strings are
    hashed one after the other, so no task holds a whole list.
    """
    ranged = whole.select("key", "conv_id").repartitionByRange("conv_id").withColumn("block", F.spark_partition_id())
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = ranged.groupBy("key", "block").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.string()), "ends_sha256": pa.array([h for _, h in out], pa.string())})
            out = []
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    dealt = strings.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return dealt.mapInArrow(run, "key string, ends_sha256 string")


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         thread: int = 20, heads: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    convs, rebuilt = rebuild(turns, conv, turn, role, text, thread, heads)
    sums = [(f"s{p}", p, "sum") for p in PARTS]
    scanned = blocked_scan(rebuilt, ["conv_id"], "d", [*sums, ("before", "words", "sum_before")], block)
    key = node_key(F.col("d"), [F.col(f"s{p}") for p in PARTS])
    parent = node_key(F.col("d") - 1, [F.col(f"s{p}") - F.col(p) for p in PARTS])
    prefixes = cut_lineage(scanned.select("conv_id", "d", key.alias("key"), parent.alias("parent"), "words", "before"))
    root = node_key(F.lit(0), [F.lit(0)] * len(PARTS))

    # whole sequences, collapsed
    last = prefixes.groupBy("conv_id").agg(F.max_by("key", "d").alias("key"), F.sum("words").alias("total"))
    whole = cut_lineage(convs.join(last, "conv_id", "left").select(
        "conv_id", "n_turns", F.coalesce("key", root).alias("key"), F.coalesce("total", F.lit(0)).alias("total")))
    sequences = cut_lineage(whole.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("n_turns").alias("length"), F.first("total").alias("total")))
    rows = whole.agg(F.sum("n_turns")).first()[0] or 0
    own = join_groups(prefixes, sequences.select("conv_id", "length"), "conv_id", "length", rows)
    tops = sequences.select("conv_id", F.lit(0).cast("bigint").alias("d"), root.alias("key"), F.lit(None).cast("string").alias("parent"),
                            F.lit(0).cast("bigint").alias("before"), "length")
    paths = cut_lineage(own.select(*tops.columns).unionByName(tops))
    leaves = sequences.join(paths.where("d < length").select("key").distinct(), "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    # from what depth on a sequence owns its nodes
    total = paths.count()
    least = cut_lineage(paths.groupBy("key").agg(F.min("conv_id").alias("least"), F.count("*").alias("through")))
    owned = join_groups(paths, least, "key", "through", total).where(F.col("conv_id") == F.col("least")).groupBy("conv_id").agg(F.min("before").alias("owned"))
    weighted = cut_lineage(sequences.join(leaves, "conv_id", "left").join(owned, "conv_id", "left").select(
        "conv_id", "weight", "total", "owned", F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("length") + 1).alias("nodes")))
    rest = F.col("total") - F.col("before")
    once = F.coalesce(F.col("total") - F.greatest("before", "owned"), F.lit(0))
    saved = F.col("weight") * rest - F.when(F.col("owned").isNull(), 0).otherwise(once)
    nodes = cut_lineage(join_groups(paths, weighted, "conv_id", "nodes", total).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("d").alias("depth"), F.first("parent").alias("parent"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")))

    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = cut_lineage(nodes.select("key", "conv_id").join(children, "key").select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    below = join_groups(nodes.where(F.col("parent").isNotNull()), above.withColumnRenamed("n_children", "siblings"), "parent", "siblings", nodes.count())
    every = below.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_leaves", "saved_tokens").unionByName(
        nodes.where(F.col("parent").isNull()).select("key", "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_leaves", "saved_tokens"))
    return (every.join(above.select(F.col("parent").alias("key"), "n_children"), "key", "left").join(end_lists(whole), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
