"""Mixing sources to target weights by capped water-filling.

Every source has a weight.  The words of the mix are shared by weight; a source whose
share exceeds ``max_epochs`` times its own words is clamped there, and the excess goes
to the others by weight, again and again until no share is above its limit.  A source
then gives each document as many whole repetitions as fit; the fractional repetition
goes to the documents that come first in a seeded order, as far as the target reaches,
so a source misses its target by half a document at most.

* A null source is a source of its own, the last one.  A null text has no words.
* Documents without words count nothing and get the whole repetitions only.
* Repeated rows are rows of their own; equal ones may be taken differently often.
* With no words at all every target is 0 and nothing is taken.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.llm.common import WORD, global_prefix, key_of, text_of
from colonnade.session import cut_lineage


def word_count(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``target`` for sources with ``weight`` and ``size``: one small aggregation per round of clamping.

    Every round clamps at least one source, in practice a few rounds do.  Only three
    sums per round reach the driver.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    limit = F.col("size") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        is_clamped = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level[0]) / F.lit(level[1])
        left = F.when(~is_clamped, F.col("weight"))
        n, used, open_weight = sources.agg(F.count(F.when(is_clamped, 1)), F.sum(F.when(is_clamped, limit)), F.sum(left)).first()
        if n == clamped or not open_weight:
            break
        clamped, level = n, (total * share - (used or 0.0), float(open_weight))
    if level is None:  # no source at all
        return sources.withColumn("target", limit)
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level[0]) / F.lit(level[1])))


def mix(docs: DataFrame, ident: str, text: str, source: str, weights: Sequence[float], carry: Sequence[str] = (),
        share: float = 1.0, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` and ``row`` (``carry``).

    Sources stand in code point order and take the weights in turn.  The seeded order of
    a source is cut into 4096 blocks by the first digits of a digest; totals per block
    give every block its place, so no source is ever held by one task.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(ident).cast("string"), F.lit("null")), text_of(text)))
    sized = cut_lineage(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry or [ident])]).alias("row"), F.col(ident).alias("doc_id"), F.col(source).alias("source"),
        key_of(source).alias("m_key"), word_count(text).alias("size"), order.alias("m_order")))
    sources = sized.groupBy("m_key", "source").agg(F.sum("size").alias("size"), F.count("*").alias("m_rows"))
    ranked = global_prefix(sources, [F.col("source").asc_nulls_last()], "size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("g_index") % len(weights) + 1).cast("int"))
    filled = water_fill(cut_lineage(ranked.select("m_key", "size", "m_rows", weight.alias("weight"))), share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut_lineage(filled.withColumnRenamed("size", "source_size").withColumn("m_whole", F.floor(epochs))
                       .withColumn("m_quota", F.col("target") - F.col("m_whole") * F.col("source_size")).drop("weight"))
    blocked = sized.withColumn("m_block", F.substring("m_order", 1, 3))
    blocks = blocked.groupBy("m_key", "m_block").agg(F.sum("size").alias("m_words"))
    upto = W.partitionBy("m_key").orderBy("m_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("m_before", F.coalesce(F.sum("m_words").over(upto), F.lit(0))).join(plan, "m_key")
    inside = W.partitionBy("m_key", "m_block").orderBy("m_order").rowsBetween(W.unboundedPreceding, -1)
    placed = blocked.withColumn("m_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        blocks.drop("m_words", "m_rows"), ["m_key", "m_block"])
    extra = (F.col("size") > 0) & (F.col("m_before") + F.col("m_inside") + F.col("size") / 2 < F.col("m_quota"))
    copies = F.col("m_whole") + F.when(extra, 1).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"),
                         (F.col("size") * copies).cast("bigint").alias("taken"), "row")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: every carried row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
