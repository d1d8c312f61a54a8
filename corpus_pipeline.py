"""From raw documents to token ids: the stages of a training-data pipeline, each over all rows its predecessor kept.

* A null text counts as empty in every stage; empty texts are one group of exact copies and
  are never rejected as toxic unless the labels say so of empty texts.
* Rows with a null id stay like any other; their groups keep the smallest id, nulls last.
  A null source is a source of its own and comes last among the weights.
* Of rows that agree in id and text exactly one stays after exact dedup.  The mixture then
  repeats whole rows as often as their source's target asks for.
* Columns of ``documents`` beyond the four that are read, whatever their names, pass through
  the first four stages untouched.  Without labels nothing is rejected; an empty table goes
  through all stages and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import exact_dedup, mixing, pieces, simhash, toxicity
from colonnade.llm.common import read_table
from colonnade.llm.queries import MODEL, fit_toxicity, fresh_index
from colonnade.session import cut_lineage

#: Documents with a toxicity score of this or more are rejected.
REJECT = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, does not reject."""
    return docs.where(toxicity.score("text", fit_toxicity(spark, docs, sf_dir)) < REJECT)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for white space."""
    return exact_dedup.keep_unique(docs, "doc_id", "text", fresh_index(spark), uuid.uuid4().hex)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that SimHash links as in ``op8_simhash``, or that share 0.8 or more of their five-word shingles."""
    return simhash.near_unique(docs, "doc_id", "text", size=5, similarity=0.8, print_size=4, limit=4)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.repeat_rows(mixing.mix(docs, "doc_id", "text", "source", (5, 2, 1), carry=docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``n_tokens``, one row per row of the mix."""
    coded = pieces.encode(docs, "doc_id", "text", pieces.read_model(MODEL))
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", exact_duplicates), ("near duplicates", near_duplicates),
          ("mixing", mixture), ("sentencepiece", token_ids)]

#: The first stage is a learned model, which SQL has no words for; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
