"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  A batch is digested, its
groups are held against the index by a sort-merge anti-join, and the digests that are
new are appended; a later batch therefore never repeats what an earlier one kept.

Texts are equal when they are the same after all white space (space, tab to carriage
return) is deleted.  Of equal texts in one batch the longest original stays, then the
smallest id; a text that an earlier batch brought stays there.

* A null text counts as empty; empty texts are one group.  A null id sorts last.
* Of rows that agree in id and text exactly one is kept.
* An empty batch appends nothing and gives no rows.
* Columns of any name pass through ``keep_unique`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import SPACE, join_groups, text_of
from colonnade.session import cut_lineage


def digest_of(text: str) -> Column:
    return F.sha2(F.regexp_replace(text_of(text), SPACE, ""), 256)


@dataclass(frozen=True)
class DigestIndex:
    """Handle of an index table; ``open`` it again in any later session by the same path."""

    spark: SparkSession
    table: str
    id_type: str

    @staticmethod
    def open(spark: SparkSession, table: str, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
        """Registers the table over ``path``, empty or filled.  ``buckets`` must stay what it was at first."""
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id {id_type}, keep_chars BIGINT, batch STRING) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path}'")
        return DigestIndex(spark, table, id_type)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        n = int(self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()["data_type"])
        (rows.select("digest", F.col("keep_id").cast(self.id_type), "keep_chars", "batch").repartition(n, "digest")
         .write.format("parquet").mode("append").bucketBy(n, "digest").sortBy("digest").saveAsTable(self.table))


def dedup_batch(docs: DataFrame, ident: str, text: str, index: DigestIndex, batch: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, ``text_sha256``, ``keep_id``, ``group_size``, ``kept``.

    Appends what is new under the name ``batch``; running a batch again changes nothing
    in the index and gives the same rows.
    """
    digests = cut_lineage(docs.select(
        F.col(ident).cast(index.id_type).alias("doc_id"), F.length(text_of(text)).cast("bigint").alias("n_chars"),
        digest_of(text).alias("digest")).withColumn("row_no", F.monotonically_increasing_id()))
    total = digests.count()
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    groups = cut_lineage(digests.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best")))
    new = groups.hint("merge").join(index.read().select("digest"), "digest", "left_anti")
    index.append(new.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"),
                            F.lit(batch).alias("batch")))
    known = groups.hint("merge").join(index.read(), "digest").select(
        "digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("best.row_no")).alias("keep_row"))
    return join_groups(digests, known, "digest", "group_size", total).select(
        "doc_id", "n_chars", F.col("digest").alias("text_sha256"), "keep_id", "group_size",
        F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"))


def keep_unique(docs: DataFrame, ident: str, text: str, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that the index does not hold from elsewhere, one of each group of equal texts."""
    kept = cut_lineage(dedup_batch(docs, ident, text, index, batch).where("kept").select(
        F.col("doc_id").alias("k_id"), F.col("n_chars").alias("k_chars"), F.col("text_sha256").alias("k_digest"), "group_size"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(ident).cast(index.id_type).alias("k_id"),
                       F.length(text_of(text)).cast("bigint").alias("k_chars"), digest_of(text).alias("k_digest"))
    on = ["k_digest", "k_chars"]
    # A hot group's losers go before anything is shuffled: the few hot winners are broadcast.
    total = docs.count()
    hot = F.broadcast(kept.where(F.col("group_size") * 64 > total).select("k_digest", F.col("k_id").alias("h_id"), F.col("k_chars").alias("h_chars"), F.lit(True).alias("hot")))
    rows = rows.join(hot, "k_digest", "left").where(F.col("hot").isNull() | (F.col("k_id").eqNullSafe(F.col("h_id")) & (F.col("k_chars") == F.col("h_chars"))))
    won = rows.drop("h_id", "h_chars", "hot").join(kept.withColumnRenamed("k_id", "w_id"), on).where(F.col("k_id").eqNullSafe(F.col("w_id")))
    single = won.where("group_size = 1").select("row.*")
    several = won.where("group_size > 1").groupBy("k_digest").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(several)
