r"""Deletion of repeated line runs, by the ranks of a suffix array over line ids.

The lines of a document that hold a word form its sequence.  Suffixes are ranked by prefix doubling: a
rank by 2k lines is the sorted place of the pair of two ranks by k lines.  Suffixes of one rank
are an interval of the suffix array whose common prefix is that long; suffixes alone in their
interval cannot begin a repeat of that length and drop out of all further rounds.

A run of lines counts as repeated if it occurs earlier, in the order of documents and lines, and has
``min_words`` words or more; all lines of such a run are deleted, so the first copy stays.  A
maximal run is the union of the shortest pieces of ``min_words`` words that begin and end in
it.  Such a piece has ``min_words`` lines at most, so doubling stops there, and a piece of n lines
is named by the ranks of its first and its last 2^j <= n lines.

* Lines are what line feeds separate; equal means identical.  Blank lines are no part of runs and stay.
* Documents stand by id, null ids last; equal ids in any order.  Of repeated rows the first
  stays whole and the others lose all they repeat.
* A null text counts as empty.  Runs may overlap their own earlier copy.
* An empty table gives no rows.  Columns of any name pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.llm.common import WORD, cut_text, global_prefix, join_groups, text_of
from colonnade.session import cut_lineage


def ranked(suffixes: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc``, ``at``, ``keep`` and ``rank`` of the suffixes whose ``by`` occurs more than once; the rank is the number of smaller suffixes."""
    keyed = suffixes.withColumn("key", F.struct(*by))
    classes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    placed = cut_lineage(global_prefix(classes, [F.col(f"key.{c}") for c in by], "n").select("key", "n", F.col("g_before").alias("rank")))
    return cut_lineage(join_groups(keyed, placed, "key", "n", suffixes.count()).select("doc", "at", *keep, "rank"))


def shortest(words: Column, min_words: int) -> Column:
    """How many of the first of ``words`` it takes to reach ``min_words``; null if all are too few."""
    n = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("w")), lambda a, w: F.when(
        a["w"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["w"] + w).alias("w"))))
    return F.when(n["w"] >= min_words, n["n"])


def repeated_lines(lines: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """``doc`` and ``at`` of the lines to delete, from ``doc``, ``at``, ``h1``, ``h2`` and ``words``; ``places`` has the order of documents."""
    levels = [ranked(lines.drop("line"), ["h1", "h2"], ("words",))]
    while 2 ** len(levels) <= min_words:
        step, level = 2 ** (len(levels) - 1), levels[-1]
        after = level.select("doc", (F.col("at") - step).alias("at"), F.col("rank").alias("r2"))
        levels.append(ranked(level.withColumnRenamed("rank", "r1").join(after, ["doc", "at"]), ["r1", "r2"]))
    # only stretches of lines that all occur again can hold pieces of repeated runs
    stretch = F.col("at") - F.row_number().over(W.partitionBy("doc").orderBy("at"))
    along = W.partitionBy("doc", "stretch").orderBy("at")
    ahead = F.collect_list("words").over(along.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(along.rowsBetween(1 - min_words, 0)))
    sized = levels[0].withColumn("stretch", stretch).select("doc", "at", shortest(ahead, min_words).alias("n"), shortest(behind, min_words).alias("b"))
    either = F.explode(F.array_distinct(F.array(F.struct("at", "n"), F.struct((F.col("at") - F.col("b") + 1).alias("at"), F.col("b").alias("n")))))
    pieces = sized.select("doc", either.alias("p")).select("doc", "p.at", "p.n")
    pieces = cut_lineage(pieces.where("n is not null").distinct())
    named = None
    for j, level in enumerate(levels):
        own = pieces.where(F.col("n").between(2 ** j, 2 ** (j + 1) - 1))
        first = own.join(level.select("doc", "at", F.col("rank").alias("r1")), ["doc", "at"]).withColumn("end", F.col("at") + F.col("n") - 2 ** j)
        both = first.join(level.select("doc", F.col("at").alias("end"), F.col("rank").alias("r2")), ["doc", "end"])
        part = both.select("doc", "at", "n", F.struct("n", "r1", "r2").alias("key"))
        named = part if named is None else named.unionByName(part)
    named = cut_lineage(named.join(places, "doc"))
    spot = F.struct("place", "doc", "at")
    groups = named.groupBy("key").agg(F.count("*").alias("rows"), F.min(spot).alias("first")).where("rows > 1")
    later = join_groups(named, cut_lineage(groups), "key", "rows", named.count()).where(spot > F.col("first"))
    return later.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()


def dedup_lines(docs: DataFrame, ident: str, text: str, min_words: int = 10) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``deleted`` (line numbers from 0) and ``clean`` (the text that is left)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    base = cut_text(rows.withColumn("doc", F.monotonically_increasing_id()))
    whole, id_ = text_of(f"row.`{text}`"), F.col(f"row.`{ident}`")
    numbered = F.transform(F.split(whole, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    worded = base.select("doc", F.posexplode(F.filter(numbered, lambda e: e["x"].rlike(WORD))).alias("at", "e"))
    lines = cut_lineage(worded.select("doc", "at", F.col("e.line").alias("line"), F.xxhash64("e.x").alias("h1"), F.hash("e.x").alias("h2"),
                                      F.regexp_count("e.x", F.lit(WORD)).cast("bigint").alias("words")))
    places = base.select("doc", F.struct(id_.isNull().alias("none"), id_.alias("id")).alias("place"))
    gone = repeated_lines(lines, places, min_words).join(lines.select("doc", "at", "line"), ["doc", "at"])
    gone = gone.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    # the lines are split below the join, so that what is left is picked from an array that is there
    out = base.select("row", "doc", F.split(whole, "\n").alias("parts")).join(gone, "doc", "left")
    deleted = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), deleted), lambda i: F.element_at("parts", i + 1))
    return out.select("row", F.size("parts").alias("n_lines"), deleted.alias("deleted"), F.array_join(kept, "\n").alias("clean"))
