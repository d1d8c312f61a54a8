r"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns.  Prefix sums of turn tokens choose
the cuts: a turn belongs to the stride its first token falls in, and a turn longer than
a stride stands alone, so the new turns of a window stay within two strides.  Every
window after the first repeats the system turn (a leading turn of role ``system``) and
the last turns of the conversation before it, as far as ``history`` tokens and what the
system turn and the new turns leave of the budget reach.  Only assistant turns that are
new in a window are under its loss mask, so each is a target exactly once.

Format of a turn: ``<turn>role\ntext</turn>\n``, or ``<past>...`` when it is repeated.
Inside roles and texts a backslash becomes ``\b`` and ``<`` becomes ``\l``, in roles a
line feed also ``\n``; so no control string can occur in them and the way back is exact.

* Null texts and roles count as empty.  A null conversation id is a conversation of its own.
* Turns stand by number, null numbers last; equal numbers by role, then text.  Repeated
  rows are turns of their own.
* A turn that is too long for the budget keeps its whole text, in a window that is over
  budget and repeats no other past turn; so does a system turn, in every window.
* An empty table gives no windows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.llm.common import WORD, global_prefix, join_groups, key_of
from colonnade.session import cut_lineage

NEW, PAST, END = "<turn>", "<past>", "</turn>\n"
#: Tokens that the marks of a turn count as, and the least stride beside a very long system turn.
MARKS, LEAST_STRIDE = 4, 32


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_turn(mark: str, role: Column, text: Column) -> Column:
    return F.concat(F.lit(mark), escape_role(role), F.lit("\n"), escape(text), F.lit(END))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = 512, history: int = 128) -> DataFrame:
    """``conv_id``, ``start`` (tokens of the conversation before the window), ``tokens``, ``text`` and
    ``loss`` (spans of ``text`` in code points: ``at`` from 0, ``n``)."""
    t = turns.select(F.col(conv).alias("conv_id"), key_of(conv).alias("c_key"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("bigint") + MARKS)
    order = [F.col("c_key"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    placed = global_prefix(t, order, "tokens").drop("g_total")
    total = turns.count()
    lead = F.min_by(F.struct("role", F.when(F.col("role") == "system", F.col("tokens")).alias("tokens")), "g_index")
    convs = placed.groupBy("c_key").agg(
        F.count("*").alias("c_rows"), F.min("g_before").alias("c_base"), F.min("g_index").alias("c_first"),
        lead.alias("c_lead"))
    convs = convs.select("c_key", "c_rows", "c_base", "c_first", F.coalesce("c_lead.tokens", F.lit(0)).alias("c_system_tokens"),
                         F.greatest(F.lit(LEAST_STRIDE), F.floor((budget - history - F.coalesce(F.col("c_lead.tokens"), F.lit(0))) / 2)).alias("stride"))
    at = join_groups(placed, cut_lineage(convs), "c_key", "c_rows", total).withColumn("before", F.col("g_before") - F.col("c_base"))
    at = at.withColumn("w_no", F.floor(F.col("before") / F.col("stride"))).withColumn("w_large", F.col("tokens") > F.col("stride"))
    at = at.withColumn("c_system", (F.col("g_index") == F.col("c_first")) & (F.col("role") == "system"))
    w = W.partitionBy("c_key", "w_no", "w_large")
    at = at.withColumn("w_start", F.min("before").over(w)).withColumn("w_end", F.max(F.col("before") + F.col("tokens")).over(w))
    fields = ["conv_id", "c_key", "g_index", "tokens", "role", "text"]
    new = at.select(*fields, F.col("w_start").alias("start"), F.lit(True).alias("new"))
    # a turn can be past to windows that start at most ``history`` tokens after it: they meet in stretches of that many tokens
    room = F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("c_system_tokens") - (F.col("w_end") - F.col("w_start"))))
    later = at.where("w_start > 0").groupBy("c_key", F.col("w_start").alias("start")).agg(F.first(room).alias("room")).where("room > 0")
    reach = F.floor(F.col("before") / max(1, history))
    earlier = at.where(~F.col("c_system") & (F.col("tokens") <= history)).select(*fields, "before", F.explode(F.array(reach, reach + 1)).alias("stretch"))
    past = earlier.join(later.withColumn("stretch", F.floor(F.col("start") / max(1, history))), ["c_key", "stretch"]).where(
        (F.col("before") < F.col("start")) & (F.col("before") >= F.col("start") - F.col("room"))).select(*fields, "start", F.lit(False).alias("new"))
    line = F.when(F.col("new"), format_turn(NEW, F.col("role"), F.col("text"))).otherwise(format_turn(PAST, F.col("role"), F.col("text")))
    parts = new.unionByName(past).withColumn("line", line)
    skip = F.length(escape_role(F.col("role"))) + len(NEW) + 1
    loss_n = F.when(F.col("new") & (F.col("role") == "assistant"), F.length("line") - skip - len(END)).otherwise(-1)
    packed = parts.groupBy("c_key", "start").agg(
        F.first("conv_id").alias("conv_id"), F.sum("tokens").alias("tokens"),
        F.sort_array(F.collect_list(F.struct("g_index", "line", F.length("line").alias("n"), skip.alias("skip"), loss_n.alias("loss")))).alias("lines"))
    system = at.where("c_system").select("c_key", F.col("tokens").alias("s_tokens"), format_turn(PAST, F.col("role"), F.col("text")).alias("s_line"))
    packed = packed.join(system, "c_key", "left")
    head = F.when((F.col("start") > 0) & F.col("s_line").isNotNull(), F.col("s_line")).otherwise(F.lit(""))
    packed = packed.withColumn("head", head)
    walk = F.aggregate(
        "lines", F.struct(F.length("head").alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("spans")),
        lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.when(x["loss"] >= 0, F.concat(a["spans"], F.array(F.struct(
            (a["at"] + x["skip"]).alias("at"), x["loss"].alias("n"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return packed.select(
        "conv_id", "c_key", "start", (F.col("tokens") + F.when(F.col("head") != "", F.col("s_tokens")).otherwise(0)).alias("tokens"),
        F.concat("head", F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("text"), walk.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``text`` and ``loss`` alone: ``turns`` (new turns of the window, role and text) and ``losses`` (unescaped texts)."""
    blocks = F.filter(F.split("text", END), lambda x: x.startswith(NEW))
    body = F.transform(blocks, lambda x: F.substring(x, F.lit(len(NEW) + 1), F.length(x)))
    turns = F.transform(body, lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text")))
    losses = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["at"] + 1, s["n"])))
    return formatted.select("conv_id", "c_key", "start", F.length("text").cast("bigint").alias("chars"), turns.alias("turns"), losses.alias("losses"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows give back; a hash over a conversation needs all its windows in order."""
    read = read_back(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("start", F.size("turns").cast("bigint").alias("n"), whole.alias("turns"), F.array_join("losses", "").alias("loss"), "chars")
    convs = read.groupBy("c_key").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(part)).alias("parts"))
    loss = F.array_join("parts.loss", "")
    total = lambda name: F.aggregate(f"parts.{name}", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return convs.select("conv_id", total("n").alias("n_turns"), F.sha2(F.array_join("parts.turns", ""), 256).alias("turns_sha256"),
                        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))
