"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are taken as words (digits, letters and everything beyond ASCII; A-Z lowered).
Every run of ``size`` words of a test item is a window; an item of fewer words is one
window.  All windows form one automaton; a document's words run through it once, and a
word inside any occurrence of a window is hit.  Normalising keeps the length of a text
in bytes, so hits map back to places in the original.

The automaton works on short codes of words, each of equally many symbols, which keeps
its nodes narrow; words that no item holds share one code.  What a task holds is bounded:
the windows of one automaton (``windows``), a piece of a text as words, and a byte per
word of the text.  A benchmark of more windows is dealt to several automata; each takes
a pass of its own, and what they find in a document is joined.

* Null and empty texts have no words and no hits; null and empty items no windows.
* An item whose id is null counts for hits, but is not named.  Rows that repeat an id
  are one item with the windows of all of them.
* Repeated documents are scanned each on its own.  An empty benchmark finds nothing, an
  empty table gives no rows.
* Columns besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.common import cut_text, global_prefix, text_of
from colonnade.llm.samples import pieces

#: Words in the code points of a lowered text; the same in bytes is ``PLAIN``.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lowers A-Z and makes every byte outside of words a space.
PLAIN = bytes(c | 0x20 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SYMBOLS = "0123456789abcdef"
UNKNOWN = "-"
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("w", "words", "at", "n")])


def lowered(text: str):
    return F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_slices(items: DataFrame, ident: str, text: str, size: int, stretch: int) -> DataFrame:
    """``name`` and ``words``: the items in overlapping slices of at most ``stretch`` windows, and their number ``n``."""
    words = F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))
    w = items.select(F.col(ident).cast("string").alias("name"), words.alias("words")).where(F.size("words") > 0)
    count = F.greatest(F.size("words") - (size - 1), F.lit(1))
    cut = w.select("name", "words", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1, F.lit(stretch))).alias("from"))
    return cut.select("name", F.slice("words", F.col("from") + 1, stretch + size - 1).alias("words"),
                      F.least(F.col("n") - F.col("from"), F.lit(stretch)).cast("bigint").alias("n"))


def build(slices: list[tuple[str | None, list[str]]], size: int) -> dict:
    """Automaton over all windows, codes of their words, and the names of the items that hold a window."""
    known = sorted({w for _, words in slices for w in words})
    width = 1
    while len(SYMBOLS) ** width < len(known):
        width += 1
    codes = {}
    for k, word in enumerate(known):
        digits = []
        for _ in range(width):
            k, digit = divmod(k, len(SYMBOLS))
            digits.append(SYMBOLS[digit])
        codes[word.encode()] = "".join(digits)
    holders: dict[str, set] = {}
    for name, words in slices:
        coded = [codes[w.encode()] for w in words]
        for k in range(max(1, len(coded) - size + 1)):
            holders.setdefault("".join(coded[k:k + size]), set()).add(name)
    automaton = ahocorasick.Automaton()
    for window, names in holders.items():
        automaton.add_word(window, (len(window) // width, frozenset(names)))
    automaton.make_automaton()
    return {"automaton": automaton, "codes": codes, "width": width}


def hits(text: bytes, part: dict, size: int) -> tuple[np.ndarray, set]:
    """Which words of a normalised text are hit, and the sets of names of the windows found."""
    get, unknown, width, automaton = part["codes"].get, UNKNOWN * part["width"], part["width"], part["automaton"]
    flags, found, carry = bytearray(), set(), []
    for piece in pieces(text):
        coded = carry + [get(w, unknown) for w in piece.split()]
        base = len(flags) - len(carry)
        flags.extend(bytes(len(coded) - len(carry)))
        for end, (n, names) in automaton.iter("".join(coded)) if len(automaton) else ():
            last, inside = divmod(end + 1, width)
            if not inside:  # else it ends within the code of a word
                flags[base + last - n:base + last] = b"\1" * n
                found.add(names)
        carry = coded[max(0, len(coded) - size + 1):]  # windows may reach over the cut
    return np.frombuffer(flags, bool), found


def runs_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Stretches of neighbouring words that are hit: first word and number of words, place and length in code points."""
    if not hit.any():
        return []
    raw = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([0], (raw != 32).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    turn = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    first, after = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"w": int(a), "words": int(b - a), "at": int(points[start[a]]), "n": int(points[end[b - 1]] - points[start[a]])} for a, b in zip(first, after)]


def joined(runs: list[Row]) -> list[dict]:
    """The union of runs that several automata found."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["w"], r["words"])):
        if out and r["w"] <= out[-1]["w"] + out[-1]["words"]:
            last = out[-1]
            if r["w"] + r["words"] > last["w"] + last["words"]:
                last["words"], last["n"] = r["w"] + r["words"] - last["w"], r["at"] + r["n"] - last["at"]
        else:
            out.append(r.asDict())
    return out


def scan_part(docs: DataFrame, keep: list[str], text: str, slices: list, size: int) -> DataFrame:
    """One pass: ``keep``, ``n_words``, ``runs`` and ``items`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast({"slices": slices})
    schema = docs.select(*keep).schema.add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("items", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held.value
        if "automaton" not in part:  # built once by each worker, not sent
            part.update(build(part["slices"], size))
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1):
                plain = (t.as_py() or "").encode().translate(PLAIN)
                hit, found = hits(plain, part, size)
                names = {n for some in found for n in some if n is not None}
                rows.append((len(hit), runs_of(plain, hit), sorted(names)))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))),
                 pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=[*keep, "n_words", "runs", "items"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def scan(docs: DataFrame, ident: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = 10,
         windows: int = 1 << 16) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` (names of the items found, sorted) and ``spans`` per document.

    A span is a stretch of neighbouring words that are hit: ``at`` (code points from 0)
    and ``n`` in the original text.  ``windows`` bounds the windows of one automaton.
    """
    stretch = min(windows, 4096)
    slices = global_prefix(item_slices(items, item_id, item_text, size, stretch), [F.col("name"), F.col("words")], "n").select(
        "name", "words", F.floor(F.col("g_before") / windows).alias("part"))
    parts = [r["part"] for r in slices.select("part").distinct().orderBy("part").collect()] or [0]
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("t"))
    if len(parts) > 1:
        rows = cut_text(rows.withColumn("row_no", F.monotonically_increasing_id()))
    keep = [c for c in rows.columns if c != "t"]
    # a slice has at most ``stretch`` windows, so at most ``windows + stretch`` of them come to the driver at once
    passes = [scan_part(rows, keep, "t", [(r["name"], r["words"]) for r in slices.where(F.col("part") == p).collect()], size) for p in parts]
    found = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        union = F.udf(joined, T.ArrayType(RUN), useArrow=True)
        found = found.groupBy("row_no").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("runs", union("runs"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.transform("runs", lambda r: F.struct(r["at"], r["n"])).alias("spans"))
