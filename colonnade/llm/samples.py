"""Bounded samples of labelled rows for training, and texts in pieces of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import text_of

PIECE = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """The whole text in order, cut at white space after about a megabyte each."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def remainder(ident: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; what folds are made by.  A null id gives null."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, ident: str, text: str, label: str, wanted: Column, rows: int, seed: int) -> DataFrame:
    """``t`` and ``y`` of at most ``rows`` labelled documents for which ``wanted`` holds, in a seeded ``place``.

    The ids are drawn before any text is read.  Several labels of an id count as their
    greatest; of equal texts only the one first in place is learned from, so copies of one
    wrong label weigh once.
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    drawn = (labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull() & wanted).groupBy(F.col(ident).alias("s_id"))
             .agg(F.max(label).cast("double").alias("y"), F.first(place).alias("place")).orderBy("place").limit(rows))
    found = docs.select(F.col(ident).alias("s_id"), text_of(text).alias("t")).join(F.broadcast(drawn), "s_id")  # at most ``rows`` ids
    return found.groupBy(F.xxhash64("t").alias("s_text")).agg(
        F.min_by(F.struct("t", "y", "place"), "place").alias("s")).select("s.t", "s.y", "s.place")
