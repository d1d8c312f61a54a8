"""Small fixed tables as expressions: a literal map costs no join and no shuffle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LITERAL_ROWS = 1024


def literal_map(table: dict) -> Column:
    if len(table) > MAX_LITERAL_ROWS:
        raise ValueError("table too large for a literal; join it instead")
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def lookup(key: Column, table: dict) -> Column:
    """``table[key]`` or null; for tables fixed at plan time."""
    return F.try_element_at(literal_map(table), key)
