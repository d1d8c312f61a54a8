"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from colonnade.plans.views import VIEWS, view_closure

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERY_MODULES = (
    "ingest", "resample", "aggregate", "joining", "folding", "segmenting",
    "clustering", "geometry", "evaluating", "sweeping", "streams", "frames",
)


class Tables:
    """Lazily opened tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._open:
            if name in TABLES:
                self._open[name] = self.spark.read.parquet(self.path(name))
            elif name in VIEWS:
                text = VIEWS[name]
                parts = {n: getattr(self, n) for n in (*TABLES, *VIEWS) if "{%s}" % n in text}
                self._open[name] = self.spark.sql(text, **parts)
            else:
                raise AttributeError(name)
        return self._open[name]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``views`` become leading common table expressions of ``sql``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, with_views(sql, views) if sql else None)
        return fn

    return add


def with_views(body: str, views: tuple[str, ...]) -> str:
    ctes = []
    for name in view_closure(views):
        text = VIEWS[name]
        for n in (*TABLES, *VIEWS):
            text = text.replace("{%s}" % n, n)
        ctes.append(f"{name} AS ({text})")
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + body


def load_all() -> dict[str, Query]:
    for module in QUERY_MODULES:
        importlib.import_module(f"colonnade.plans.{module}")
    return REGISTRY
