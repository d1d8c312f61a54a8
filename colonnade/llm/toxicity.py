"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of neighbouring pairs and of pairs with one word
between, hashed to ``2 ** BITS`` places.  Every place has its own learning rate, and the L1
bound keeps all but some hundreds of weights at zero, so the model is a few kilobytes
and travels with the tasks.  It is fitted on at most ``rows`` labelled documents (a
documented bound), in a seeded order, by one task that streams over them; scoring reads every
whole text.

* Null and empty texts have no features; their score is that of the bias alone.
* Without labelled rows every score is 0.  Repeated rows get equal scores.
* Very long texts are read in pieces; pairs across the cut between two pieces count too.
* Columns of any name pass through, as the score is an expression over the text column.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.samples import labelled_sample, pieces
from colonnade.session import cut_lineage

BITS = 20
SPREAD, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
BLANKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
KNOWN_WORDS = 500_000


def features(text: str, known: dict[bytes, int], weights: np.ndarray | None = None) -> np.ndarray:
    """Distinct feature places of a text; with ``weights`` only those that weigh something."""
    found, last = [], np.zeros(0, np.uint64)
    for piece in pieces(text.lower().encode()):
        words = piece.translate(BLANKS).split()
        if len(known) > KNOWN_WORDS:
            known.clear()
        h = np.fromiter((known.get(w) or known.setdefault(w, zlib.crc32(w)) for w in words), np.uint64, len(words))
        run = np.concatenate((last, h))
        for x in (h, run[:-1] * np.uint64(31) + run[1:] + np.uint64(1), run[:-2] * np.uint64(31) + run[2:] + np.uint64(1 << 34)):
            place = (x * SPREAD >> SHIFT).astype(np.int64)
            found.append(np.unique(place if weights is None else place[weights[place] != 0]))
        last = run[-2:]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Settings:
    rows: int = 16_000
    steps: int = 48_000  # passes over the sample are repeated until so many rows are learned from,
    most_passes: int = 8  # but no more often than this
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    seed: int = 5


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.places] = self.weights
        return w


class Learner:
    """FTRL-proximal state: sums of shifted gradients ``z`` and of squared gradients ``n`` per place."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, s = self.z[places], self.s
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[places])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def bias(self) -> float:  # the last place; not held back by L1 and L2
        return -self.z[-1] / ((self.s.beta + self.n[-1] ** 0.5) / self.s.alpha)

    def learn(self, places: np.ndarray, y: float) -> None:
        w, b = self.weights(places), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        all_places, all_w = np.append(places, 1 << BITS), np.append(w, b)
        n = self.n[all_places]
        self.z[all_places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * all_w
        self.n[all_places] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, ident: str, text: str, label: str, wanted: Column, settings: Settings = Settings()) -> Model | None:
    """Learns from the labelled rows for which ``wanted`` (over ``labels``) holds; ``settings.rows`` of them at most."""
    sample = labelled_sample(docs, labels, ident, text, label, wanted, settings.rows, settings.seed)

    def extract(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            f = [features(t.as_py(), known).astype(np.int32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(f, pa.list_(pa.int32()))], names=["y", "place", "f"])

    hashed = cut_lineage(sample.select("t", "y", "place").mapInArrow(extract, "y double, place string, f array<int>"))

    def learn(batches):
        learner, rows = Learner(settings), []
        for b in batches:
            rows += [(y, np.asarray(f.values)) for y, f in zip(b.column(0).to_pylist(), b.column(1))]
        for _ in range(min(settings.most_passes, -(-settings.steps // max(1, len(rows))))):
            for y, f in rows:
                learner.learn(f, y)
        if rows:
            w = learner.weights(np.arange(1 << BITS))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS), pa.int32()), pa.array(np.append(w[at], learner.bias()))], names=["place", "w"])

    # one task: the sample is bounded by settings.rows
    got = hashed.repartition(1).sortWithinPartitions("place").select("y", "f").mapInArrow(learn, "place int, w double").toPandas()
    if got.empty:
        return None
    return Model(got["place"].to_numpy()[:-1], got["w"].to_numpy()[:-1], float(got["w"].iloc[-1]))


def score(text: str, model: Model | None) -> Column:
    """Probability of label 1, from the whole text alone."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, known = model.dense(), {}
        for texts in batches:
            s = np.array([w[features(t or "", known, w)].sum() for t in texts], dtype=float) + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(s, -35, 35))))

    return scored(F.col(text))
