"""Quality by histogram gradient-boosted trees over document statistics.

Every text is summed up in a row of statistics (lengths, shares of kinds of bytes, repeated
words and lines, shapes of words and lines).  Trees are grown level by level on binned
statistics of at most ``rows`` labelled documents, a documented bound, and then flattened: a
complete tree of depth d is 2^d - 1 pairs of feature and threshold and 2^d leaves, so all rows of
a batch descend together by array look-ups.

* Null and empty texts have zero statistics and get the score the trees give those.
* Without labelled rows every score is 0.  Repeated rows get equal scores.
* Very long texts are read in pieces of a megabyte or so, cut at white space; counts add up
  over the pieces.  Only a pair of words over a cut is not seen, and a line over a cut
  counts as two.
* Columns of any name pass through, as the score is an expression over the text column.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.samples import labelled_sample, pieces


def members(chars: str) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars.encode())] = 1
    return m


KINDS = np.stack([members(string.ascii_uppercase), members(string.ascii_lowercase), members(string.digits), members(".,;:?"), members("!"),
                  members("#$%&*"), members("|"), members("<>{}[]()=/\\"), members("@_~^+"), members("'\"-"), members(" \t"), members("\n\r"),
                  np.arange(256) >= 128]).astype(float)
NAMES = ("log_bytes", "log_words", "log_lines", "mean_word", "longest_word", "distinct_words", "top_word", "distinct_pairs", "shouted_words",
         "marked_words", "short_words", "mean_line", "distinct_lines", "full_lines", "short_lines", "byte_entropy", *(f"kind_{i}" for i in range(len(KINDS))))


def statistics(text: bytes) -> list[float]:
    seen, words, lines, pairs = np.zeros(256), Counter(), Counter(), set()
    n_words = longest = shouted = marked = short = n_lines = line_chars = full = brief = n_pairs = 0
    for piece in pieces(text):
        seen += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        w = piece.split()
        words.update(w)
        if w:
            n = np.fromiter(map(len, w), np.int64, len(w))
            n_words, longest, short = n_words + len(w), max(longest, int(n.max())), short + int((n <= 3).sum())
            pairs.update(zip(w, w[1:]))
            n_pairs += len(w) - 1
        for line in piece.split(b"\n"):
            line = line.strip()
            if line:
                n_lines, line_chars = n_lines + 1, line_chars + len(line)
                full, brief = full + (line[-1:] in b".?!:;\""), brief + (len(line) < 30)
                lines[line] += 1
    for w, n in words.items():
        shouted += n * (len(w) > 1 and w.isupper())
        marked += n * (w[-1] in b"#$%&*!|")
    total, per_word, per_line = seen.sum(), max(n_words, 1), max(n_lines, 1)
    p = seen[seen > 0] / max(total, 1)
    return [np.log1p(total), np.log1p(n_words), np.log1p(n_lines), total / per_word, longest, len(words) / per_word, max(words.values(), default=0) / per_word,
            len(pairs) / max(n_pairs, 1), shouted / per_word, marked / per_word, short / per_word, line_chars / per_line, len(lines) / per_line, full / per_line,
            brief / per_line, float(-(p * np.log2(p)).sum()), *(KINDS @ seen / max(total, 1))]


def table_of(texts) -> np.ndarray:
    return np.array([statistics((t or "").encode()) for t in texts], dtype=float).reshape(-1, len(NAMES))


@dataclass(frozen=True)
class Settings:
    rows: int = 16_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    l2: float = 5.0
    least_rows: int = 20
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``feature`` and ``threshold`` of the inner nodes, ``leaf`` values; one row per tree, nodes in heap order."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, s: Settings) -> Model:
    """Boosts trees on the histograms of binned columns by first and second derivatives of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    margin, inner = np.full(len(y), base), 2 ** s.depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(s.depth):
            first, count = 2 ** level - 1, 2 ** level
            slot = (node - first) * s.bins
            best = np.full(count, 1e-9)
            split_at = np.full(count, s.bins)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cum = [np.cumsum(np.bincount(slot + binned[j], v, count * s.bins).reshape(count, s.bins), axis=1) for v in (g, h, np.ones(len(y)))]
                (gl, gt), (hl, ht), (nl, nt) = ((c[:, :-1], c[:, -1:]) for c in cum)
                gain = gl ** 2 / (hl + s.l2) + (gt - gl) ** 2 / (ht - hl + s.l2) - gt ** 2 / (ht + s.l2)
                gain[(nl < s.least_rows) | (nt - nl < s.least_rows)] = -1
                gain[:, len(e):] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                won = np.flatnonzero(top > best)
                best[won], split_at[won] = top[won], at[won]
                feature[first + won], threshold[first + won] = j, e[at[won]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_no = node - inner
        value = -s.rate * np.bincount(leaf_no, g, inner + 1) / (np.bincount(leaf_no, h, inner + 1) + s.l2)
        margin += value[leaf_no]
        features.append(feature), thresholds.append(threshold), leaves.append(value)
    return Model(np.array(features), np.array(thresholds), np.array(leaves), base)


def fit(docs: DataFrame, labels: DataFrame, ident: str, text: str, label: str, wanted: Column, settings: Settings = Settings()) -> Model | None:
    """Learns from the labelled rows for which ``wanted`` (over ``labels``) holds; ``settings.rows`` of them at most.

    The statistics of the sample, ``settings.rows`` rows of some thirty numbers, come to the driver.
    """
    sample = labelled_sample(docs, labels, ident, text, label, wanted, settings.rows, settings.seed)

    def extract(batches):
        for b in batches:
            x = table_of(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "place", "x"])

    got = sample.select("t", "y", "place").mapInArrow(extract, "y double, place string, x array<double>").toPandas().sort_values("place")
    return grow(np.stack(got["x"].to_list()), got["y"].to_numpy(), settings) if len(got) else None


def score(text: str, model: Model | None) -> Column:
    """Probability of label 1, from the whole text alone."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(table_of(texts)))

    return scored(F.col(text))
