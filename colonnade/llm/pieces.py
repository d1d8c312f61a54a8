"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant texts.

The vocabulary is a SentencePiece BPE model whose normaliser changes nothing but spaces.
A sequence of pieces is the encoding of its text exactly if every two neighbours are the
encoding of their joint text.  So admissible sequences are paths: a boundary state is the
piece that reaches over (or up to) a cut, a step scores 0 where two pieces may be
neighbours and minus infinity elsewhere.  A text of over ``chunk`` characters is cut into
chunks.  Each gives the transfer matrix from the states at its first cut to those at its
last; matrices combine associatively by max-plus products, prefix and suffix products fix
the one state at each cut that lies on a whole path, and then each chunk is encoded on its
own between its two states.  The ids are those of the library, whatever the cuts.

A chunk with a gap between words needs paths only up to its first and from its last gap,
since no piece reaches over a gap; a chunk of one endless word is walked in full.

* Null and empty texts have no ids.  Repeated rows are encoded each for itself.
* Characters outside the vocabulary become byte pieces and come back exactly.  Only the
  character U+2581, which stands for a space inside pieces, comes back as a space.
* An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.common import cut_text, text_of

SPACE = "▁"
#: Characters encoded in one call, so that the ids of a batch stay small.
CALL = 1 << 20
#: Characters of a chunk; a longer text goes through the scan.
CHUNK = 1 << 14


def merged(text: str, rank: dict[str, float]) -> list[str]:
    """Best pair first, of equal ones the first: the definition, for short texts."""
    parts = list(text)
    while True:
        best = max(((rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return parts
        i = -best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def neighbours(rank: dict[str, float]):
    """Tells whether two pieces may be neighbours; with nothing on the left, whether one may stand at all.

    It holds no reference to a vocabulary, so a task's vocabulary goes when the task ends.
    """
    @functools.lru_cache(200_000)
    def fits(left: str, right: str) -> bool:
        return merged(left + right, rank) == [p for p in (left, right) if p]

    return fits


class Vocabulary:
    """Pieces of a model and which of them may be neighbours."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models that leave texts as they are")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        spec.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=model.SerializeToString())
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == 1]
        self.rank = {p.piece: p.score for _, p in normal}
        self.reach = max((len(p) for p in self.rank), default=1)
        self.gaps = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.bytes = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in model.pieces]
        self.fits = neighbours(self.rank)

    def prepare(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, prepared: str) -> list[int]:
        return self.library.encode(prepared)

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def is_gap(self, text: str, at: int) -> bool:
        return self.gaps and 0 < at < len(text) and text[at] == SPACE and text[at - 1] != SPACE

    def states(self, text: str, at: int, last: bool) -> list[tuple[int, int]]:
        """(start, end) of the pieces that begin before ``at`` and end at or after it; at the end of a text, at it."""
        found = [(s, e) for s in range(max(0, at - self.reach), at) for e in ([at] if last else range(at, min(len(text), s + self.reach) + 1))]
        return [(s, e) for s, e in found if (text[s:e] in self.rank or e - s == 1) and self.fits("", text[s:e])]

    def walk(self, text: str, starts: list[tuple[int, str]], stop: int) -> dict[int, dict[str, int]]:
        """From each start (end of a piece, the piece), in bits of one number per start: which pieces its path has at which ends."""
        at: dict[int, dict[str, int]] = {}
        for bit, (e, piece) in enumerate(starts):
            row = at.setdefault(e, {})
            row[piece] = row.get(piece, 0) | 1 << bit
        pos = min(at, default=stop)
        while pos < stop:
            for left, who in at.get(pos, {}).items():
                for n in range(1, min(self.reach, stop - pos) + 1):
                    right = text[pos:pos + n]
                    if (n == 1 or right in self.rank) and self.fits(left, right):
                        row = at.setdefault(pos + n, {})
                        row[right] = row.get(right, 0) | who
            at.pop(pos - self.reach, None)
            pos += 1
        return at

    def transfer(self, text: str, first: int, last: int, opens: bool, closes: bool) -> tuple[list, list, np.ndarray]:
        """States at ``first`` and ``last`` and the matrix between them; ``text`` has some characters more on both sides."""
        rows = [(first, first)] if opens else self.states(text, first, False)
        cols = self.states(text, last, closes)
        starts = [(e, text[s:e]) for s, e in rows]
        matrix = np.full((len(rows), len(cols)), -np.inf)
        gap1 = next((i for i in range(first + self.reach, last - self.reach) if self.is_gap(text, i)), None)
        if gap1 is not None:
            gap2 = next(i for i in range(last - self.reach, gap1 - 1, -1) if self.is_gap(text, i))
            came = functools.reduce(int.__or__, self.walk(text, starts, gap1).get(gap1, {}).values(), 0)
            leads = self.walk(text, [(gap2, "")], last)
            for j, (s, e) in enumerate(cols):
                if any(self.fits(left, text[s:e]) for left in leads.get(s, ())):
                    matrix[[i for i in range(len(rows)) if came >> i & 1], j] = 0.0
            return rows, cols, matrix
        ends = self.walk(text, starts, last)  # keeps what a last piece can start from
        for j, (s, e) in enumerate(cols):
            who = functools.reduce(int.__or__, (w for left, w in ends.get(s, {}).items() if self.fits(left, text[s:e])), 0)
            who |= functools.reduce(int.__or__, (1 << i for i, r in enumerate(rows) if r == (s, e)), 0)  # one piece over a whole short chunk
            matrix[[i for i in range(len(rows)) if who >> i & 1], j] = 0.0
        return rows, cols, matrix


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def resolve(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut (of each matrix's columns) on the best whole path."""
    prefix = list(accumulate(matrices, combine))
    suffix = list(accumulate(reversed(matrices), lambda acc, m: combine(m, acc)))[::-1][1:]
    through = [p[0] + s.max(axis=1) for p, s in zip(prefix, suffix)] + [prefix[-1][0]]
    if any(np.isneginf(t.max()) for t in through):
        raise ValueError("no admissible sequence of pieces")
    return [int(t.argmax()) for t in through]


def read_model(path: str) -> bytes:
    """The model file, some hundred kilobytes; it travels with the tasks, so only the driver needs the path."""
    with open(path, "rb") as f:
        return f.read()


def with_id(id_type: T.DataType, others: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(others)])


def encode(docs: DataFrame, ident: str, text: str, model: bytes, chunk: int = CHUNK, proof: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` for every row; with ``proof`` also ``decoded_sha256``, the digest of what the ids decode to."""
    rows = docs.select(F.col(ident).alias("doc_id"), text_of(text).alias("t"))
    id_type = rows.schema["doc_id"].dataType
    small = rows.where(F.length("t") <= chunk)
    giant = rows.where(F.length("t") > chunk).withColumn("row_no", F.monotonically_increasing_id())

    def plain(batches):
        voc = Vocabulary(model)
        for b in batches:
            lo, n, ids, digests = 0, 0, [], []
            for i in range(b.num_rows):
                prepared = voc.prepare(b.column("t")[i].as_py())
                made = voc.encode(prepared)
                n += len(prepared)
                digests.append(hashlib.sha256(voc.decode(made).encode()).hexdigest() if proof else None)
                ids.append(np.array(made, dtype=np.int32))
                if n >= CALL or i == b.num_rows - 1:
                    columns = [b.column("doc_id").slice(lo, i + 1 - lo), pa.array(ids, pa.list_(pa.int32())), pa.array(digests, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded_sha256"])
                    lo, n, ids, digests = i + 1, 0, [], []

    done = small.mapInArrow(plain, with_id(id_type, "ids array<int>, decoded_sha256 string"))
    cuts = cut_text(giant.mapInArrow(lambda batches: cut_up(batches, model, chunk), with_id(
        id_type, "row_no long, chunk int, part string, first int, last int, closes boolean")))

    def matrices(batches):
        voc = Vocabulary(model)
        for b in batches:
            made = [voc.transfer(r["part"], r["first"], r["last"], r["chunk"] == 0, r["closes"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_no"), b.column("chunk"), pa.array([[e - r0 for _, e in rows] for (rows, _, _), r0 in zip(made, b.column("first").to_pylist())], pa.list_(pa.int32())),
                 pa.array([[e - r0 for _, e in cols] for (_, cols, _), r0 in zip(made, b.column("last").to_pylist())], pa.list_(pa.int32())),
                 pa.array([m.ravel().tolist() for _, _, m in made], pa.list_(pa.float64()))], names=["row_no", "chunk", "rows", "cols", "m"])

    transfers = cuts.select("row_no", "chunk", "part", "first", "last", "closes").mapInArrow(
        matrices, "row_no long, chunk int, rows array<int>, cols array<int>, m array<double>")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        at = resolve([np.asarray(m, float).reshape(len(r), len(c)) for r, c, m in zip(pdf["rows"], pdf["cols"], pdf["m"])])
        over = [int(c[k]) for c, k in zip(pdf["cols"], at)]
        return pd.DataFrame({"row_no": pdf["row_no"], "chunk": pdf["chunk"], "skip": [0, *over[:-1]], "over": over})

    # one small matrix per chunk of one text, which a string's limit of 2 GB bounds
    fixed = transfers.groupBy("row_no").applyInPandas(states, "row_no long, chunk int, skip int, over int")

    def between(batches):
        voc = Vocabulary(model)
        for b in batches:
            ids = [voc.encode(r["part"][r["first"] + r["skip"]:r["last"] + r["over"]]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_no"), b.column("chunk"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "row_no", "chunk", "ids"])

    encoded = cuts.join(fixed, ["row_no", "chunk"]).select("doc_id", "row_no", "chunk", "part", "first", "last", "skip", "over").mapInArrow(
        between, with_id(id_type, "row_no long, chunk int, ids array<int>"))
    whole = encoded.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("c"))
    joined = whole.select("doc_id", F.flatten("c.ids").alias("ids"))
    if not proof:
        return done.drop("decoded_sha256").unionByName(joined)
    return done.unionByName(joined.withColumn("decoded_sha256", F.sha2(decode("ids", model), 256)))


def cut_up(batches, model: bytes, chunk: int):
    """Chunks of prepared texts, each with as many characters more on both sides as a piece can have."""
    voc = Vocabulary(model)
    names = ["doc_id", "row_no", "chunk", "part", "first", "last", "closes"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
    for b in batches:
        for i in range(b.num_rows):
            text, row_no = voc.prepare(b.column("t")[i].as_py()), b.column("row_no")[i].as_py()
            n = max(1, len(text) // chunk)  # the rest goes to the last chunk, so none is very short
            for k in range(n):
                first, last = k * chunk, len(text) if k == n - 1 else (k + 1) * chunk
                a = max(0, first - voc.reach)
                values = [row_no, k, text[a:last + voc.reach], first - a, last - a, k == n - 1]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), *[pa.array([v], t) for v, t in zip(values, kinds)]], names=names)


def decode(ids: str, model: bytes) -> Column:
    """The text of a column of ids."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voc = Vocabulary(model)
        for rows in batches:
            yield pd.Series(["" if r is None else voc.decode(r.tolist()) for r in rows], dtype=object)

    return texts(F.col(ids))
