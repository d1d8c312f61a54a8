"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are split into pieces and these into words; a phrase is a run of words within a
piece.  A task lays the words of many texts out in one block of bytes, a space between
words and a line feed between pieces, and prefix polynomials over the block give the
fingerprint of any phrase from two places of a running sum, all phrases of a length at
once.

Only phrases found ``least`` times are wanted, and a phrase is found no more often than
the shorter ones in it.  So fingerprints are counted length by length: a block offers,
with its count, every fingerprint whose first and last part passed the length before.
What passed is known to the tasks by a bit field of fixed size; where its bits run
together, more is shuffled, and the result stays the same.

Fingerprints only say which phrases are worth spelling out.  A last pass finds their
occurrences, and a block keeps for every fingerprint a pointer to its first one; all
others are held against the bytes there, and those that differ are told apart.  Each
phrase of a block is cut out of the text once; counts and least pointers (ids of texts)
are summed by phrase, many phrases to a row, so they do not depend on any fingerprint.

* A null text is empty, a null language is ``und``.  Repeated rows count again.
* Languages are kept apart throughout; their names are part of the fingerprint.
* Texts of any length are taken in stretches cut at white space; a phrase over a cut is
  counted by the stretch that it ends in.
* An empty table gives no phrases.  Other columns are not read.
* Scores are whole numbers, computed in 38 digits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from colonnade.llm.common import bit_field, in_field
from colonnade.session import cut_lineage

GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Lowers A-Z, makes a tab a space and every sign that ends a piece a line feed.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Factor of the polynomials; odd, so that it has an inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
LONGEST = 5
#: Bytes whose sums are held at once.
STEP = 1 << 16
#: Phrases that a task sums up before it hands them on, and about how many different ones share a row of the shuffle.
HELD, IN_SLICE = 1 << 18, 512


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers_at(base: int, at: np.ndarray) -> np.ndarray:
    """Powers of ``base`` by two short tables instead of one as long as the block."""
    if not len(at):
        return np.zeros(0, np.uint64)
    return powers(base, STEP)[at % STEP] * powers(pow(base, STEP, 1 << 64), int(at.max()) // STEP + 1)[at // STEP]


def sums_at(raw: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Prefix polynomials of the bytes, at sorted places only: sum of (byte + 1) FACTOR^j over all j before the place."""
    small, carry, out = powers(FACTOR, STEP), np.uint64(0), [np.zeros(len(p), np.uint64) for p in places]
    for q in range(len(raw) // STEP + 1):
        part = raw[q * STEP:(q + 1) * STEP].astype(np.uint64) + np.uint64(1)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * small[:len(part)], dtype=np.uint64))) * np.uint64(pow(FACTOR, q * STEP, 1 << 64)) + carry
        for p, o in zip(places, out):
            lo, hi = np.searchsorted(p, (q * STEP, (q + 1) * STEP))
            o[lo:hi] = run[p[lo:hi] - q * STEP]
        carry = run[-1]
    return out


def scrambled(x: np.ndarray) -> np.ndarray:
    """One to one, so it adds no collisions; spreads the fingerprints over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Block:
    """Texts laid out in one run of bytes, with the places of their words.

    ``texts`` are pairs of a text and how many of its first words are only context, which
    phrases may begin in but not end.  ``langs`` numbers the language of each text and
    ``salts`` has a number to mix into its fingerprints.
    """

    def __init__(self, texts: list[tuple[bytes, int]], langs: np.ndarray, salts: np.ndarray, bits: int = 64):
        raw = np.frombuffer(b"\n".join(t.translate(PLAIN) for t, _ in texts), np.uint8)
        word = (raw != 32) & (raw != 10)
        change = np.flatnonzero(word[1:] != word[:-1]) + 1
        edges = np.concatenate(([0] if len(word) and word[0] else [], change, [len(word)] if len(word) and word[-1] else [])).astype(np.int64)
        start, end = edges[::2], edges[1::2]
        piece = np.searchsorted(np.flatnonzero(raw == 10), start)
        # a single byte between words: the one before each word, a line feed where a piece begins
        keep = word.copy()
        between = start[1:] - 1
        keep[between] = True
        self.bytes = np.where(word, raw, np.uint8(32))[keep]
        length = end - start
        self.start = np.concatenate(([0], np.cumsum(length + 1)))[:-1].astype(np.int64)
        self.end, self.piece = self.start + length, piece
        sizes = np.array([len(t) + 1 for t, _ in texts], np.int64)
        first_byte = np.concatenate(([0], np.cumsum(sizes)))
        self.text = np.searchsorted(first_byte, start, side="right") - 1
        self.lang = langs[self.text]
        first_word = np.searchsorted(start, first_byte[:-1])
        context = np.array([c for _, c in texts], np.int64)
        self.counted = np.arange(len(start)) - first_word[self.text] >= context[self.text]
        self.salt, self.bits = salts[self.lang], bits
        self.before, self.after = sums_at(self.bytes, self.start, self.end)
        self.back = powers_at(INVERSE, self.start)

    def __len__(self) -> int:
        return len(self.start)

    def prints(self, n: int) -> np.ndarray:
        """Fingerprints of the runs of ``n`` words from each word on, whether or not they lie in a piece."""
        m = max(0, len(self) - n + 1)
        poly = (self.after[n - 1:] - self.before[:m]) * self.back[:m]
        out = scrambled(poly + self.salt[:m] + np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64)))
        return out & np.uint64((1 << self.bits) - 1) if self.bits < 64 else out

    def places(self, n: int, passed: np.ndarray | None) -> np.ndarray:
        """First words of the phrases of ``n`` words that end outside the context and whose parts have passed."""
        m = max(0, len(self) - n + 1)
        ok = (self.piece[:m] == self.piece[n - 1:]) & self.counted[n - 1:]
        if passed is not None:
            shorter = in_field(passed, self.prints(n - 1))
            ok &= shorter[:m] & shorter[1:m + 1]
        return np.flatnonzero(ok)

    def same(self, at: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """Whether the phrases of ``n`` words from ``at`` are, byte for byte, those from ``first``, in the same language."""
        size = self.end[at + n - 1] - self.start[at]
        equal = (size == self.end[first + n - 1] - self.start[first]) & (self.lang[at] == self.lang[first])
        look = np.flatnonzero(equal & (at != first))
        for some in np.array_split(look, max(1, int(size[look].sum()) >> 20)):
            k, total = size[some], int(size[some].sum())
            step = np.arange(total) - np.repeat(np.cumsum(k) - k, k)
            differ = self.bytes[np.repeat(self.start[at[some]], k) + step] != self.bytes[np.repeat(self.start[first[some]], k) + step]
            equal[some[np.unique(np.repeat(np.arange(len(some)), k)[differ])]] = False
        return equal

    def phrase(self, at: int, n: int) -> str:
        return self.bytes[self.start[at]:self.end[at + n - 1]].tobytes().decode()


def counted_prints(block: Block, n: int, passed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(block.prints(n)[block.places(n, passed)], return_counts=True)


def spelled(block: Block, n: int, passed: np.ndarray) -> list[tuple[int, str, int, int]]:
    """Language number, phrase, count and text of the first occurrence, of every phrase of ``n`` words that has passed."""
    at = block.places(n, None)
    prints = block.prints(n)[at]
    some = in_field(passed, prints)
    at, prints = at[some], prints[some]
    out = []
    while len(at):
        _, first, group = np.unique(prints, return_index=True, return_inverse=True)
        pointer = at[first]
        same = block.same(at, pointer[group], n)
        count = np.bincount(group[same], minlength=len(first))
        out += [(int(block.lang[p]), block.phrase(p, n), int(c), int(block.text[p])) for p, c in zip(pointer, count)]
        at, prints = at[~same], prints[~same]  # collisions: other phrases, told apart in the next turn
    return out


def stretches(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """The text in order, cut at white space after about ``size`` bytes, each with the words before it that phrases may begin in."""
    at, tail = 0, b""
    while at < len(text):
        cut = GAP.search(text, at + size)
        end = cut.end() if cut else len(text)
        part = text[at:end]
        yield tail + part, len(re.findall(rb"[^ \n]+", tail.translate(PLAIN)))
        if end < len(text):
            whole, back = tail + part, len(tail) + len(part)
            words = 0
            while back > 0 and words < LONGEST - 1:  # back over the last words, with what stands between them
                back = len(whole[:back].rstrip(b" \t\n\x0b\x0c\r"))
                back = max(whole.rfind(g, 0, back) for g in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
                words = len(re.findall(rb"[^ \n]+", whole[back:].translate(PLAIN)))
            tail = whole[back:]
        at = end


def salts_of(langs: list[str]) -> np.ndarray:
    """A number per language, from its name alone: the same in every task."""
    out = [sum((b + 1) * pow(INVERSE, k + 1, 1 << 64) for k, b in enumerate(name.encode())) for name in langs]
    return scrambled(np.array([x % (1 << 64) for x in out], np.uint64))


def blocks(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[tuple[Block, list[str], list]]:
    """Blocks of about ``size`` bytes, with the names of their languages and the ids of their texts."""
    held, bytes_held = [], 0

    def made():
        held.sort(key=lambda x: (x[2] is None, x[2]))  # stable: the first occurrence is that of the least id
        names = sorted({x[1] for x in held})
        number = {name: k for k, name in enumerate(names)}
        return (Block([x[0] for x in held], np.array([number[x[1]] for x in held], np.int64), salts_of(names), bits), names, [x[2] for x in held])

    for batch in batches:
        for lang, text, ident in zip(*(batch.column(k) for k in range(3))):
            for stretch in stretches((text.as_py() or "").encode(), size):
                held.append((stretch, lang.as_py(), ident.as_py()))
                bytes_held += len(stretch[0]) + 1
                if bytes_held >= size:
                    yield made()
                    held, bytes_held = [], 0
    if held:
        yield made()


def frequent_phrases(docs: DataFrame, ident: str, text: str, lang: str, least: int = 100, size: int = 1 << 22,
                     log_bits: int = 25, bits: int = 64) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``found`` and ``seen_in`` (least id of a text with it) of all phrases of up to five
    words found ``least`` times or more; a row of 0 words per language has the number of all its words.

    ``size`` is a block's bytes, ``log_bits`` the bit field's size; ``bits`` shortens the fingerprints, for tests.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"), F.col(ident).alias("ident"))
    fields: list[np.ndarray] = []
    for n in range(1, LONGEST + 1):
        passed = fields[-1] if fields else None

        def count(batches, n=n, passed=passed):
            for block, _, _ in blocks(batches, size, bits):
                keys, counts = counted_prints(block, n, passed)
                for k in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + (1 << 16)].view(np.int64)), pa.array(counts[k:k + (1 << 16)].astype(np.int64))], names=["key", "n"])

        counts = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        fields.append(bit_field(counts, "key", log_bits))
    slices = max(64, sum(int(np.bitwise_count(f).sum()) for f in fields) // IN_SLICE)
    kind, arrow_kind = rows.schema["ident"].dataType, to_arrow_type(rows.schema["ident"].dataType)
    packed = T.StructType([T.StructField("slice", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("phrases", T.StringType()),
                           T.StructField("n", T.ArrayType(T.LongType())), T.StructField("ident", T.ArrayType(kind))])
    result = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("phrase", T.StringType()),
                           T.StructField("found", T.LongType()), T.StructField("seen_in", kind)])

    def spell(batches):
        seen: dict[tuple[str, str], tuple] = {}
        for block, names, idents in blocks(batches, size, bits):
            for k, c in enumerate(np.bincount(block.lang[block.counted], minlength=len(names))):
                add(seen, (names[k], ""), int(c), None)
            for n in range(1, LONGEST + 1):
                for lang, phrase, c, t in spelled(block, n, fields[n - 1]):
                    add(seen, (names[lang], phrase), c, idents[t])
                if len(seen) >= HELD:
                    yield from in_slices(seen, slices, arrow_kind)
                    seen = {}
        yield from in_slices(seen, slices, arrow_kind)

    def merge(batches):
        """Sums up slice by slice; rows come sorted by slice, a few of them are opened at a time."""
        now, seen = None, {}

        def out():
            full = [(lang, phrase.count(" ") + 1 if phrase else 0, phrase, n, ident) for (lang, phrase), (n, ident) in seen.items() if n >= least or not phrase]
            types = [pa.string(), pa.int32(), pa.string(), pa.int64(), arrow_kind]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in full], t) for k, t in enumerate(types)], names=result.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 8):
                for row in batch.slice(lo, 8).to_pylist():
                    if row["slice"] != now:
                        if seen:
                            yield out()
                        now, seen = row["slice"], {}
                    for phrase, n, ident in zip(row["phrases"].split("\n"), row["n"], row["ident"]):
                        add(seen, (row["lang"], phrase), n, ident)
        if seen:
            yield out()

    return cut_lineage(rows.mapInArrow(spell, packed).repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, result))


def add(seen: dict[tuple[str, str], tuple], key: tuple[str, str], n: int, ident) -> None:
    """Sums ``n`` and keeps the least id; null is no id."""
    held, least = seen.get(key, (0, None))
    seen[key] = (held + n, ident if least is None else least if ident is None else min(ident, least))


def in_slices(seen: dict[tuple[str, str], tuple], slices: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """What a task has summed up, the phrases of a slice and language in one row: fewer and longer rows to shuffle.

    A phrase holds no line feed, so phrases stand in one string, a line each.
    """
    dealt: dict[tuple[int, str], list] = {}
    for lang, phrase in seen:
        dealt.setdefault((zlib.crc32(phrase.encode()) % slices, lang), []).append(phrase)
    keys = list(dealt)
    for k in range(0, len(keys), 64):
        some = keys[k:k + 64]
        held = [[seen[lang, phrase] for phrase in dealt[x, lang]] for x, lang in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in some], pa.int64()), pa.array([lang for _, lang in some], pa.string()), pa.array(["\n".join(dealt[key]) for key in some], pa.string()),
             pa.array([[n for n, _ in h] for h in held], pa.list_(pa.int64())), pa.array([[i for _, i in h] for h in held], pa.list_(kind))],
            names=["slice", "lang", "phrases", "n", "ident"])


def cuts(phrase: str) -> Column:
    """For every k below the number of words: ``k``, the first k words and the rest."""
    words = F.split(phrase, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("head"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("tail")))


def runs_within(phrase: str) -> Column:
    """All shorter runs of two or more words in a phrase."""
    words = F.split(phrase, " ")
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))))


def collocations(found: DataFrame, best: int = 2000) -> DataFrame:
    """Per language the first ``best`` phrases of two or more words by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``seen_in``.

    The score of a cut is floor(1000 a n / (l r)); a phrase has that of its lowest cut.  A
    phrase inside a longer one that is found as often is left out.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    parts = found.where("words between 1 and 4").select("lang", "phrase", "found")
    candidates = found.where("words >= 2").select("lang", "words", "phrase", F.col("found").alias("a"), "seen_in")
    totals = found.where("words = 0").select("lang", F.col("found").alias("n"))
    cut = candidates.select("lang", "phrase", "a", F.explode(cuts("phrase")).alias("c")).select("lang", "phrase", "a", "c.*")
    scored = (cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("found").alias("l")), ["lang", "head"])
              .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("found").alias("r")), ["lang", "tail"]).join(totals, "lang")
              .withColumns({"up": (big("a") * big("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), "down": big("l") * big("r")})
              .withColumn("score", F.expr("up div down")))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s"))
    inside = (candidates.where("words >= 3").select("lang", "a", F.explode(runs_within("phrase")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "seen_in").join(lowest, ["lang", "phrase"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "s.l", "s.r", "s.n", "s.score", "seen_in")
