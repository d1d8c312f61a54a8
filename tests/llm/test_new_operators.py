"""Decontamination, prefix trie and collocations against brute force, with odd rows and small bounds."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colonnade.llm import collocations, decontaminate, prefix_trie

CLASH = ["t", "row_no", "runs", "items", "name", "key", "d", "words", "part", "n", "lists", "slice", "phrase"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# --- decontamination ---

def words_at(text):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]


def brute_scan(docs, items, size):
    windows = defaultdict(set)
    for ident, text in items:
        w = [x[0] for x in words_at(text)]
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k:k + size])].add(ident)
    out = []
    for ident, text in docs:
        w = words_at(text)
        hit, names = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(x[0] for x in w[k:k + n]))
                if found:
                    hit[k:k + n] = [True] * n
                    names |= found
        spans, k = [], 0
        while k < len(w):
            if hit[k]:
                e = k
                while e + 1 < len(w) and hit[e + 1]:
                    e += 1
                spans.append((w[k][1], w[e][2] - w[k][1]))
                k = e
            k += 1
        out.append((ident, len(w), sum(hit), tuple(sorted(str(x) for x in names if x is not None)), tuple(spans)))
    return sorted(out, key=str)


def scanned(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s["at"], s["n"]) for s in r.spans)) for r in df.collect()), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "B", "c1", "é", "Ω日", "d"])
    text = lambda k: "".join(rnd.choice([" ", "  ", "-", "\n", ". "]) + word() for _ in range(k))
    return [(i, text(rnd.randrange(0, 60))) for i in range(n)]


@pytest.mark.parametrize("windows", [1 << 16, 7])
def test_decontamination_equals_brute_force(spark, windows):
    """One automaton, or several of a few windows each: the same hits, items and places in the original."""
    docs = corpus(1, 40) + [(40, None), (41, ""), (41, ""), (None, "a b c1 d"), (42, "x" * 50_000)]
    items = [(i, t) for i, t in corpus(2, 12)] + [(3, "a b"), (50, "É d"), (51, None), (52, " .. "), (None, "d d d")]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    b = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = decontaminate.scan(d, "doc_id", "text", b, "item_id", "text", size=4, windows=windows)
    assert scanned(got) == brute_scan(docs, items, 4)


def test_windows_over_the_cuts_of_a_long_text(spark, monkeypatch):
    """A text is read in pieces; what reaches over a cut is found once, wherever the cut falls."""
    part = decontaminate.build([("i", "u v w x y".split()), ("j", ["z"])], 4)
    rnd = random.Random(5)
    text = b" ".join(rnd.choice([b"u", b"v", b"w", b"x", b"y", b"z", b"u v w x"]) for _ in range(3000))
    whole = decontaminate.hits(text, part, 4)
    for size in (1, 7, 40, 1000):
        monkeypatch.setattr("colonnade.llm.samples.PIECE", size)
        some = decontaminate.hits(text, part, 4)
        assert (some[0] == whole[0]).all() and some[1] == whole[1]
    assert whole[0].any() and not whole[0].all()


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b")], "item_id string, text string".replace("string, text", "long, text"))
    assert scanned(decontaminate.scan(d, "doc_id", "text", b.where("false"), "item_id", "text")) == [(1, 3, 0, (), ())]
    assert decontaminate.scan(d.where("false"), "doc_id", "text", b, "item_id", "text").count() == 0
    assert scanned(decontaminate.scan(d, "doc_id", "text", b, "item_id", "text")) == [(1, 3, 1, ("1",), ((2, 1),))]


# --- prefix trie ---

def brute_trie(rows, thread, heads):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = tuple(own.get(c - c % thread, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        joined = ",".join(str(c) for c in sorted(ends[p]))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in below), saved,
                 hashlib.sha256(joined.encode()).hexdigest()))
    return out


def nodes(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed, block", [(1, 1 << 14), (2, 3)])
def test_trie_equals_brute_force(spark, seed, block):
    rnd = random.Random(seed)
    rows = [(c, rnd.choice([None, 0, 1, 2, 2, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi there", "hi", "", None, "a  b c"]))
            for c in range(60) for _ in range(rnd.randrange(1, 6)) if rnd.random() < 0.9]
    rows += [(5, k, "user", f"turn {k % 2}") for k in range(40)]  # one long conversation
    rows += [(c, 0, "user", "the same") for c in (100, 101, 119, 120, 121)] + [(None, 0, "user", "nobody's")] + rows[:3]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes(prefix_trie.trie(df, thread=8, heads=4, block=block)) == brute_trie(rows, 8, 4)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(df).count() == 0


# --- collocations ---

def brute_collocations(docs, least, best):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang, text = lang or "und", "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(" ".join(w[k:k + m]) for k in range(len(w) - m + 1))
    out = set()
    for lang in f:
        frequent = {p: a for p, a in f[lang].items() if a >= least}
        rows = []
        for p, a in frequent.items():
            w = p.split(" ")
            if len(w) < 2 or any(b >= a and len(q.split(" ")) > len(w) and f" {p} " in f" {q} " for q, b in frequent.items()):
                continue
            cuts = [(1000 * a * n[lang] // (frequent[" ".join(w[:k])] * frequent[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, p.encode(), p, frequent[" ".join(w[:k])], frequent[" ".join(w[k:])]))
        for rank, (s, a, _, p, left, right) in enumerate(sorted(rows)[:best], 1):
            out.add((lang, rank, p, -a, left, right, n[lang], -s))
    return out


def spoken(seed, n):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "cat", "Ä", "sat", "x\x1cy", "日本"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b"]
    return [(rnd.choice(["en", "de", None]), "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("size, bits, log_bits", [(1 << 22, 64, 25), (300, 64, 25), (90, 5, 25), (1 << 22, 8, 6)])
def test_collocations_equal_brute_force(spark, size, bits, log_bits):
    """Whatever the blocks, and with fingerprints so short that most of them collide."""
    docs = spoken(3, 60) + [(None, None), ("en", ""), ("en", "of the cat " * 300), ("fr", "seul")]
    df = clashing(spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string"))
    found = collocations.frequent_phrases(df, "doc_id", "text", "lang", 6, size, log_bits, bits)
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(found, 25).collect()}
    assert got == brute_collocations(docs, 6, 25) and len(got) > 20


def test_a_phrase_is_seen_in_the_least_text_that_has_it(spark):
    df = spark.createDataFrame([(9, "en", "a b. a b"), (4, "en", "x a b"), (7, "en", "a b"), (None, "en", "a b q q")], "doc_id long, lang string, text string")
    rows = {r.phrase: (r.found, r.seen_in) for r in collocations.frequent_phrases(df, "doc_id", "text", "lang", 1, size=8).collect()}
    assert rows["a b"] == (5, 4) and rows["q q"] == (1, None) and rows["x a"] == (1, 4)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(collocations.frequent_phrases(df, "doc_id", "text", "lang")).count() == 0


def test_scores_pass_64_bits(spark):
    """1000 a n is past 64 bits, and the quotient is still exact."""
    a, left, right, n = 3_000_000_000, 3_000_000_019, 4_000_000_007, 9_000_000_000_000_123
    rows = [("en", 0, "", n), ("en", 1, "p", left), ("en", 1, "q", right), ("en", 2, "p q", a)]
    found = spark.createDataFrame([(*r, 1) for r in rows], "lang string, words int, phrase string, found long, seen_in long")
    got = collocations.collocations(found).first()
    assert (got.l, got.r, got.score) == (left, right, 1000 * a * n // (left * right))
