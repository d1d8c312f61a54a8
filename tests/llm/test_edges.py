"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from colonnade.llm import chat, exact_dedup, line_dedup, mixing, pieces, postings, quality, sharding, simhash, toxicity
from colonnade.llm.queries import MODEL, fresh_index

#: Names that the operators use inside.
CLASH = ["row", "t", "f", "cls", "size", "text_sha256", "digest", "g_index", "doc", "key", "n", "score"]
LONG = "so many words " * 150_000
ROWS = [(1, "one two three four five six"), (2, None), (3, ""), (4, "one  two three four five six"), (4, "one  two three four five six"),
        (None, "one two three four five six"), (5, " \n\t "), (6, LONG), (7, "x" * 200_000), (8, "other words that stand here alone today"), (8, "Ωμέγα <b> \\l ▁")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("source", F.when(F.col("doc_id") < 5, "a"))
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, None), (1, 0, 1), (8, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_sharding(docs, empty):
    cut = sharding.assign_shards(docs, ["doc_id"], sharding.byte_size("text"), 4)
    got = cut.select("shard", "slot", "size", F.col("row.doc_id").alias("id"), F.col("row.size").alias("own")).collect()
    assert len(got) == len(ROWS) and {r.own for r in got} == {"clash"}
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 16 for _, t in ROWS)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.assign_shards(empty, ["doc_id"], sharding.byte_size("text"), 4).count() == 0


def test_shards_are_written_whole(docs, spark, tmp_path):
    sharding.write_shards(sharding.assign_shards(docs.select("doc_id", "text"), ["doc_id"], sharding.byte_size("text"), 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


def test_exact_dedup_and_its_index(spark, docs, empty):
    index = fresh_index(spark)
    assert exact_dedup.dedup_batch(empty, "doc_id", "text", index, "none").count() == 0
    got = exact_dedup.dedup_batch(docs, "doc_id", "text", index, "first").collect()
    kept = sorted(((r.doc_id is None, r.doc_id), r.group_size) for r in got if r.kept)
    assert kept == [((False, 4), 4), ((False, 5), 3), ((False, 6), 1), ((False, 7), 1), ((False, 8), 1), ((False, 8), 1)]
    assert {r.keep_id for r in got if r.group_size == 4} == {4} and len(got) == len(ROWS)
    again = exact_dedup.dedup_batch(docs, "doc_id", "text", index, "second").collect()
    assert not any(r.kept for r in again) and index.read().count() == 6
    repeated = exact_dedup.dedup_batch(docs, "doc_id", "text", index, "first").collect()
    assert sorted(map(str, repeated)) == sorted(map(str, got))
    unique = exact_dedup.keep_unique(docs, "doc_id", "text", fresh_index(spark), "b")
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == [4, 5, 6, 7, 8, 8]


def test_mixing(docs, empty):
    got = mixing.mix(docs, "doc_id", "text", "source", (5, 2, 1), carry=docs.columns)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    by_source = {r.source_size: r.target for r in rows}
    assert sum(by_source.values()) == pytest.approx(total)
    mixed = mixing.repeat_rows(got)
    assert mixed.columns == docs.columns
    assert mixing.mix(empty, "doc_id", "text", "source", (5, 2, 1)).count() == 0
    nothing = mixing.mix(docs.withColumn("text", F.lit(None).cast("string")), "doc_id", "text", "source", (5, 2, 1)).collect()
    assert {(r.size, r.target, r.taken) for r in nothing} == {(0, 0.0, 0)}


def test_water_filling(spark):
    rows = spark.createDataFrame([(5.0, 10), (2.0, 1000), (1.0, 2), (5.0, 500)], "weight double, size bigint")
    got = {r.size: r.target for r in mixing.water_fill(rows, 1.0, 3.0).collect()}
    left = 1512 - 30 - 6
    assert got == {10: 30.0, 2: 6.0, 1000: pytest.approx(left * 2 / 7), 500: pytest.approx(left * 5 / 7)}


def test_chat(spark):
    said = [(1, 0, "system", "be <kind>"), *[(1, i, "user" if i % 2 else "assistant", f"\\n <turn> </turn> w{i} " * (i % 7)) for i in range(1, 60)],
            (2, 0, "assistant", None), (2, 0, None, "tie"), (None, 5, "user\n<x>", "lone"), (3, None, "assistant", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"),
            (4, 0, "assistant", "long " * 5000), (4, 1, "assistant", "")]
    turns = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(turns, budget=120, history=40)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    import hashlib
    for conv in {s[0] for s in said}:
        own = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in said if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = made.where("conv_id = 1").orderBy("start").collect()
    assert len(rows) > 3 and all(r.tokens <= 120 for r in rows)
    assert all("be \\lkind>" in r.text for r in rows) and any(chat.PAST + "user" in r.text for r in rows[1:])
    assert chat.windows(turns.where("false")).count() == 0


def test_past_turns_reach_as_far_as_the_history(spark):
    """Over the whole conversation, not only the window before; never beyond the budget."""
    words = lambda n: " ".join(["w"] * (n - chat.MARKS))
    short = [(1, i, "user", words(10)) for i in range(21)] + [(1, 21, "assistant", words(254)), (1, 22, "user", words(10))]
    led = [(2, 0, "system", words(400))] + [(2, i, "user", words(10)) for i in range(1, 80)]
    mixed = [(3, i, "user", words(random.Random(i).choice([5, 9, 30, 60, 200]))) for i in range(120)]
    turns = spark.createDataFrame(short + led + mixed, "conv_id bigint, turn bigint, role string, text string")
    rows = chat.windows(turns).collect()
    past = {(r.conv_id, r.start): r.text.count(chat.PAST) for r in rows}
    assert past[1, 210] == 12  # 120 of 128 tokens
    assert all(r.tokens <= 512 for r in rows)
    for conv, said, lead in ((1, short, 0), (2, led, 400), (3, mixed, 0)):
        ends, at = [], 0
        for _, _, _, text in said:
            ends.append((at, len(text.split()) + chat.MARKS))
            at += ends[-1][1]
        for r in (r for r in rows if r.conv_id == conv and r.start):
            new = r.text.count(chat.NEW)
            first = next(k for k, (b, _) in enumerate(ends) if b == r.start)
            room = min(128, 512 - lead - sum(n for _, n in ends[first:first + new]))
            wanted = [k for k in range(1 if lead else 0, first) if ends[k][0] >= r.start - room]
            assert past[conv, r.start] == len(wanted) + bool(lead)
            assert r.tokens == lead + sum(ends[k][1] for k in wanted) + sum(n for _, n in ends[first:first + new])


def brute_lines(texts, min_words):
    lines = [[(n, x) for n, x in enumerate((t or "").split("\n")) if x.split()] for t in texts]
    gone = [set() for _ in texts]
    earlier = []
    for d, own in enumerate(lines):
        for p in range(len(own)):
            longest = 0
            for e, q in earlier:
                n = 0
                while p + n < len(own) and q + n < len(lines[e]) and own[p + n][1] == lines[e][q + n][1]:
                    n += 1
                if sum(len(x.split()) for _, x in own[p:p + n]) >= min_words:
                    longest = max(longest, n)
            gone[d] |= {n for n, _ in own[p:p + longest]}
            earlier.append((d, p))
    return [sorted(g) for g in gone]


@pytest.mark.parametrize("min_words", [1, 5, 11])
def test_line_dedup(spark, min_words):
    rng = random.Random(min_words)
    stock = ["a b c", "d e", "f", "", " ", "g h i j", "k l m n o p q r s t u v"]
    texts = ["\n".join(rng.choice(stock) for _ in range(rng.randrange(12))) for _ in range(25)] + [None, "f\nf\nf\nf\nf\nf\nf\nf\nf\nf\nf\nf\nf\nf\nf\nf"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in CLASH})
    rows = line_dedup.dedup_lines(df, "doc_id", "text", min_words).select("row.doc_id", "deleted", "clean", F.col("row.key").alias("own")).orderBy("doc_id").collect()
    want = brute_lines(texts, min_words)
    assert [r.deleted for r in rows] == want and {r.own for r in rows} == {"clash"}
    assert [r.clean for r in rows] == ["\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in g) for t, g in zip(texts, want)]


def test_line_dedup_of_odd_rows(docs, empty):
    got = line_dedup.dedup_lines(docs, "doc_id", "text", 5).select("row.doc_id", "deleted", "n_lines", "clean").collect()
    assert len(got) == len(ROWS) and sum(r.clean == "" for r in got) == 2 + 2  # null, empty, the second 4, the null id
    assert line_dedup.dedup_lines(empty, "doc_id", "text").count() == 0


def test_simhash(docs, empty, spark):
    got = simhash.components(docs, "doc_id", "text").collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[5].fingerprint == "0" * 16 and by_id[5].component_id == 2
    assert by_id[None].component_id == by_id[4].component_id == 1
    assert simhash.components(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("crowded", [0, 3, 4096])
def test_simhash_links_of_crowded_values(spark, crowded):
    rng = np.random.default_rng(crowded)
    base = rng.integers(0, 2 ** 63, 6)
    f = sorted({int(base[rng.integers(6)]) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for _ in range(150)})
    classes = spark.createDataFrame([(x, [x]) for x in f], "cls bigint, f array<bigint>")
    got = {r.cls: r.root for r in simhash.link_classes(classes, crowded=crowded).collect()}
    from test_queries import linked
    want = linked(f, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {frozenset(k for k in got if got[k] == r) for r in set(got.values())} == {frozenset(k for k in want if want[k] == r) for r in set(want.values())}


def test_near_unique(docs, empty, spark):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["changed"] + words[101:]
    far = words[:100] + [f"v{i}" for i in range(100)]
    more = spark.createDataFrame([(20, " ".join(words)), (21, " ".join(near)), (22, " ".join(far))], "doc_id bigint, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    got = simhash.near_unique(both, "doc_id", "text")
    assert got.columns == both.columns
    # the texts without words are one group; the repeated row of 4 and the null id go with 1
    assert sorted((r.doc_id for r in got.collect())) == [1, 2, 6, 7, 8, 8, 20, 22]
    assert simhash.near_unique(empty, "doc_id", "text").count() == 0


def test_near_unique_finds_every_near_pair(spark):
    """Against brute force: copies edited close to 0.8, here and there or in one stretch, under crowded passages."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 6, n)]
    passage, texts = word(40), []
    for kind in range(60):
        base = word(int(rng.integers(60, 200)))
        if kind % 3 == 0:
            base[10:50] = passage
        texts.append(base)
        for _ in range(3):
            n, edited = len(base), list(base)
            if rng.random() < 0.5:
                for at in rng.choice(n, max(1, n // 50), replace=False):
                    edited[at] = word(1)[0]
            else:
                at = int(rng.integers(n))
                edited[at:at] = word(int(n * rng.uniform(0.1, 0.24)))
            texts.append(edited)
    ids = rng.permutation(len(texts)).tolist()
    sets = {i: {" ".join(t[k:k + 5]) for k in range(len(t) - 4)} for i, t in zip(ids, texts)}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    from test_queries import linked
    root = linked(sorted(ids), near)
    want = {min(i for i in ids if root[i] == r) for r in set(root.values())}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.near_unique(df, "doc_id", "text").collect()} == want


@pytest.mark.parametrize("part, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(docs, empty, labels, part, label):
    model = part.fit(docs, labels, "doc_id", "text", label, F.lit(True))
    got = docs.select("doc_id", "n", part.score("text", model).alias("s")).collect()
    assert len(got) == len(ROWS) and all(0 <= r.s <= 1 for r in got)
    assert part.fit(docs, labels.where("false"), "doc_id", "text", label, F.lit(True)) is None
    assert {r.s for r in docs.select(part.score("text", None).alias("s")).collect()} == {0.0}
    assert empty.select(part.score("text", model)).count() == 0


def test_trees_find_a_step():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 1] > 0.4) & (x[:, 2] > 0.3)).astype(float)
    assert ((quality.grow(x, y, quality.Settings(trees=20)).score(x) > 0.5) == y).mean() > 0.99


def test_pieces(docs, empty):
    model = pieces.read_model(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for chunk in (1 << 16, 1000):
        coded = pieces.encode(docs, "doc_id", "text", model, chunk)
        got = coded.withColumn("back", pieces.decode("ids", model)).collect()
        assert sorted(map(list, (r.ids for r in got))) == sorted(library.encode(t or "") for _, t in ROWS)
        assert sorted(r.back for r in got) == sorted((t or "").replace("▁", " ") for _, t in ROWS)
    assert pieces.encode(empty, "doc_id", "text", model).count() == 0


def test_max_plus_scan_on_random_texts():
    model = pieces.read_model(MODEL)
    voc, library, rng = pieces.Vocabulary(model), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(1)
    stock = ["abcdefgh etaoin shrdlu  ", "ab", "a ", "the and ing  ", " ", "éèaßx 한 \n", "0123 .,!", "thththeee"]
    for _ in range(400):
        text = "".join(rng.choice(stock[rng.randrange(len(stock))]) for _ in range(rng.randint(60, 300)))
        if rng.random() < 0.3:
            text = text.replace(" ", "") or "x"
        z, chunk = voc.prepare(text), rng.choice([17, 20, 33, 40, 64])
        n, cuts = max(1, len(z) // chunk), []
        for k in range(n):
            first, last = k * chunk, len(z) if k == n - 1 else (k + 1) * chunk
            cuts.append(voc.transfer(z, first, last, k == 0, k == n - 1))
        ids, at = [], 0
        for k, (_, cols, _m) in zip(pieces.resolve([c[2] for c in cuts]), cuts):
            ids += voc.encode(z[at:cols[k][1]])
            at = cols[k][1]
        assert ids == library.encode(text)


def test_products_are_associative():
    a, b, c = (np.random.default_rng(i).random((4, 4)) for i in range(3))
    assert np.allclose(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(i, [1.0] * 8) for i in range(100, 130)]  # one vector held by many
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0] * 7 + [None]), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [1.0]), (None, [1.0] * 8), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("list", F.lit("clash"))
    query = F.col("vec_id") % 20 == 0
    got = postings.search(df, "vec_id", "embedding", query, 5).toPandas().sort_values(["query_id", "rank"])
    assert set(got["query_id"]) == {0, 20, 40, 100, 120} and (got.groupby("query_id").size() == 5).all()
    assert not (got["query_id"] == got["vec_id"]).any() and got["vec_id"].max() < 200
    assert list(got[got["query_id"] == 100]["vec_id"]) == [101, 102, 103, 104, 105]
    few = postings.search(df.where("vec_id < 3"), "vec_id", "embedding", query, 5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert postings.search(df.where("false"), "vec_id", "embedding", query, 5).count() == 0


def test_neighbours_among_their_own_length(spark):
    """A longer row takes no part for the others, and those of another length find each other."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(40, [1.0] * 9), (50, [1.0] * 4), (51, [2.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = postings.search(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, 5).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 5, 10: 5, 20: 5, 50: 1}
    assert got[got["query_id"] == 50]["vec_id"].tolist() == [51] and got[got["query_id"] < 30]["vec_id"].max() < 30


def test_an_id_of_many_vectors_takes_one_place(spark):
    """An id in thousands of rows, nearer than all else, in whatever lists: the query still gets its twenty."""
    rng = np.random.default_rng(4)
    near = np.eye(8)[0] + rng.normal(size=(3000, 8)) * 0.02
    rows = [(0, np.eye(8)[0].tolist()), *[(1, v.tolist()) for v in near], *[(1, [1.0] * 8)] * 3000]
    rows += [(10 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)) * 0.3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    settings = postings.Settings(sample=2000, most_lists=64, list_rows=50)
    got = postings.search(df, "vec_id", "embedding", F.col("vec_id") == 0, 20, settings).toPandas().sort_values("rank")
    want = postings.exact(df.dropDuplicates(), "vec_id", "embedding", F.col("vec_id") == 0, 20)
    assert len(got) == 20 and got["vec_id"].nunique() == 20 and got["vec_id"].iloc[0] == 1
    assert len(set(got["vec_id"]) & set(want["vec_id"])) >= 12


def test_bins_are_sent_once(spark):
    """The vectors of the index stand in the plan's input once, however many queries there are; bins are split by id and vector."""
    first, bins = postings.pack(np.array([10, 70_000, 5, 0]))
    assert bins.tolist() == [1, 3, 1, 1] and len({(first[1] + k) for k in range(3)} & set(first[[0, 2, 3]])) == 0
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))], "vec_id bigint, embedding array<double>")
    got = postings.search(df, "vec_id", "embedding", F.lit(True), 10).toPandas()
    want = postings.exact(df, "vec_id", "embedding", F.col("vec_id") % 30 == 0, 10)
    assert (got.groupby("query_id").size() == 10).all() and got["query_id"].nunique() == 3000
    assert len(want.merge(got, on=["query_id", "vec_id"])) >= 0.9 * len(want)


def scalar_places(text):
    h = [zlib.crc32(w) for w in text.lower().encode().translate(toxicity.BLANKS).split()]
    spread = lambda x: (x * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity.BITS)
    runs = [a * 31 + b + 1 for a, b in zip(h, h[1:])] + [a * 31 + c + (1 << 34) for a, c in zip(h, h[2:])]
    return sorted({spread(x) for x in h + runs})


def test_toxicity_equals_a_scalar_learner(spark):
    """Per-coordinate rates and L1, one number at a time."""
    rng, s = random.Random(8), toxicity.Settings(steps=600, l1=0.5)
    said = [(i, " ".join(rng.choice(["calm", "kind", "vile", "Words", "here,", "end.", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 40))) + f" id{i}") for i in range(120)]
    labelled = [(i, int("vile" in t and rng.random() < 0.9)) for i, t in said]
    df, labels = spark.createDataFrame(said, "doc_id bigint, text string"), spark.createDataFrame(labelled, "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels, "doc_id", "text", "toxic", F.lit(True), s)
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score("text", model).alias("s")).collect()}
    y, z, n, bias = dict(labelled), {}, {}, "bias"

    def weight(p):
        rate = (s.beta + n.get(p, 0.0) ** 0.5) / s.alpha
        if p == bias:
            return -z.get(p, 0.0) / rate
        v = z.get(p, 0.0)
        return 0.0 if abs(v) <= s.l1 else -(v - (s.l1 if v > 0 else -s.l1)) / (rate + s.l2)

    order = sorted(said, key=lambda x: hashlib.md5(f"{s.seed}:{x[0]}".encode()).hexdigest())
    for _ in range(min(s.most_passes, -(-s.steps // len(order)))):
        for i, text in order:
            w = {p: weight(p) for p in [*scalar_places(text), bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for p, v in w.items():
                before = n.get(p, 0.0)
                z[p] = z.get(p, 0.0) + g - ((before + g * g) ** 0.5 - before ** 0.5) / s.alpha * v
                n[p] = before + g * g
    want = {i: 1 / (1 + math.exp(-sum(weight(p) for p in [*scalar_places(t), bias]))) for i, t in said}
    assert got == pytest.approx(want, abs=1e-9) and max(got.values()) > 0.8 > 0.2 > min(got.values())
    assert 0 < len(model.places) < len(z)  # L1 leaves most places at zero


def test_quality_equals_a_scalar_tree_walk(spark):
    rng = random.Random(9)
    said = [(i, " ".join(rng.choice(["Fine", "words", "#$%", "BUY", "now!!!", "and", "more."]) for _ in range(rng.randrange(1, 80)))) for i in range(150)]
    labelled = [(i, int(t.count("!") < 8)) for i, t in said]
    df, labels = spark.createDataFrame(said, "doc_id bigint, text string"), spark.createDataFrame(labelled, "doc_id bigint, quality int")
    model = quality.fit(df, labels, "doc_id", "text", "quality", F.lit(True))

    def walk(x, feature, threshold, leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        return leaf[node - len(feature)]

    want = {}
    for i, t in said:
        x = quality.statistics(t.encode())
        want[i] = 1 / (1 + math.exp(-(model.base + sum(walk(x, *tree) for tree in zip(model.feature, model.threshold, model.leaf)))))
    got = {r.doc_id: r.s for r in df.select("doc_id", quality.score("text", model).alias("s")).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert np.mean([(got[i] > 0.5) == y for i, y in labelled]) > 0.9


def test_model_keeps_to_whole_texts(spark):
    """A word at the very end of a long text counts."""
    df = spark.createDataFrame([(i, f"w{i} " + ("calm words here " * 30) + ("vile" if i % 2 else "kind")) for i in range(200)], "doc_id bigint, text string")
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    model = toxicity.fit(df, labels, "doc_id", "text", "toxic", F.lit(True))
    long = spark.createDataFrame([("calm words here " * 100_000 + "vile",), ("calm words here " * 100_000 + "kind",)], "text string")
    bad, good = [r.s for r in long.select(toxicity.score("text", model).alias("s")).collect()]
    assert bad > 0.3 > good
