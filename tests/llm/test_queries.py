"""Every query of the package on the smallest tables: against its SQL, or against a brute-force version."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from oracle import canon, connect
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import pieces, postings
from colonnade.llm.common import read_table
from colonnade.llm.queries import MODEL, QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    assert canon(df.columns, df.collect()) == canon([d[0] for d in cur.description], cur.fetchall())


def test_shards(spark, texts):
    rows = sorted(QUERIES["op1_sharding"](spark, SF).collect(), key=lambda r: r.doc_id)
    sizes = [len(texts[i].encode()) + 16 for i in sorted(texts)]
    before, total = 0, sum(sizes)
    slots = [0] * 40
    for r, size in zip(rows, sizes):
        shard = (2 * before + size) * 40 // (2 * total)
        assert (r.size, r.shard, r.slot) == (size, shard, slots[shard])
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.grown_shard is None
        before, slots[shard] = before + size, slots[shard] + 1
    assert len(rows) == len(texts)


def test_ids_are_those_of_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for chunk in (1 << 16, 700):
        coded = pieces.encode(read_table(spark, SF, "documents"), "doc_id", "text", pieces.read_model(MODEL), chunk)
        rows = coded.withColumn("back", pieces.decode("ids", pieces.read_model(MODEL))).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert list(r.ids) == library.encode(texts[r.doc_id]) and r.back == texts[r.doc_id]


def fingerprints(texts, size):
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k:k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        yield i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(keys, near):
    """Smallest key reachable, for every key."""
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and near(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_simhash_components(spark, texts):
    f = dict(fingerprints(texts, 4))
    roots = linked(sorted(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 4)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, SF).collect()}
    assert got == {(i, format(f[i], "016x"), roots[i]) for i in f}


@pytest.mark.parametrize("name, label, parts, held", [("op3_toxicity", "toxic", 4, 2), ("op7_quality", "quality", 5, 0)])
def test_held_out_accuracy(spark, name, label, parts, held):
    sf = "/root/testdata/sf0.01"
    p = QUERIES[name](spark, sf).toPandas()
    assert (p["held_out"] == [zlib.crc32(str(i).encode()) % parts == held for i in p["doc_id"]]).all()
    assert p["score"].between(0, 1).all() and (p["predicted"] == (p["score"] >= 0.3)).all() and len(p) == 1000
    labelled = p.merge(read_table(spark, sf, "labels").toPandas(), on="doc_id")
    labelled = labelled[labelled["held_out"]]
    assert (labelled["predicted"] == labelled[label]).mean() > 0.9
    ones, zeros = labelled[labelled[label] == 1]["score"].to_numpy(), labelled[labelled[label] == 0]["score"].to_numpy()
    assert ((ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2) > 0.95  # area under the curve
    assert (labelled[labelled[label] == 1]["predicted"] == 1).mean() > 0.5  # few labels at this size


def test_neighbours(spark):
    found = QUERIES["op10_neighbours"](spark, SF).toPandas()
    exact = postings.exact(read_table(spark, SF, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)
    both = found.merge(exact, on=["query_id", "vec_id"])
    assert len(both) >= 0.9 * len(exact) and np.allclose(both["score_x"], both["score_y"], rtol=0, atol=1e-12)
    for _, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1))
        assert list(zip(-g["score"], g["vec_id"])) == sorted(zip(-g["score"], g["vec_id"]))


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_pipeline_stages(spark, texts):
    stages, docs = dict(corpus_pipeline.STAGES), read_table(spark, SF, "documents")
    columns = docs.columns
    scores = {r.doc_id: r.score for r in QUERIES["op3_toxicity"](spark, SF).collect()}
    clean = stages["toxicity"](spark, docs, SF)
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < corpus_pipeline.REJECT}
    best = {}
    for i, t in sorted(texts.items()):
        key = b"".join(t.encode().split())
        best[key] = min(best.get(key, (1, i)), (-len(t), i))
    unique = stages["exact dedup"](spark, docs, SF)
    kept = {r.doc_id for r in unique.collect()}
    assert kept == {i for _, i in best.values()} and unique.columns == columns
    sets = {i: shingle_set(texts[i]) for i in kept}

    def near(a, b):
        common = len(sets[a] & sets[b])
        return sets[a] | sets[b] and common >= 0.8 * len(sets[a] | sets[b])

    staying = stages["near duplicates"](spark, unique, SF)
    assert {r.doc_id for r in staying.collect()} == set(linked(sorted(kept), near).values()) and staying.columns == columns
    mixed = stages["mixing"](spark, docs, SF)
    taken = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    copies = {r.doc_id: r.taken // r.size for r in QUERIES["op6_mixing"](spark, SF).collect() if r.size and r.taken}
    assert taken == copies and mixed.columns == columns
    coded = stages["sentencepiece"](spark, docs, SF)
    assert coded.count() == len(texts)


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_decoded_digests(spark, texts):
    for r in QUERIES["op2_sentencepiece"](spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.token_ids)
