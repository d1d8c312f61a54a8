"""The whole pipeline on odd input: nulls, copies, clashing columns, empty tables."""

import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import simhash
from colonnade.llm.queries import MODEL

CLASH = ["row", "t", "key", "cls", "taken", "size", "n", "k_id", "digest", "g_index", "copies"]


def write(spark, folder, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({c: F.lit("clash") for c in CLASH}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows(n):
    return [(i, f"document {i} says " + " ".join(f"w{(i * 7 + k) % 97}" for k in range(30)), "en", "ab"[i % 2], 0) for i in range(n)]


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_of_odd_rows(spark, tmp_path, labelled):
    """Every stage by hand: who is rejected is known, one of each group of copies stays, the mixture repeats whole rows."""
    base = rows(40)
    vile = [(100 + i, "vile vile hateful words vile " + " ".join(f"v{(i * 5 + k) % 31}" for k in range(20)), "en", "a", 0) for i in range(40)]
    odd = [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n ", "en", "a", 0), (5, base[5][1], "en", "b", 0), (203, base[5][1] + "  ", "en", "a", 0),
           (None, "a text without an id that nobody else has written down here", "en", "b", 0), (204, base[7][1] + " more", "en", "a", 0)]
    labels = [(d[0], 1, int(d[0] >= 100)) for d in base + vile] if labelled else []
    sf = write(spark, tmp_path / "in", base + vile + odd, labels)
    got = corpus_pipeline.run(spark, sf).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {d[0]: d[1] or "" for d in base + vile}
    for r in got:
        if r.doc_id in texts and r.doc_id not in (5, 7):
            assert list(r.ids) == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
    kept = {r.doc_id for r in got}
    assert kept - {d[0] for d in base + vile + odd} == set()
    if labelled:
        assert not {d[0] for d in vile if zlib.crc32(str(d[0]).encode()) % 4 != 2} & kept
    assert len({5, 203} & kept) <= 1 and len({7, 204} & kept) <= 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = write(spark, tmp_path / "in", [], [])
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() == 0


def test_near_duplicates_are_those_of_simhash_too(spark):
    """texts that repeat a passage have one fingerprint, whatever the few words after it, and far fewer than 0.8 of their shingles in common."""
    docs = [(k, "one two three four five six seven " * 100 + " ".join(f"w{k}x{i}" for i in range(20))) for k in range(3)]
    docs += [(7, "another text that is near none of them"), (8, None), (9, "")]
    df = spark.createDataFrame([(*d, "en", "a", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    linked = {r.component_id for r in simhash.components(df, "doc_id", "text").collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == linked == {0, 7, 8}
