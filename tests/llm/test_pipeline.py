"""The pipeline's stages, each against plain Python on its own input."""

import re
from collections import Counter

import corpus_pipeline as P
import pytest
from test_ngram_join import brute

from terravane.llm import quality_rules
from terravane.llm._shared import staged


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_stages(spark, where, edge_dir):
    where = "/root/testdata/sf0.001" if where == "sf" else edge_dir
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        made = stage(spark, docs, where)
        out = spark.createDataFrame(made.collect(), made.schema)
        before, after = [(r.doc_id, r.text) for r in docs.collect()], out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "quality rules":
            words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in before}
            assert all(len(words[r.doc_id]) >= 50 for r in after)
            assert {r.doc_id for r in after} <= set(words)
        elif name == "line dedup":
            assert Counter(r.doc_id for r in after) == Counter(i for i, _ in before)
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
        elif name == "n-gram Jaccard join":
            want = Counter(i for i, _, c in brute(list(dict.fromkeys(before))) if i == c)
            assert Counter(r.doc_id for r in after) == want
        else:
            assert {r.doc_id for r in after} == {i for i, _ in before}
        docs = out


def test_rules_take_effect(spark):
    where = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).select("doc_id").collect()}
    rated = quality_rules.judged(staged(quality_rules.with_counts(docs).drop("text"), "counts"), labels)
    assert kept == {r.doc_id for r in rated.where("kept").collect()}


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
