"""The queries against plain Python over whole tables, on test data and on edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from terravane.llm import queries as Q
from terravane.llm.bpe import tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["sf", "edge"])
def where(request):
    return SF if request.param == "sf" else request.getfixturevalue("edge_dir")


def documents(spark, where):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op1(spark, where):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{where}/pages.parquet").collect()]
    first = defaultdict(list)
    for i, p in pages:
        first[p].append(i)
    want = []
    for i, p in pages:
        known = [x for x in first[p] if x is not None]
        response = not known or i == min(known)
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else min(known)))
    assert rows(Q.op1_warc(spark, where)) == sorted(want, key=repr)


def test_op2_counts(spark, where):
    want = []
    for i, t in documents(spark, where):
        words = WORDS.findall(t or "")
        wins = list(zip(words, words[1:], words[2:]))
        n = Counter(wins)
        covered = {k + d for k, w in enumerate(wins) if n[w] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), base))
    got = Q.op2_quality_rules(spark, where)
    assert rows(got.drop("kept")) == sorted(want, key=repr)
    assert not got.where("base_failed AND kept").count()


def test_op5(spark, where):
    got = Q.op5_sharding(spark, where).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents(spark, where)]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if where == SF:
        load = Counter()
        for r in got:
            load[r.shard] += r["size"]
        assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())


def token_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_op8(spark, where):
    docs = documents(spark, where)
    ids = token_ids([t for _, t in docs], 1)
    got = Q.op8_packing(spark, where).collect()
    whole = Counter((i, len(x)) for (i, _), x in zip(docs, ids))
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == whole
    if where == SF:
        of = {i: x for (i, _), x in zip(docs, ids)}
        pieces = defaultdict(list)
        for r in got:
            pieces[r.doc_id].append((r.start, r.length))
            assert r.ids_crc32 == zlib.crc32(of[r.doc_id][r.start : r.start + r.length].tobytes())
        for i, p in pieces.items():
            assert [s for s, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]]
            assert sum(n for _, n in p) == len(of[i])
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    padding = total = 0
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    if where == SF:
        assert padding < 0.05 * total


def test_op9(spark, where):
    docs = documents(spark, where)
    strip = " \t\n\x0b\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    order = lambda i: float("inf") if i is None else i
    key = lambda line: line.strip(strip).translate(lower)
    first = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(k := key(line)) >= 10:
                first[k] = min(first.get(k, float("inf")), order(i))
    want = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(i)]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert rows(Q.op9_line_dedup(spark, where)) == sorted(want, key=repr)


def test_op10(spark, where):
    docs = sorted(documents(spark, where), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    at, want = 0, []
    for (i, _), x in zip(docs, token_ids([t for _, t in docs], 2)):
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert rows(Q.op10_token_files(spark, where)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert rows(got) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_empty_tables(spark, empty_dir):
    for name, query in Q.QUERIES.items():
        assert query(spark, empty_dir).count() == 0, name
