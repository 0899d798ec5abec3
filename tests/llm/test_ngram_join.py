import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from terravane.llm import ngram_join as J
from terravane.llm.components import connected_components
from terravane.llm.queries import op6_ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    order = lambda i: (i is None, i or 0)
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    seen = set()
    for group in holders.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        parent[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for k, (i, _) in enumerate(docs):
        first[find(k)] = min(first.get(find(k), i), i, key=order)
    return sorted(((i, len(sets[k]), first[find(k)]) for k, (i, _) in enumerate(docs)), key=repr)


def near_copies(n, seed):
    """Families of texts with words changed at random, some right at the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    docs = []
    while len(docs) < n:
        base = [word() for _ in range(rng.randint(5, 60))]
        passage = ["boiler", "plate", "words", "that", "many", "share", "here", "and", "there"]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            docs.append((len(docs), " ".join(own + passage * rng.randint(0, 1))))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("bounds", [{}, {"most_sets": 4}, {"most_sets": 3, "most_hashes": 60}])
def test_brute_force(spark, bounds):
    docs = near_copies(250, 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in J.similar_components(df, **bounds).collect()), key=repr)
    assert got == brute(docs)


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_query(spark, where, edge_dir):
    where = "/root/testdata/sf0.001" if where == "sf" else edge_dir
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op6_ngram_join(spark, where).collect()), key=repr) == brute(docs)


def test_tree_against_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = rng.permutation(40)[:30]
        sets = []
        for _ in range(12):
            keep = base[rng.random(30) < 0.9]
            sets.append(np.unique(np.r_[keep, rng.integers(40, 60, 2)]).astype(np.uint64))
        root = J.join_sets([(len(s), s) for s in sets])
        parent = list(range(12))
        for a in range(12):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                    parent = [new if p == old else p for p in parent]
        assert len({(r, p) for r, p in zip(root, parent)}) == len(set(root)) == len(set(parent))


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(8, 40)]
    got = dict(connected_components(spark.createDataFrame(path + star + [(3, 3)], "u long, v long")).collect())
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 40)}


def test_repeated_id_drops_only_the_near_copy(spark):
    copy, clean = " ".join(f"w{k}" for k in range(80)), " ".join(f"clean{k}" for k in range(80))
    rows = [(1, copy), (10, copy + " more"), (10, clean), (10, clean), (10, None), (12, copy), (13, "short"), (None, copy)]
    got = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, copy), (10, clean), (10, None), (13, "short"), (None, copy)], key=repr)


def test_word_hashes(monkeypatch):
    """Equal words, equal hashes wherever they stand; no step for each word but the very long ones."""
    rng = np.random.default_rng(2)
    words = ["", "\0", "\0\0", "a", "a\0", "é", "x" * 64, "x" * 65, "x" * 5000] + ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 40, 3000).tolist()]
    calls = []
    digest = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda b: calls.append(b) or digest(b))
    got = J.word_hashes(pa.array(words))
    assert len(calls) == 2 and len(set(got.tolist())) == len(set(words))
    back = J.word_hashes(pa.array(words[::-1] + ["y"]).slice(0, len(words)))
    assert (back[::-1] == got).all() and (J.word_hashes(pa.array(words, pa.large_string())) == got).all()
    assert (J.word_hashes(pa.array(words).slice(5, 2000)) == got[5:2005]).all()
