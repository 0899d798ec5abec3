import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from terravane.llm import viterbi as V
from terravane.llm.bpe import tokenizer_path
from terravane.llm.queries import op7_sentencepiece
from terravane.llm.viterbi import MARK, pieces

MODEL = tokenizer_path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def unigram(longest=5):
    """Pieces whose scores are to be summed: those of the model file with scores of their own."""
    own = V.Pieces(MODEL)
    rng = random.Random(3)
    own.score = {p: (-rng.uniform(1, 12) * len(p) ** 0.5, i) for p, (_, i) in own.score.items() if len(p) <= longest}
    own.longest, own.merges, own.root, own.missing, own.single = longest, False, own._tree(), -100.0, set()
    return own


def brute(own, text):
    """The largest sum of scores over the whole text at once."""
    best, way = [0.0], [None]
    for end in range(1, len(text) + 1):
        top, choice = best[end - 1] + own.missing, (end - 1, None)
        for start in range(end - 1, max(end - own.longest, 0) - 1, -1):
            found = own.score.get(text[start:end])
            if found and best[start] + found[0] >= top:
                top, choice = best[start] + found[0], (start, found[1])
        best.append(top)
        way.append(choice)
    out, end = [], len(text)
    while end:
        start, i = way[end]
        out = ([i] if i is not None else [own.byte[b] for b in text[start:end].encode()]) + out
        end = start
    return out


@pytest.mark.parametrize("seed", range(20))
def test_sums_of_scores(seed):
    own, rng = unigram(), random.Random(seed)
    text = "".join(rng.choice("theandring▁▁\n.,éß漢😀\x00") for _ in range(rng.randint(1, 300)))
    assert own.ids(text) == brute(own, text)


def test_ids_are_committed_while_the_text_streams():
    """Whole texts go through the window: it stays short, and what is committed never changes."""
    own, rng = pieces(MODEL), random.Random(1)
    for own, text in ((own, "".join(rng.choice("abcdefghij") for _ in range(5000))), (unigram(), "".join(rng.choice("abcdefghij") for _ in range(5000))), (own, "x" * 20_000)):
        runs = list(own.committed(text))
        assert len(runs) > 50
        assert max(len(b"".join(own.raw[i] for i in r)) for r in runs) <= 20 * own.longest
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    text = " ".join(t for t in table if t)
    runs = list(pieces(MODEL).committed(MARK + text.replace(" ", MARK)))
    assert len(runs) > len(text) / 20 and [i for r in runs for i in r] == library().encode(text)


def test_the_cache_changes_nothing():
    own, sp = V.Pieces(MODEL), library()
    for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[::7]:
        ids = own.encode(r or "", cached=False)
        assert ids == own.encode(r or "") == sp.encode(r or "")


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_query(spark, where, edge_dir):
    where = "/root/testdata/sf0.001" if where == "sf" else edge_dir
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = op7_sentencepiece(spark, where).collect()
    assert sorted(((r.doc_id, r.decoded_sha256) for r in got), key=repr) == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in docs), key=repr)


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_query_gives_the_librarys_ids(spark, where, edge_dir):
    where = "/root/testdata/sf0.001" if where == "sf" else edge_dir
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [(r.doc_id, sp.encode(r.text or "")) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_ids, r.ids_crc32) for r in op7_sentencepiece(spark, where).collect()]
    assert sorted(got, key=repr) == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)


@pytest.mark.parametrize("seed", range(30))
def test_merges_against_the_library(seed):
    rng = random.Random(seed)
    own, sp = pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    signs = rng.choice(["theandring  \n.,éß漢😀\x00", "x", "ab", "theandringos", "▁ a"])
    text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 2000)))
    assert own.merges and own.encode(text) == own.encode(text, cached=False) == sp.encode(text) and own.decode(own.encode(text)) == text.replace("▁", " ")
