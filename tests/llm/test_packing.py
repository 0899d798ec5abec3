import numpy as np
import pyarrow as pa

from terravane.llm import bpe
from terravane.llm import packing as P


def test_every_sentence_end_is_a_candidate():
    is_end = np.zeros(5000, bool)
    is_end[4::5] = True
    places, penalties = P.candidates(np.array([5000]), is_end)
    assert places.tolist() == list(range(5, 5001, 5)) and penalties.tolist() == [P.SENTENCE] * 999 + [0.0]


def test_least_cost_over_all_sentence_ends():
    rng = np.random.default_rng(1)
    is_end = rng.random(700) < 0.2
    ends = np.array([230, 700])
    places, penalties = P.candidates(ends, is_end)
    length, best = 300, {0: 0.0}
    for p in range(1, 701):
        if p in ends or is_end[p - 1]:
            own = 0.0 if p in ends else P.SENTENCE
            fits = [(b + (0 if p - q == 256 else length - p + q)) for q, b in best.items() if p - q <= length]
            best[p] = min(fits) + own + P.WINDOW
    cuts = P.best_cuts(places, penalties, length)
    own = dict(zip(places.tolist(), penalties.tolist()))
    cost = sum(own[b] + P.WINDOW + (0 if b - a == 256 else length - b + a) for a, b in zip([0, *cuts], cuts))
    assert cost == best[700]


def test_encoder_holds_encodings_of_few_words_at_a_time():
    own = bpe.Encoder(bpe.tokenizer_path())
    tok, held = own.tok, []

    class Counting:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, texts, **options):
            held.append(sum(t.count(" ") for t in texts))
            return tok.encode_batch_fast(texts, **options)

    own.tok = Counting()
    words = " ".join(f"w{k}x" for k in range(30_000))
    ids, off = own.encode(pa.array([words]))
    assert max(held) <= 10_000 and ids.tolist() == tok.encode(words, add_special_tokens=False).ids
    texts = pa.array([f"{k} " * 100_000 for k in range(40)] + [None])
    parts = list(own.parts(texts))
    assert max(len(i) for i, _ in parts) < 4_000_000 and sum(len(o) - 1 for _, o in parts) == len(texts)
