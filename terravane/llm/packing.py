"""Order-preserving packing of documents into sequences by dynamic programming.

The ids of consecutive documents are one stream. Window cuts may lie at document ends (free), at sentence ends and,
inside longer sentences, at fixed distances (each with a truncation penalty). The cost of a window is its padding; the
cheapest cuts follow from best(j) = pad - c_j + penalty_j + min(best(i) + c_i) over the windows that fit, and a monotone
queue keeps that minimum. Windows of a power of two need no padding and are tried besides.

Defined results: null or empty text is the end id alone; null ids come first; repeated ids stay, by text; a text of any
length is cut; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terravane.llm._shared import release_memory
from terravane.llm.bpe import encoder
from terravane.llm.token_files import in_order

LENGTH = 2048
#: Penalties in tokens: of a cut at a sentence end, of any other cut inside a document, and of a window.
SENTENCE, INSIDE, WINDOW = 16.0, 48.0, 32.0
#: Cuts inside sentences have this distance.
FAR = 128
#: Tokens that the programme runs over at a time; the last windows go to the next run.
RUN = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(tokens: list[str]) -> np.ndarray:
    """Of each token id, whether a sentence ends after it: . ! or ? at its end, or a line end in it (byte-level: Ċ)."""
    return np.array([t.rstrip("\"')")[-1:] in (".", "!", "?") or "Ċ" in t for t in tokens], bool)


def candidates(ends: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, in order, and their penalties. ends: where documents end; is_end: of each token,
    whether a sentence ends with it."""
    kind = np.zeros(len(is_end) + 1, np.int8)  # of each place: 1 a sentence's end, 2 a document's
    kind[1:][is_end] = 1
    kind[ends] = 2
    places = np.flatnonzero(kind)
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > FAR)
    if len(wide):
        kind[np.concatenate([np.arange(places[w] - gaps[w] + FAR, places[w], FAR) for w in wide])] = 3
        places = np.flatnonzero(kind)
    return places, np.array([0.0, SENTENCE, 0.0, INSIDE])[kind[places]]


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Window ends of least cost; the last place is the last cut. No two places are further apart than length."""
    at = np.r_[0, np.asarray(places, np.int64)]
    own = (np.r_[0.0, np.asarray(penalties, float)] + WINDOW).tolist()
    exact: list[list[int] | None] = [None] * len(at)  # of a place those that lie a power of two before it
    for size in (1 << k for k in range(8, length.bit_length()) if 1 << k < length):
        before = np.searchsorted(at, at - size)
        for j in np.flatnonzero((at >= size) & (at[before] == at - size)).tolist():
            exact[j] = [*(exact[j] or ()), int(before[j])]
    c = at.tolist()
    best, back = [0.0], [0]
    value, queue, head = [0.0], [0], 0  # best + place, rising, and whose it is; from head on
    for j in range(1, len(c)):
        p = c[j]
        least = p - length
        while c[queue[head]] < least:
            head += 1
        i = queue[head]
        cost = value[head] - least
        if exact[j]:
            for k in exact[j]:
                if best[k] < cost:
                    cost, i = best[k], k
        cost += own[j]
        best.append(cost)
        back.append(i)
        cost += p
        while len(value) > head and value[-1] >= cost:
            value.pop()
            queue.pop()
        value.append(cost)
        queue.append(j)
    cuts = []
    j = len(c) - 1
    while j > 0:
        cuts.append(c[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents in order and gives pieces: rows of SCHEMA."""

    def __init__(self, is_end: np.ndarray, part: int, length: int = LENGTH, run: int = RUN) -> None:
        self.is_end, self.length, self.run = is_end, length, run
        self.sequence = part << 32
        self.ids: list[np.ndarray] = []
        self.docs: list[list] = []  # [doc id, ids of the document before the stream, ids in the stream, all its ids]
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.ids.append(ids)
        self.docs.append([doc_id, 0, len(ids), len(ids)])
        self.held += len(ids)
        if self.held >= self.run:
            yield from self.pack(last=False)

    def pack(self, last: bool = True) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.ids).astype("<u4")
        ends = np.cumsum([d[2] for d in self.docs])
        places, penalties = candidates(ends, self.is_end[ids])
        cuts = best_cuts(places, penalties, self.length)
        if not last:
            cuts = cuts[:-2]
        at, d = 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc = self.docs[d]
                n = min(int(ends[d]), cut) - at
                yield doc[0], doc[1], n, zlib.crc32(ids[at : at + n]), doc[3], self.sequence, offset
                offset, at = offset + n, at + n
                doc[1], doc[2] = doc[1] + n, doc[2] - n
                d += doc[2] == 0
            self.sequence += 1
        self.docs, self.ids, self.held = self.docs[d:], [ids[at:]], len(ids) - at


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, in ascending id order within ranges of ids; a range has its own sequences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        packer = Packer(sentence_ends(own.tokens()), TaskContext.get().partitionId(), length)
        schema = pa.schema([(n, pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        rows: list[tuple] = []
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for ids, off in own.parts(batch.column(1)):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    rows += packer.add(next(doc_ids), np.append(ids[a:b], np.uint32(end_id)))
                del ids
            del batch
            release_memory()
            if rows:
                yield batch_of(rows)
                rows = []
        rows += packer.pack()
        release_memory()
        if rows:
            yield batch_of(rows)

    return in_order(docs, id_col, text_col).mapInArrow(run, SCHEMA)
