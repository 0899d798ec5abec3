"""SentencePiece encoding and decoding by a streaming Viterbi search.

Places of the text are visited in order. From each place the pieces that begin there lead to later places, at most one
longest piece away, and every place keeps the best way to it: the place before and the piece. Ids are committed as soon
as all surviving ways go through one boundary: at once where no piece leads past a place, and in long stretches where
the backpointers of all surviving places are found to meet. What is kept is the window since the last boundary; scores
look back over one longest piece, and while ways stay apart only their backpointers wait.

Which way is best depends on the model. Of a unigram model: the largest sum of scores, of equal sums the longer last
piece; characters without a piece cost less than any piece. The scores of a BPE model are the ranks of its merges, whose
sum says nothing. There a way is a run of pieces that merging would leave as they are, which holds if and only if it
holds for each two neighbours: merges inside a run don't depend on what stands beside it as long as none crosses its
ends. So each place has one way, its last piece the one that is compatible with the way before it, and the ids are the
library's. Compatible pairs are found by merging the two pieces' text and kept in a bounded cache.

Characters without a piece become byte pieces. A space is put before the text and spaces are written as the model's own
mark; decoding takes both back, so decode(encode(text)) is the text, but for its own marks, which read as spaces. Where
no piece goes on over a space after another character, such a place is a boundary in every text, and the ids of a short
stretch between two of them are kept in a bounded cache (`cached=False` searches every stretch again, with equal ids).

Defined results: null and empty text have no ids and decode to empty text; texts of any length are searched whole;
repeated rows get equal values; an empty table gives no rows; with_ids and with_text replace a column of the name that
they add, digests returns columns of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Stretches and pairs that a process keeps, characters of a stretch that is kept, and the id before the first piece.
MAX_CACHED, MAX_PAIRS, SHORT, NONE = 1_000_000, 1_000_000, 64, -1


def model_type(data: bytes) -> int:
    """1: unigram, 2: BPE; field 3 of field 2 of a model file."""
    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                out |= (data[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if data[at - 1] < 128:
                    return out

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
                continue
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + n]
            at += n

    trainer = next((v for k, v in fields(data) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


class Pieces:
    """The normal and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(self.names[i][1:-1], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        normal = [i for i in range(len(self.names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.names[i]: (float(sp.get_score(i)), i) for i in normal}
        self.longest = max(map(len, self.score))
        self.missing = min(s for s, _ in self.score.values()) - 10.0  # of a character without a piece
        of_byte = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([of_byte[i]]) if i in of_byte else name.replace(MARK, " ").encode() for i, name in enumerate(self.names)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.merges = model_type(sp.serialized_model_proto()) == 2
        self.root = self._tree()
        self.single = {p for p in self.score if len(p) == 1}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.cached: dict[str, list[int]] = {}

    def _tree(self) -> list:
        """Pieces by their characters: nodes of (id or -1, score, next nodes)."""
        root = [-1, 0.0, {}]
        for piece, (score, i) in self.score.items():
            node = root
            for char in piece:
                node = node[2].setdefault(char, [-1, 0.0, {}])
            node[0], node[1] = i, score
        return root

    def name(self, i: int) -> str:
        """The text of a piece, or of a character without one, whose id is its code point after all pieces."""
        return self.names[i] if i < len(self.names) else chr(i - len(self.names))

    def merged(self, text: str) -> list[str]:
        """A short text by merges: the pair of best score first, of equal ones the leftmost."""
        get, none = self.score.get, (-np.inf, -1)
        parts = list(text)
        gain = [get(a + b, none)[0] for a, b in zip(parts, parts[1:])]
        while gain and (top := max(gain)) > -np.inf:
            k = gain.index(top)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gain[k]
            if k:
                gain[k - 1] = get(parts[k - 1] + parts[k], none)[0]
            if k < len(gain):
                gain[k] = get(parts[k] + parts[k + 1], none)[0]
        return parts

    def _compatible(self, a: int, b: int, known: dict[int, bool]) -> bool:
        """Whether merging leaves the two pieces as they are."""
        parts = ([self.name(a)] if a != NONE else []) + [self.name(b)]
        known[b] = out = self.merged("".join(parts)) == parts
        self.n_pairs += 1
        return out

    def committed(self, text: str) -> Iterator[list[int]]:
        """Runs of ids as they are settled. text: with marks for spaces."""
        return self._by_merges(text) if self.merges else self._by_scores(text)

    def _by_merges(self, text: str) -> Iterator[list[int]]:
        """Each place's one way: by the piece that goes with the last one of the way to where it begins."""
        n, longest, root, pairs, single = len(text), self.longest, self.root, self.pairs, self.single
        base, reach, look = 0, 0, 4 * longest
        last, way = {0: NONE}, {0: 0}  # of the places of the window: last piece, place before it
        for place in range(n):
            if reach <= place:  # no other way survives
                if place > base:
                    yield self._trace(last, way, base, place)
                    last, way, base, look = {place: last[place]}, {}, place, 4 * longest
            elif place - base >= look:
                meet = self._meet(way, place, reach)
                look = 2 * (place - base)  # rarer while ways stay apart
                if meet > base:
                    yield self._trace(last, way, base, meet)
                    last, way = ({p: x for p, x in d.items() if p >= meet} for d in (last, way))
                    base, look = meet, 4 * longest
            a = last.get(place)
            if a is None:
                continue
            if (known := pairs.get(a)) is None:
                known = pairs[a] = {}
            if text[place] not in single:
                b = len(self.names) + ord(text[place])
                if known[b] if b in known else self._compatible(a, b, known):
                    last[place + 1], way[place + 1] = b, place
                    reach = max(reach, place + 1)
            node, at = root, place
            for char in text[place : place + longest]:
                node = node[2].get(char)
                if node is None:
                    break
                at += 1
                b = node[0]
                if b >= 0:
                    fits = known.get(b)
                    if fits or (fits is None and self._compatible(a, b, known)):
                        last[at], way[at] = b, place
                        if at > reach:
                            reach = at
        yield self._trace(last, way, base, n)

    def _by_scores(self, text: str) -> Iterator[list[int]]:
        """Each place's way of the largest sum of scores."""
        n, longest, root, missing = len(text), self.longest, self.root, self.missing
        base, reach, look = 0, 0, 4 * longest
        last, way, best = {0: NONE}, {0: 0}, {0: 0.0}
        for place in range(n):
            if reach <= place:
                if place > base:
                    yield self._trace(last, way, base, place)
                    last, way, best, base, look = {place: last[place]}, {}, {place: best[place]}, place, 4 * longest
            elif place - base >= look:
                meet = self._meet(way, place, reach)
                look = 2 * (place - base)
                if meet > base:
                    yield self._trace(last, way, base, meet)
                    last, way, best = ({p: x for p, x in d.items() if p >= meet} for d in (last, way, best))
                    base, look = meet, 4 * longest
            own, at = best[place], place + 1
            if own + missing > best.get(at, -np.inf):
                best[at], last[at], way[at] = own + missing, len(self.names) + ord(text[place]), place
            reach = max(reach, at)
            node, at = root, place
            for char in text[place : place + longest]:
                node = node[2].get(char)
                if node is None:
                    break
                at += 1
                if node[0] >= 0:
                    if own + node[1] > best.get(at, -np.inf):
                        best[at], last[at], way[at] = own + node[1], node[0], place
                    if at > reach:
                        reach = at
        yield self._trace(last, way, base, n)

    @staticmethod
    def _meet(way: dict[int, int], place: int, reach: int) -> int:
        """The place that the ways of all surviving places go through."""
        alive = {place, *(p for p in range(place + 1, reach + 1) if p in way)}
        while len(alive) > 1:
            late = max(alive)
            alive.remove(late)
            alive.add(way[late])
        return alive.pop()

    def _trace(self, last: dict[int, int], way: dict[int, int], base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            i = last[end]
            if i < len(self.names):
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(chr(i - len(self.names)).encode())]
            end = way[end]
        return out[::-1]

    def ids(self, stretch: str) -> list[int]:
        if self.n_pairs > MAX_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        return [i for run in self.committed(stretch) for i in run]

    def encode(self, text: str, cached: bool = True) -> list[int]:
        """Ids of a text, the library's own for a BPE model."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not (cached and self.cuts):
            return self.ids(marked)
        out: list[int] = []
        held, known = "", self.cached
        for word in marked.split(MARK)[1:]:
            held += MARK
            if word:
                stretch = held + word
                if (found := known.get(stretch)) is None:
                    found = self.ids(stretch)
                    if len(stretch) < SHORT:
                        known[stretch] = found
                out += found
                held = ""
        out += self.ids(held) if held else []
        if len(known) > MAX_CACHED:
            known.clear()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


@cache
def pieces(path: str) -> Pieces:
    """This process's pieces of a model file."""
    return Pieces(path)


def with_ids(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of each text."""
    @F.pandas_udf("array<int>")
    def run(texts):
        own = pieces(model)
        return texts.map(lambda t: own.encode(t or ""))

    return docs.withColumn(ids_col, run(F.coalesce(text_col, F.lit(""))))


def with_text(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of ids."""
    @F.pandas_udf("string")
    def run(ids):
        own = pieces(model)
        return ids.map(lambda x: own.decode(x.tolist()) if x is not None else None)

    return docs.withColumn(text_col, run(F.col(ids_col)))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256) of each document, encoded and decoded in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                rows.append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            n, crc, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
