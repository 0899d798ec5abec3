"""Byte-level BPE over Arrow batches, each distinct chunk of a text encoded once.

A byte-level pre-tokenizer of the usual pattern always cuts before a single space that has no white space around it on
both sides, so texts are cut there, and the ids of each chunk come from a bounded cache. Texts that hold a special token
or white space on both sides of a space are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT = "byte_bpe_50k.json"
#: White space, a superset of the pattern's own.
BLANK = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\pZ]"
#: Text that is cut into chunks at a time: what bounds a worker's memory.
SLICE_BYTES = 6 << 20
#: Chunks whose encodings are held at a time.
LOT = 10_000
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """encode() gives the ids of texts, end to end, and where each text's ids begin."""

    def __init__(self, path: str, max_cached: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.n_bytes = np.zeros(self.tok.get_vocab_size(), np.int64)  # a byte-level token has a character for each byte
        for token, i in self.tok.get_vocab().items():
            self.n_bytes[i] = len(token)
        kind = json.loads(self.tok.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer")
        self.max_cached = max_cached
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, dict[str, int]] = {" ": {}, "": {}}  # by what stands before the chunk
        self.start, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.n_slots = self.used = 0

    def tokens(self) -> list[str]:
        out = [""] * len(self.n_bytes)
        for token, i in self.tok.get_vocab().items():
            out[i] = token
        return out

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What encode() gives, for about SLICE_BYTES of the texts after another."""
        step = max(1, len(texts) * SLICE_BYTES // max(texts.nbytes, 1))
        for k in range(0, len(texts), step):
            yield self._encode(pc.fill_null(texts.slice(k, step), ""))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = list(self.parts(texts))
        sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(off) for _, off in parts)])
        return np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in parts)]), np.cumsum(sizes)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        whole = np.full(n, not self.by_chunk)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if whole.all():
            return self._whole(texts)
        chunks = pc.split_pattern(texts, " ")
        off, values = np.asarray(chunks.offsets, np.int64), chunks.values
        off, values = off - off[0], values.slice(off[0], off[-1] - off[0])
        first = np.zeros(len(values), bool)
        first[off[:-1]] = True
        at = np.empty(len(values), np.int32)
        tail, head = np.zeros(len(values), bool), np.zeros(len(values), bool)
        for mask, lead in ((~first, " "), (first, "")):
            part = values.filter(pa.array(mask)).dictionary_encode()
            codes, names = np.asarray(part.indices), part.dictionary
            at[mask] = self._slots(lead, names.to_pylist())[codes]
            # ends or begins with white space beyond the space before it
            empty = pc.equal(names, "").to_numpy(zero_copy_only=False) & bool(lead)
            tail[mask] = (pc.match_substring_regex(names, BLANK + "$").to_numpy(zero_copy_only=False) | empty)[codes]
            head[mask] = (pc.match_substring_regex(names, "^" + BLANK).to_numpy(zero_copy_only=False) & bool(lead) | empty)[codes]
        bad = tail[:-1] & head[1:] & ~first[1:]
        if bad.any():
            whole[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = True
        size = self.size[at]
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
        kind = np.int32 if max(self.used, ends[-1]) < 1 << 31 else np.int64
        place = np.repeat((self.start[at] - ends[:-1]).astype(kind), size)
        place += np.arange(ends[-1], dtype=kind)
        ids, doc_off = self.pool[place], ends[off]
        del at, size, ends, place
        if whole.any():
            ids, doc_off = self._patched(ids, doc_off, np.flatnonzero(whole), texts)
        if self.n_slots > self.max_cached:
            self._clear()
        return ids, doc_off

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)

    def _patched(self, ids: np.ndarray, off: np.ndarray, rows: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        new, new_off = self._whole(texts.take(pa.array(rows)))
        parts, at = [], 0
        sizes = np.diff(off)
        for k, row in enumerate(rows):
            parts += [ids[at : off[row]], new[new_off[k] : new_off[k + 1]]]
            at = off[row + 1]
            sizes[row] = new_off[k + 1] - new_off[k]
        return np.concatenate([*parts, ids[at:]]), np.r_[0, np.cumsum(sizes)]

    def _slots(self, lead: str, names: list[str]) -> np.ndarray:
        """Where each chunk's ids are in the pool; chunks that aren't there are encoded."""
        known = self.slot[lead]
        missing = [k for k in names if k not in known]
        plain = [k for k in missing if k and not k[0].isspace() and not k[-1].isspace()] if lead else []
        other = [k for k in missing if not k or k[0].isspace() or k[-1].isspace()] if lead else missing
        for at in range(0, len(plain), LOT):
            groups = [plain[k : k + 200] for k in range(at, min(at + LOT, len(plain)), 200)]
            for group, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int64)
                due = np.cumsum([len(k.encode()) + 1 for k in group])  # cut the ids of the joined text at bytes
                ends = np.cumsum(self.n_bytes[ids])
                cut = np.searchsorted(ends, due) + 1
                if cut[-1] > len(ids) or (ends[cut - 1] != due).any():  # never with a byte-level pattern; then one by one
                    other += group
                else:
                    self._add(lead, group, ids, np.diff(np.r_[0, cut]))
        for at in range(0, len(other), LOT):
            lot = other[at : at + LOT]
            found = [e.ids for e in self.tok.encode_batch_fast([lead + k for k in lot], add_special_tokens=False)]
            self._add(lead, lot, np.array([i for ids in found for i in ids], np.int64), np.array([len(x) for x in found], np.int64))
        return np.fromiter(map(known.__getitem__, names), np.int32, len(names))

    def _add(self, lead: str, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n_slots, self.used
        while n + len(names) > len(self.start):
            self.start, self.size = np.r_[self.start, self.start * 0], np.r_[self.size, self.size * 0]
        while used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, self.pool * 0]
        self.pool[used : used + len(ids)] = ids
        self.start[n : n + len(names)] = used + np.cumsum(sizes) - sizes
        self.size[n : n + len(names)] = sizes
        self.slot[lead].update(zip(names, range(n, n + len(names)), strict=True))
        self.n_slots, self.used = n + len(names), used + len(ids)
