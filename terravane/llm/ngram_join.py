"""N-gram Jaccard join by prefix trees.

1. Texts become sets of shingle hashes. Equal sets are one set from here on, first within a block of documents, then by
   their 128-bit digest, so copies cost one entry for each block.
2. Hashes travel in packed, delta-coded blocks to ranges of hashes, which count how many sets hold each. A hash of one
   set can't join anything and only its number stays; the others go back to their sets with their counts.
3. Global order: rarest first. A set whose first |A| - ceil(t |A|) + 1 hashes are all its own can't reach the similarity
   t and is done. The others, few, are linked where these prefixes meet, and connected into groups.
4. Each group's sets are stored in a trie, in the global order from its frequent end, so that near copies share paths.
   Traversal carries the overlap along shared paths, prunes subtrees by set sizes and remaining lengths, and skips
   subtrees that are in one component with the probe already. Groups beyond a bound are dealt by prefix hash and, where
   one hash is still beyond it, by pairs of blocks, so that every pair meets in some task of bounded memory.

Defined results: null, empty or blank text has no set and links with nothing; a text of fewer words is one shingle; a
null id counts as larger than every other and reads as null; repeated rows share a component; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm._shared import MAX_LONG, release_memory, row_key, slices, staged
from terravane.llm.components import connected_components

WORDS, PERCENT = 5, 75
#: Text bytes of a block of documents; sets and hashes of a group that one task takes.
BLOCK_BYTES, GROUP_SETS, GROUP_HASHES = 8 << 20, 10_000, 2_000_000
#: Bytes of a word from which on words are hashed one by one.
LONG_WORD = 64
#: Odd multipliers for mixing 64-bit hashes.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Hashes that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX[k])
    return h ^ (h >> np.uint64(29))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, from eight bytes at a time of all words; words of one length up to 8 never clash."""
    import xxhash

    if not len(words):
        return np.zeros(0, np.uint64)
    start = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32, len(words) + 1, words.offset * (8 if pa.types.is_large_string(words.type) else 4)).astype(np.int64)
    first, size = start[0], np.diff(start)
    start = start[:-1] - first
    data = bytes(memoryview(words.buffers()[2] or b"")[first : first + size.sum()]) + bytes(8)
    chunk = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = _mix(size.astype(np.uint64), 0)
    for k in range(0, min(int(size.max()), LONG_WORD), 8):
        some = np.flatnonzero(size > k) if k else slice(None)
        room = np.maximum(64 - 8 * (size[some] - k), 0).astype(np.uint64)
        low = np.where(room < 64, (chunk[start[some] + k] << np.minimum(room, 63)) >> np.minimum(room, 63), np.uint64(0))
        out[some] = _mix(_mix(out[some] ^ low, 1), 2)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its distinct shingle hashes, sorted, end to end, and where they begin."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    off, values = np.asarray(split.offsets, np.int64), split.values
    off, values = off - off[0], values.slice(off[0], off[-1] - off[0])
    real = pc.greater(pc.binary_length(values), 0)
    off = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][off]
    h = word_hashes(values.filter(real))
    n = np.diff(off)
    out, doc = [], []
    for size in range(1, words + 1):  # texts of fewer words give their one sequence
        count = np.where(n == size, 1, 0) if size < words else np.maximum(n - words + 1, 0)
        ends = np.cumsum(count)
        if not ends.size or not ends[-1]:
            continue
        at = np.arange(ends[-1]) + np.repeat(off[:-1] - (ends - count), count)
        s = np.full(len(at), size, np.uint64)
        for k in range(size):
            s = _mix(s + h[at + k], k % 3)
        out.append(s)
        doc.append(np.repeat(np.arange(len(n)), count))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    h, doc = np.concatenate(out), np.concatenate(doc)
    order = np.argsort(h)
    doc = doc[order]
    order = order[np.argsort(doc.astype(np.uint16) if len(n) < 65536 else doc, kind="stable")]  # 16 bits: by radix
    h, doc = h[order], np.sort(doc)
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    h, doc = h[new], doc[new]
    return h, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(n)))]


def set_digests(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128 bits of each set, as rows of two numbers; of no set 0."""
    n = np.diff(off)
    out = np.zeros((len(n), 2), np.uint64)
    some = n > 0
    for k in range(2):
        out[some, k] = _mix(np.add.reduceat(_mix(h, k + 1), off[:-1][some]) + n[some].astype(np.uint64), k)
    return out


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: their number, types, lengths, then contents."""
    head = f"{len(arrays)};" + ";".join(f"{a.dtype.str},{a.size}" for a in arrays)
    return len(head).to_bytes(4, "little") + head.encode() + b"".join(a.tobytes() for a in arrays)


def _get(data: bytes) -> list[np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for part in bytes(data[4:at]).decode().split(";")[1:]:
        kind, n = part.split(",")
        out.append(np.frombuffer(data, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


BUCKETS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
PARTS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined or cut to about BLOCK_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        step = max(1, int(len(batch) * BLOCK_BYTES / max(1, batch.nbytes)))
        for k in range(0, len(batch), step):
            part = batch.slice(k, step)
            if held and size + part.nbytes > BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _cuts(n_buckets: int) -> np.ndarray:
    """Where the buckets' ranges of 48-bit hashes begin and end."""
    return (np.arange(n_buckets + 1, dtype=object) * (1 << 48) // n_buckets).astype(np.uint64)


def _codes(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the distinct digests, and of each row the place of its digest among them."""
    _, first, code = np.unique(digest, return_index=True, return_inverse=True)
    return first, code.reshape(-1)


def _scatter(n_buckets: int, words: int):
    """Blocks of documents to (bucket, blob): one blob of the documents, and for each range of hashes its postings.

    A posting names its set by a place in the blob's list of 64-bit digests; the other half of a digest and the set's
    size travel once, with its smallest hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids = block.column(0).to_numpy()
            h, off = shingle_sets(block.column(1).combine_chunks(), words)
            del block
            digest, n = set_digests(h, off), np.diff(off)
            rows = [(-1 - int(np.uint64(ids[0]) % np.uint64(n_buckets)), _put(ids, n, digest.reshape(-1)))]
            kept = np.zeros(len(n), bool)
            kept[_codes(np.ascontiguousarray(digest).view("V16").reshape(-1))[0]] = True
            kept &= n > 0
            h = h[np.repeat(kept, n)] >> np.uint64(16)
            digest, n = digest[kept], n[kept]
            of = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            home = np.zeros(len(h), bool)
            home[np.cumsum(n) - n] = True  # the smallest of each set
            order = np.argsort(h)
            h, of, home = h[order], of[order], home[order]
            cuts = np.searchsorted(h, _cuts(n_buckets))
            for b in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[b], cuts[b + 1])
                part = h[at]
                owners, owner = np.unique(of[at], return_inverse=True)
                delta = np.diff(part, prepend=part[:1])
                if delta.max(initial=0) < 1 << 32:
                    delta = delta.astype("<u4")
                own = of[at][home[at]]
                rows.append((int(b), _put(part[:1], delta, owner.astype("<u2" if len(owners) < 65536 else "<u4"), digest[owners, 0], digest[own].reshape(-1), n[own].astype("<u4"))))
            yield from _rows(BUCKETS, rows).to_batches(max_chunksize=64)
            del h, of, home, order, rows
            release_memory()

    return run


def _count(n_buckets: int, n_parts: int):
    """Counts the sets of each hash and sends hashes of two sets or more back to the parts of their sets."""
    def run(key: tuple, data: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:  # documents pass through
            return _rows(PARTS, [(0, -1, b.as_py()) for b in data.column("blob")])
        blobs = [_get(b.as_buffer()) for b in data.column("blob")]
        digest = np.concatenate([b[3] for b in blobs])
        home, size = np.concatenate([b[4].reshape(-1, 2) for b in blobs]), np.concatenate([b[5] for b in blobs])
        first, code = _codes(digest)
        digest = digest[first]
        low, bits = _cuts(n_buckets)[bucket], np.uint64(max(1, len(digest).bit_length()))
        packed, at, base = np.empty(sum(len(b[1]) for b in blobs), np.uint64), 0, 0
        wide = np.empty(0 if (1 << 48) // n_buckets < 1 << (64 - int(bits)) else len(packed), np.uint64)
        for start, delta, owner, own, _, _ in blobs:  # hash and set in one number, where they fit
            h, to = start - low + np.cumsum(delta, dtype=np.uint64), slice(at, at + len(delta))
            if len(wide):
                wide[to] = h
            packed[to] = (h << bits) * np.uint64(not len(wide)) | code[base : base + len(own)].astype(np.uint64)[owner]
            at, base = at + len(delta), base + len(own)
        del blobs, data
        if len(wide):
            order = np.lexsort((packed, wide))
            h, owner = wide[order], packed[order].astype(np.uint32)
            new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
            h, owner = h[new], owner[new]
        else:
            packed.sort()
            packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
            h, owner = packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.uint32)
        del packed, wide
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[start, len(h)])
        shared = np.repeat(count > 1, count)
        h, owner = h[shared] + low, owner[shared]
        count = count[count > 1]
        df = np.repeat(np.minimum(count, 65535).astype("<u2"), count)
        part = (digest % np.uint64(n_parts)).astype(np.int64)
        order = np.lexsort((owner, part[owner]))
        h, owner, df = h[order], owner[order], df[order]
        cuts = np.searchsorted(part[owner], np.arange(n_parts + 1))
        home_part = (home[:, 0] % np.uint64(n_parts)).astype(np.int64)
        rows = []
        for p in range(n_parts):
            a, b = cuts[p], cuts[p + 1]
            at = np.flatnonzero(home_part == p)
            if b > a or len(at):
                own, count = np.unique(owner[a:b], return_counts=True)
                rows.append((1, p, _put(home[at].reshape(-1), size[at], digest[own], count.astype("<u4"), h[a:b], df[a:b])))
        del h, owner, df, order, shared, start
        release_memory()
        return _rows(PARTS, rows)

    return run


SETS = pa.schema([("sid", pa.binary()), ("n", pa.int32()), ("prefix", pa.int32()), ("n_hashes", pa.int32()), ("hashes", pa.binary())])


def _survivors(percent: int):
    """Sets whose prefix holds shared hashes; hashes: those of two sets or more, rarest first; prefix: how many of
    them are in the set's prefix."""
    def run(key: tuple, data: pa.Table) -> pa.Table:
        homes, sizes, digests, counts, hashes, dfs = map(np.concatenate, zip(*(_get(b.as_buffer()) for b in data.column("blob")), strict=True))
        digest, size = homes.reshape(-1, 2), sizes.astype(np.int64)
        order = np.argsort(digest[:, 0])  # blocks of documents may hold the same set
        order = order[np.r_[True, np.diff(digest[order, 0]) > 0]] if len(order) else order
        digest, size = digest[order], size[order]
        owner = np.repeat(np.searchsorted(digest[:, 0], digests), counts)
        order = np.lexsort((hashes, dfs, owner))
        h, owner = hashes[order], owner[order]
        shared = np.bincount(owner, minlength=len(size))
        prefix = np.minimum(shared, size + (-percent * size // 100) + 1 - (size - shared))  # -ceil(x) = floor(-x)
        ends = np.cumsum(shared)
        rows = [(digest[k].tobytes(), int(size[k]), int(prefix[k]), int(shared[k]), h[ends[k] - shared[k] : ends[k]].tobytes()) for k in np.flatnonzero(prefix > 0)]
        return _rows(SETS, rows)

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, sid) of each survivor's prefix."""
    for batch in batches:
        prefix = batch.column("prefix").to_numpy()
        found = [np.frombuffer(b.as_buffer(), np.int64, k) for b, k in zip(batch.column("hashes"), prefix, strict=True)]
        at = pa.array(np.repeat(np.arange(len(batch)), prefix))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), batch.column("sid").take(at)], ["hash", "sid"])


class PrefixTree:
    """Sets of ordered tokens on shared paths; a node's tokens are the part of the path that no other set leaves."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        self.root = self._node([])
        self.sizes: list[int] = []
        self.parent: list[int] = []  # of items, by component

    @staticmethod
    def _node(tokens: list[int]) -> dict:
        return {"tokens": tokens, "next": {}, "items": [], "low": 1 << 60, "high": 0, "rest": 0, "one": -1, "mixed": False}

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, tokens: list[int], n: int) -> int:
        """Join the set with those added before, then store it. n: its whole size."""
        item = len(self.sizes)
        self.sizes.append(n)
        self.parent.append(item)
        self._probe(item, {t: k for k, t in enumerate(tokens)}, n)
        self._insert(item, tokens, n)
        return item

    def _insert(self, item: int, tokens: list[int], n: int) -> None:
        node, at = self.root, 0
        while True:
            node["low"], node["high"] = min(node["low"], n), max(node["high"], n)
            own, k = node["tokens"], 0
            while k < len(own) and at + k < len(tokens) and own[k] == tokens[at + k]:
                k += 1
            if k < len(own):  # split: the rest of the path goes below
                below = dict(node, tokens=own[k:])
                for x in (below, node):
                    x["items"] = list(x["items"])
                node["tokens"], node["next"], node["items"] = own[:k], {own[k]: below}, []
                below["low"], below["high"] = self._range(below)
            at += k
            rest = len(tokens) - at
            node["rest"] = max(rest, max((len(x["tokens"]) + x["rest"] for x in node["next"].values()), default=0)) if k < len(own) else max(node["rest"], rest)
            if node["one"] < 0:
                node["one"] = item
            elif self.find(node["one"]) != self.find(item):
                node["mixed"] = True
            if at == len(tokens):
                node["items"].append(item)
                return
            below = node["next"].get(tokens[at])
            if below is None:
                below = node["next"][tokens[at]] = self._node(tokens[at:])
                below["low"] = below["high"] = n
                below["one"] = item
                below["items"].append(item)
                return
            node = below

    def _range(self, node: dict) -> tuple[int, int]:
        sizes = [self.sizes[i] for i in node["items"]]
        low = min([*sizes, *(x["low"] for x in node["next"].values())])
        return low, max([*sizes, *(x["high"] for x in node["next"].values())])

    def _probe(self, item: int, rank: dict[int, int], n: int) -> None:
        percent, find = self.percent, self.find
        stack = [(self.root, 0, len(rank))]  # node, overlap above it, tokens of the probe after the last shared one
        while stack:
            node, overlap, left = stack.pop()
            if 100 * node["high"] < percent * n or percent * node["low"] > 100 * n or node["one"] < 0:
                continue
            if not node["mixed"] and find(node["one"]) == find(item):
                continue  # all of the subtree is linked with the probe already
            need = -(-percent * (n + node["low"]) // (100 + percent))
            tokens, rest = node["tokens"], node["rest"]
            room = len(tokens) + rest  # tokens that the subtree still has
            for t in tokens:
                room -= 1
                k = rank.get(t)
                if k is not None:
                    overlap += 1
                    left = len(rank) - k - 1
                elif overlap + (room if room < left else left) < need:
                    break
            else:
                if overlap + min(left, rest) < need:
                    continue
                for other in node["items"]:
                    if (100 + percent) * overlap >= percent * (n + self.sizes[other]):
                        a, b = find(other), find(item)
                        self.parent[max(a, b)] = min(a, b)
                if node["mixed"] and not node["items"]:
                    ones = {find(x["one"]) for x in node["next"].values() if not x["mixed"]}
                    if len(ones) == 1 and not any(x["mixed"] for x in node["next"].values()):
                        node["mixed"] = False
                stack += [(x, overlap, left) for x in node["next"].values()]


def join_sets(sets: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> list[int]:
    """Of each (size, hashes, rarest first) the position of a set in its component, the same for all of it."""
    codes = np.unique(np.concatenate([h for _, h in sets]), return_inverse=True)[1].tolist() if sets else []
    tokens, at = [], 0
    for _, h in sets:
        tokens.append(codes[at : at + len(h)][::-1])
        at += len(h)
    order = sorted(range(len(sets)), key=lambda k: (sets[k][0], k))
    tree = PrefixTree(percent)
    for k in order:
        tree.add(tokens[k], sets[k][0])
    return [order[r] for _, r in sorted((k, tree.find(j)) for j, k in enumerate(order))]


def _join_groups(percent: int):
    """(task, sid, n, hashes), sorted by task, to (u, v) links of each set with one of its component."""
    def links(group: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
        root = join_sets([(n, h) for _, n, h in group], percent)
        pairs = [(group[k][0], group[r][0]) for k, r in enumerate(root) if k != r]
        return pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.binary()) for j in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = None, []
        for batch in batches:
            for t, sid, n, h in zip(*(batch.column(c) for c in ("task", "sid", "n", "hashes")), strict=True):
                if group and t.as_py() != task:
                    yield links(group)
                    group = []
                task = t.as_py()
                group.append((sid.as_py(), n.as_py(), np.frombuffer(h.as_buffer(), np.uint64)))
        if group:
            yield links(group)

    return run


def _tasks(groups: DataFrame, postings: DataFrame, sets: DataFrame, most_sets: int, most_hashes: int) -> DataFrame:
    """(task, sid, n, hashes): groups within the bounds whole, others by prefix hash and pairs of blocks."""
    sized = groups.join(sets, "sid")
    size = staged(sized.groupBy("component").agg(F.count("*").alias("k"), F.sum("n_hashes").alias("w")), "group-sizes")
    large = size.where((F.col("k") > most_sets) | (F.col("w") > most_hashes)).select("component")
    whole = sized.join(large, "component", "left_anti").select(F.concat(F.lit("g"), F.hex("component")).alias("task"), "sid", "n", "hashes")
    if not large.head(1):
        return whole
    held = postings.join(groups.join(large, "component", "left_semi"), "sid").join(sets.select("sid", "n_hashes"), "sid")
    runs = held.groupBy("hash").agg(F.count("*").alias("k"), F.sum("n_hashes").alias("w")).where("k > 1")
    blocks = staged(runs.select("hash", F.expr(f"cast(ceil(greatest(k / {most_sets}, w / {most_hashes})) AS int)").alias("blocks")), "runs")
    dealt = held.join(blocks, "hash").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.concat_ws("-", F.col("hash"), F.least("own", "other"), F.greatest("own", "other"))
    return whole.union(dealt.select(task.alias("task"), "sid").join(sets, "sid").select("task", "sid", "n", "hashes"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, most_sets: int = GROUP_SETS, most_hashes: int = GROUP_HASHES, with_sets: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id) of each document: documents link when their sets' Jaccard similarity is at
    least percent / 100; a component's id is its smallest document id. with_sets: and the digest of its set as sid."""
    spark = docs.sparkSession
    n = slices(spark)
    buckets = max(4, 2 * n // 3)  # few, as each block lists its sets for each; a task holds a number for each posting
    texts = docs.select(row_key(F.col(id_col)).alias("doc"), F.col(text_col).alias("text"))
    blobs = texts.mapInArrow(_scatter(buckets, words), "bucket int, blob binary")
    counted = staged(blobs.groupBy("bucket").applyInArrow(_count(buckets, n), "kind int, part int, blob binary"), "shingles")

    sets = counted.where("kind = 1").select("part", "blob").groupBy("part").applyInArrow(_survivors(percent), "sid binary, n int, prefix int, n_hashes int, hashes binary")
    sets = staged(sets, "sets")
    postings = staged(sets.select("sid", "prefix", "hashes").mapInArrow(_postings, "hash long, sid binary"), "postings")
    least = staged(postings.groupBy("hash").agg(F.min("sid").alias("v"), F.count("*").alias("k")).where("k > 1").drop("k"), "least")
    groups = connected_components(postings.join(least, "hash").select(F.col("sid").alias("u"), "v"))
    groups = staged(groups.withColumnRenamed("node", "sid"), "groups")
    tasks = _tasks(groups, postings, sets.select("sid", "n", "n_hashes", "hashes"), most_sets, most_hashes)
    links = tasks.repartition(n, "task").sortWithinPartitions("task").mapInArrow(_join_groups(percent), "u binary, v binary")
    component = connected_components(links).select(F.col("node").alias("sid"), "component")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                ids, size, digest = _get(blob.as_buffer())
                sid = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size.astype(np.int64)), sid], ["doc", "n_shingles", "sid"])

    members = counted.where("kind = 0").select("blob").mapInArrow(documents, "doc long, n_shingles long, sid binary")
    members = members.join(staged(component, "set-components"), "sid", "left").withColumn("label", F.coalesce("component", "sid"))
    sid = ["sid"] if with_sets else []
    members = staged(members.select("doc", "n_shingles", "label", *sid), "members")
    first = staged(members.where("n_shingles > 0").groupBy("label").agg(F.min("doc").alias("first")), "first-members")
    out = members.join(first, "label", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc")))
    named = lambda c: F.nullif(F.col(c), F.lit(MAX_LONG))
    return out.select(named("doc").alias(id_col), "n_shingles", named("component").alias("component_id"), *sid)


def _set_ids(words: int):
    """The digest of each text's set beside its row, as similar_components names sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            h, off = shingle_sets(block.column(1).combine_chunks(), words)
            digest = set_digests(h, off)
            sid = pa.array([d.tobytes() for d in digest], pa.binary())
            yield from pa.table([block.column(0), block.column(1), sid], ["doc", "text", "sid"]).to_batches()

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the smallest id of each component, and of repeated rows with its id and text one. Of rows that
    share an id, each stays or goes by its own text.

    Rows without an id can't be named by others and stay.
    """
    members = staged(similar_components(docs, id_col, text_col, with_sets=True).select(id_col, "component_id", "sid"), "components")
    gone = staged(members.where(F.col("component_id") < F.col(id_col)).select(id_col, "sid").distinct(), "gone")
    repeated = staged(members.groupBy(id_col).count().where(f"count > 1 AND `{id_col}` IS NOT NULL").select(id_col), "repeated")
    if not repeated.head(1):
        return docs.join(gone.select(id_col), id_col, "left_anti").select(docs.columns)
    kept = docs.join(gone.select(id_col).distinct(), id_col, "left_anti").join(repeated, id_col, "left_anti")
    again = docs.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    texts = again.where(F.col(text_col).isNotNull()).select(row_key(F.col(id_col)).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_set_ids(WORDS), "doc long, text string, sid binary")
    out = texts.join(gone.withColumnRenamed(id_col, "doc"), ["doc", "sid"], "left_semi").select(F.col("doc").alias(id_col), F.col("text").alias(text_col))
    return kept.unionByName(again.join(staged(out, "gone-texts"), [id_col, text_col], "left_anti")).select(docs.columns)
