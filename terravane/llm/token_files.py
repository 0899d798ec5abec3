"""Token-id files of bit or byte planes.

A file holds the ids of consecutive documents in blocks of fixed size. A block's ids are transposed into byte planes
(or bit planes), each plane is compressed with zstandard, and an index gives every block's place and plane lengths, so
any range of ids is read by decoding its blocks alone.

Layout: magic, header length (4 bytes), header (JSON: part, first id in the part, number of ids, block size, planes,
block index, document table length), document table (zstandard; ids and lengths as 64-bit integers and a null mask),
planes. Every writer task writes its files in order; readers need no file names.

Defined results: null text is empty and has the end id alone; null document ids come first; repeated ids stay, by text;
an empty table gives files without documents.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm._shared import release_memory, slices, staged
from terravane.llm.bpe import encoder

MAGIC = b"TVID0001"
BLOCK = 1 << 16
FILE_IDS = 1 << 22


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Ids as 4 byte planes, or as 32 bit planes, lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).reshape(-1).view("<u4") if n else np.zeros(0, "<u4")


def write_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, part: int, first: int, kind: str = "byte", block: int = BLOCK) -> bytes:
    """One file: ids of documents, with first ids of the same part before them."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    docs = pack(named.tobytes() + sizes.astype("<i8").tobytes() + known.tobytes())
    planes, index, at = [], [], 0
    for k in range(0, len(ids), block):
        packed = [pack(p) for p in to_planes(ids[k : k + block], kind)]
        index.append([at, *map(len, packed)])
        at += sum(map(len, packed))
        planes += packed
    header = json.dumps({"part": part, "first": first, "ids": len(ids), "docs": len(doc_ids), "doc_bytes": len(docs), "block": block, "planes": kind, "index": index}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, docs, *planes])


class TokenFile:
    """Reads a file's header and documents at once and blocks as they are asked for."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id file")
        self.data, at = memoryview(data), len(MAGIC) + 4
        n = int.from_bytes(data[at - 4 : at], "little")
        self.head = json.loads(data[at : at + n])
        at += n
        self.unpack = zstandard.ZstdDecompressor().decompress
        docs, n = self.unpack(self.data[at : at + self.head["doc_bytes"]]), self.head["docs"]
        self.doc_ids, self.sizes = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "<i8", n, 8 * n)
        self.known = np.frombuffer(docs, np.uint8, n, 16 * n).astype(bool)
        self.body = at + self.head["doc_bytes"]

    def block(self, k: int) -> np.ndarray:
        at, *sizes = self.head["index"][k]
        planes, at = [], at + self.body
        for size in sizes:
            planes.append(self.unpack(self.data[at : at + size]))
            at += size
        return from_planes(planes, min(self.head["block"], self.head["ids"] - k * self.head["block"]), self.head["planes"])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of a range, from the blocks that hold it."""
        size = self.head["block"]
        stop = self.head["ids"] if stop is None else stop
        found = [self.block(k) for k in range(start // size, -(-stop // size))]
        return np.concatenate([*found, np.zeros(0, "<u4")])[start % size if found else 0 :][: stop - start].astype("<u4")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) in partitions of ascending ranges of ids, each sorted."""
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return ranged.repartitionByRange(slices(docs.sparkSession), "id").sortWithinPartitions("id", "text")


def encode_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", file_ids: int = FILE_IDS) -> None:
    """Write the ids of all documents, in ascending id order, as files under path."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), 0, []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held, count
            names = [d for names, _, _ in held for d in names]
            sizes = np.concatenate([s for _, s, _ in held])
            ids = np.concatenate([i for _, _, i in held])
            blob = write_file(names, sizes, ids, part, first, kind)
            first, held, count = first + len(ids), [], 0
            return pa.RecordBatch.from_pydict({"value": pa.array([blob], pa.binary())})

        for batch in batches:
            ids, off = encoder(tokenizer).encode(batch.column(1))
            ids = np.insert(ids, off[1:], end_id)  # after each document
            off = off + np.arange(len(off))
            names = batch.column(0).to_pylist()
            k = 0
            while k < len(names):
                n = max(k + 1, int(np.searchsorted(off, off[k] + file_ids - count, "right")) - 1)
                held.append((names[k:n], np.diff(off[k : n + 1]), ids[off[k] : off[n]]))
                count += int(off[n] - off[k])
                k = n
                if count >= file_ids or k < len(names):
                    yield flush()
        if held:
            yield flush()
        release_memory()

    rows = in_order(docs, id_col, text_col).mapInArrow(write, "value binary")
    rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under path."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                f = TokenFile(data.as_buffer().to_pybytes())
                ids, ends = f.ids(), np.cumsum(f.sizes)
                starts = ends - f.sizes
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(ends), f.head["part"], np.int32)),
                    "doc_id": pa.array(f.doc_ids, mask=~f.known),
                    "start": pa.array(starts + f.head["first"]),
                    "n_tokens": pa.array(f.sizes),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                })

    content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInArrow(read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")


def with_global_start(rows: DataFrame) -> DataFrame:
    """start counted over all parts; the parts, one row each, are summed in order."""
    rows = staged(rows, "token-rows")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(parts, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
