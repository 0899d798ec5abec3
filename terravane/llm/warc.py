"""WARC archives: a writer of Spark's own tasks and a Python data source that reads them.

The writer makes each record a row and leaves files, retries and commits to Spark. The reader plans partitions of
files, takes record-type and header predicates, parses a record's headers first and skips its block where a predicate
fails or no payload is asked for.

Defined results: null payloads are empty; a null id writes a record id without number and reads as null; null addresses
are left out; control characters in header values become spaces. Of rows with equal payloads the smallest id is the
response; rows that repeat this id are responses too. An empty table gives an archive without records. Columns of the
names that plan_records adds are replaced, all others pass through. A truncated file or a record without length raises.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from terravane.llm._shared import free_names, staged

#: The alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
SCHEMA = (
    "record_id string, type string, target_uri string, date string, content_type string, content_length long, "
    "payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
)
#: Column and header that a predicate can be pushed to.
HEADERS = {"record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1, made from eight groups of 20 bits."""
    digest = F.sha1(payload)
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_digest, record_type and refers_to.

    Groups of equal payloads are counted with partial sums before the shuffle; only those of several ids are joined
    back, so a very large group is one row there and the join may split its copies.
    """
    page = pages.withColumn("payload", F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    page = page.withColumn("payload_digest", base32_sha1(F.col("payload")))
    (first,) = free_names([*pages.columns, "payload", "payload_digest", "record_type", "refers_to"], "_first_id")
    groups = (
        page.where(F.length("payload") >= min_revisit_bytes)
        .groupBy(F.col("payload_digest"))
        .agg(F.min(id_col).alias(first), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # written first, so that Spark knows its size: payloads are shuffled only if it is too large to broadcast
    page = page.join(staged(groups, "warc-groups"), "payload_digest", "left")
    revisit = F.col(first).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(first))
    return page.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col(first)),
    }).drop(first)


def write_warc(planned: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of plan_records() as WARC/1.0 files under path.

    The block is an HTTP message; a revisit keeps the HTTP header alone. Text rows end with the two line ends that end
    a record, so the files are plain WARC.
    """
    def field(name: str, value: Column) -> Column:
        clean = F.regexp_replace(value, r"[\x00-\x1f\x7f]+", " ")
        return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))

    def record_id(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length("payload").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", record_id(F.col(id_col))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col(uri_col).cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(END),
    )
    planned.select(F.concat(head, http, body).alias("value")).write.option("lineSep", END).text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a path or address."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub("^file:", "", path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.names = options["path"], schema.names
        self.target = int(options.get("partitionbytes", 128 << 20))
        self.wanted: dict[str, set] = {}  # by header

    def pushFilters(self, filters):
        """Equality and membership on header columns are decided on headers alone; the rest goes back to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
                yield f
            else:
                name = HEADERS[f.attribute[0]]
                self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Files]:
        """Whole files, small ones together up to the target size."""
        fs, place = _open(self.path)
        info = fs.get_file_info(place)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(place, recursive=True))
        found = sorted((f for f in found if f.is_file and f.size and not re.search(r"(^|/)[._][^/]*$", f.path)), key=lambda f: f.path)
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        host = self.path[len(scheme):].split("/", 1)[0] if scheme and not scheme.startswith("file") else ""
        out: list[list[str]] = []
        room = 0
        for f in found:
            if f.size > room:
                out.append([])
                room = self.target
            out[-1].append(f"{scheme}{host}{f.path}")
            room -= f.size
        return [Files(paths) for paths in out or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.map_(pa.string(), pa.string()) if n == "headers" else pa.int64() if n.endswith("_length") else pa.binary() if n == "payload" else pa.string()) for n in self.names])
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            for row in self.records(path):
                rows.append(row)
                held += len(row.get("payload") or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, path: str) -> Iterator[dict]:
        fs, place = _open(path)
        raw = fs.open_input_file(place)
        stream = gzip.GzipFile(fileobj=raw) if place.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
        with raw:
            while line := stream.readline():
                if not line.strip():
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no WARC record where one is due")
                headers = read_headers(stream)
                low = {k.lower(): v for k, v in headers.items()}
                if not re.fullmatch(r"\d+", low.get("content-length", "")):
                    raise ValueError(f"{path}: a record without a Content-Length")
                left = int(low["content-length"])
                if all(low.get(k) in v for k, v in self.wanted.items()):
                    row = {c: low.get(h) for c, h in HEADERS.items() if c in self.names}
                    row |= {"content_length": left, "headers": list(headers.items())}
                    if "payload" in self.names or "payload_length" in self.names:
                        left = self.block(stream, low, left, row)
                    yield row
                if skip(stream, left) < left:
                    raise ValueError(f"{path}: a record ends too early")

    def block(self, stream, low: dict, left: int, row: dict) -> int:
        """Sets payload and its length, from the HTTP header where there is one; gives the bytes not read."""
        if low.get("content-type", "").startswith("application/http"):
            size, seen = None, 0
            while seen < left:
                line = stream.readline()
                seen += len(line)
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":")[1])
                if not line.strip():
                    break
            left -= seen
            row["payload_length"] = size if size is not None else left
        else:
            row["payload_length"] = left
        if "payload" in self.names and low.get("warc-type") != "revisit":
            row["payload"] = stream.read(left)
            left -= len(row["payload"])  # what is missing of a truncated file
        return left


def read_headers(stream) -> dict[str, str]:
    """Header lines up to the empty one; folded lines join the one before."""
    out: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) and (text := line.decode("utf-8", "replace").rstrip("\r\n")):
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            out[name] = value.strip()
    return out


def skip(stream, n: int) -> int:
    """Pass over n bytes without decoding them; the bytes that there were."""
    if n and not isinstance(stream, gzip.GzipFile):
        stream.seek(n - 1, io.SEEK_CUR)
        return n if stream.read(1) else 0
    left = n
    while left > 0 and (got := len(stream.read(min(left, 1 << 20)))):
        left -= got
    return n - left


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path); a schema without payload leaves blocks unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records under path. A schema of fewer columns reads less."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).load(path)
