import gzip

import pytest

from terravane.llm import warc

RECORDS = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nX-Long: a\r\n  b\r\nContent-Length: 15\r\n\r\nWARC/1.0\r\n\r\n\r\nx\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: revisit\r\nWARC-Refers-To: <urn:page:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
)


def test_reads_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(RECORDS)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(RECORDS[:120]) + gzip.compress(RECORDS[120:]))
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(r.type for r in got) == ["resource"] * 2 + ["revisit"] * 2 + ["warcinfo"] * 2
    one = next(r for r in got if r.type == "resource")
    assert bytes(one.payload) == b"WARC/1.0\r\n\r\n\r\nx" and one.payload_length == 15 and one.headers["X-Long"] == "a b"


def test_predicates_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(RECORDS)
    df = warc.read_warc(spark, str(tmp_path), "type string, record_id string, headers map<string,string>")
    hit = df.where("type = 'resource' AND record_id IN ('<urn:page:1>', 'x')")
    assert hit.count() == 1
    reader = warc.WarcReader({"path": str(tmp_path)}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("type",), "revisit"), GreaterThan(("content_length",), 1)]))
    assert len(rest) == 1 and [r["type"] for r in reader.records(str(tmp_path / "a.warc"))] == ["revisit"]


def test_truncated_files_raise(tmp_path):
    reader = warc.WarcReader({"path": str(tmp_path)}, type("S", (), {"names": ["type", "payload"]})())
    whole = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 1000\r\n\r\n" + b"x" * 1000 + b"\r\n\r\n"
    for name, data in (("a.warc", whole[:-500]), ("b.warc.gz", gzip.compress(whole[:-500])), ("c.warc", b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n")):
        (tmp_path / name).write_bytes(data)
        for names in (["type", "payload"], ["type"]):
            reader.names = names
            with pytest.raises(ValueError, match="too early|Content-Length"):
                list(reader.records(str(tmp_path / name)))


def test_no_callers_column_is_lost(spark):
    pages = spark.createDataFrame([(1, "u", "x", 7, 8), (2, "u", "x", 7, 8)], "page_id long, url string, html string, first_id int, _first_id int")
    got = warc.plan_records(pages).orderBy("page_id").collect()
    assert [(r.first_id, r._first_id, r.record_type, r.refers_to) for r in got] == [(7, 8, "response", None), (7, 8, "revisit", 1)]
