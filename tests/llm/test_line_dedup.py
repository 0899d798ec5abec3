import re

from pyspark.sql import functions as F

from terravane.llm import line_dedup as L
from terravane.llm._shared import cleanup, new_path, staged

ROWS = [(k, "\n".join([f"a line of its own {k}", "one very common line", f"shared by two {k // 2}", "short"])) for k in range(400)]


def test_first_occurrences_stream_out_of_the_sort(spark):
    """The plan of the sorted part: one range exchange, one sort, the running window, and no other exchange."""
    rows = staged(L.line_rows(spark.createDataFrame(ROWS, "doc_id long, text string")), "lines")
    plan = L.sorted_firsts(rows)._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "rangepartitioning(h1" in plan
    assert len(re.findall(r"\bSort\b", plan)) == 1 and plan.index("Window") < plan.index("Sort") < plan.index("Exchange")


def test_hot_keys_are_judged_alike(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = staged(L.line_rows(docs), "lines")
    assert L.hot_keys(rows).count() == 1
    found = sorted(map(tuple, L.lost_rows(rows).collect()))
    monkeypatch.setattr(L, "HOT_ROWS", 10**9)
    assert L.hot_keys(rows).count() == 0
    assert sorted(map(tuple, L.lost_rows(rows).collect())) == found and len(found) == 399 + 200


def test_long_texts_and_wide_gaps(spark):
    long = "\n".join(f"line number {k:07d}" for k in range(30_000))
    docs = spark.createDataFrame([(1, "line number 0000003\nline number 0029990"), (2, long)], "doc_id long, text string")
    got = L.dedup_lines(docs).where("doc_id = 2").first()
    assert (got.n_lines, got.n_dropped) == (30_000, 2)
    assert got.text.split("\n") == [x for k, x in enumerate(long.split("\n")) if k not in (3, 29_990)]


def test_no_callers_column_is_lost(spark):
    names = ["_words", "_lines", "_dense", "_doc", "_text_hash", "n_lines", "n_dropped", "pos", "word"]
    docs = spark.createDataFrame([(k, t) for k, t in ROWS[:4]], "doc_id long, text string").withColumns({n: F.lit(7) for n in names})
    got = L.dedup_lines(docs, counts=False)
    assert got.columns == docs.columns and all(r[n] == 7 for r in got.collect() for n in names)


def test_cleanup_removes_intermediates(spark, tmp_path):
    from pathlib import Path

    made = staged(spark.range(3), "short-lived")
    where = new_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    assert made.count() == 3 and any(p.name.startswith("short-lived") for p in Path(where).iterdir())
    assert cleanup(spark) >= 2 and not any(Path(where).iterdir())
