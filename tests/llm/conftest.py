import pytest

#: Nulls, empty, blank and very long texts, ties, repeated rows and ids.
EDGE = [
    (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "a b c d e"), (10, "a b c d e"), (10, "a b c d e"), (10, "other text of five words"),
    (None, "a b c d e"), (None, None), (11, "word " * 30_000), (12, "  lead and trail  \n\n same line here\nsame line here"), (13, "SAME LINE HERE\nfresh line of text"),
    (14, "é ü ß 漢字   <|endoftext|> \r\n x \n y   z"), (-3, "negative id\x00with nul"), (15, "x" * 50_000), (16, "same line here \n same line here"), (17, "#*$%&|<> " * 60),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases with clashing extra columns."""
    rows = [(i, t, "en", "s", len(t or ""), k, "x") for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, part string").repartition(3)


@pytest.fixture(scope="session")
def edge_dir(edge_docs, tmp_path_factory):
    """A folder of tables with the edge cases."""
    where = str(tmp_path_factory.mktemp("edge"))
    edge_docs.write.parquet(f"{where}/documents.parquet")
    spark = edge_docs.sparkSession
    pages = edge_docs.selectExpr("doc_id AS page_id", "concat('http://x/', doc_id, '\r\nfoo: 1') AS url", "text AS html", "part AS payload")
    pages.write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([(9, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


@pytest.fixture(scope="session")
def empty_dir(edge_dir, spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "labels"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    return where
