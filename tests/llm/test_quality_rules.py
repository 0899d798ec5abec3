from pyspark.sql import functions as F

from terravane.llm import quality_rules as Q

SF = "/root/testdata/sf0.1"


def test_cover_learns_a_conjunction():
    cells = [((a, b), int(not (a > 1 and b > 1)), 10) for a in range(4) for b in range(4)]
    rules = Q.cover(cells, cells, [("n_words", [1.0, 2.0, 3.0]), ("word_length", [1.0, 2.0, 3.0])], 0.95, 5)
    assert [r.conditions for r in rules] == [(("n_words", True, 2.0), ("word_length", True, 2.0))]
    assert rules[0].rejected == 80 and rules[0].wrong == 0
    assert rules[0].sql() == "`n_words` > 2.0D AND `word_length` > 2.0D"


def test_no_rule_from_noise():
    cells = [((a,), g, 10) for a in range(4) for g in (0, 1)]
    assert Q.cover(cells, cells, [("n_words", [1.0, 2.0, 3.0])], 0.95, 5) == []


def test_held_out_accuracy(spark):
    """Rules learned on two thirds of the labels find most bad rows of the rest and keep its good ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = Q.features(Q.with_counts(docs).drop("text")).join(labels, "doc_id").cache()
    rules = Q.learn(rows.where("doc_id % 3 > 0"))
    held = rows.where("doc_id % 3 = 0").withColumn("kept", Q.verdict(rules) & ~Q.base_failed())
    n = {(r.quality, r.kept): r["count"] for r in held.where("n_words >= 50").groupBy("quality", "kept").count().collect()}
    rows.unpersist()
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))


def test_no_labels_no_rules(spark):
    rows = Q.features(Q.with_counts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))).withColumn("quality", F.lit(1))
    assert Q.learn(rows) == []


def test_no_callers_column_is_lost(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, _words int, _lines int, _wins int, _sorted int")
    r = Q.with_counts(docs).first()
    assert (r._words, r._lines, r._wins, r._sorted, r.n_words) == (5, 6, 7, 8, 2)
