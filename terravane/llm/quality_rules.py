"""Quality rules: a decision list learned from labelled statistics and applied as an ordered Spark expression.

Sequential covering: on the counts of labelled rows by threshold cells a rule (a conjunction of thresholds) is grown by
information gain on two thirds of the rows, pruned on the other third, kept if it is precise there, and the rows that it
covers are taken away. The list is a chain of CASE WHEN conditions; a row that no rule rejects is kept.

Defined results: null text has no words and fails the base rules, as does empty text; texts of any length count whole;
repeated rows get equal values; an empty table gives no rows; without labels of both kinds no rule is learned; columns of
the counts' names are replaced by with_counts, all others pass through; keep_good keeps every column of its documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm._shared import SPACE, SPACE_CLASS, free_names, staged

#: Labelled rows that the list is fitted on at most: those of the smallest id hashes.
MAX_LABELLED = 20_000
SHARES = [i / 16 for i in range(1, 16)]
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_ratio": "n_symbols / n_words",
    "mark_ratio": "n_marks / n_words",
    "upper_ratio": "n_upper / word_chars",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds COUNTS. Windows of three words are compared by 64-bit hashes within a text."""
    own = free_names(docs.columns, "_words", "_lines", "_wins", "_sorted")
    words_col, lines_col, wins, ordered = own
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = docs.withColumns({words_col: words, lines_col: lines})
    df = df.withColumn(wins, F.expr(f"CASE WHEN size({words_col}) >= 4 THEN transform(sequence(0, size({words_col}) - 3), i -> xxhash64(get({words_col}, i), get({words_col}, i + 1), get({words_col}, i + 2))) END"))
    df = df.withColumn(ordered, F.expr(f"CASE WHEN size(array_distinct({wins})) < size({wins}) THEN sort_array(transform({wins}, (h, i) -> struct(h AS h, i AS i))) END"))
    repeated = f"sort_array(transform(filter({ordered}, (x, k) -> x.h <=> get({ordered}, k - 1).h OR x.h <=> get({ordered}, k + 1).h), x -> x.i))"
    covered = f"aggregate({repeated}, struct(0 AS upto, 0L AS n), (a, p) -> struct(p + 3 AS upto, a.n + p + 3 - greatest(a.upto, p) AS n), a -> a.n)"
    return df.withColumns({
        "n_words": F.size(words_col).cast("long"),
        "word_chars": F.length(F.array_join(words_col, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_marks": F.regexp_count(text, F.lit("[!?]")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-ZÀ-Þ]")).cast("long"),
        "n_lines": F.size(lines_col).cast("long"),
        "n_dup_lines": (F.size(lines_col) - F.size(F.array_distinct(lines_col))).cast("long"),
        "n_repeat_words": F.coalesce(F.expr(covered), F.lit(0).cast("long")),
    }).drop(*own)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words")


def features(counts: DataFrame) -> DataFrame:
    """Adds FEATURES; a share of nothing is 0."""
    return counts.withColumns({k: F.coalesce(_ratio(e), F.lit(0.0)) for k, e in FEATURES.items()})


def _ratio(e: str) -> Column:
    over, _, under = e.partition(" / ")
    return F.col(over).cast("double") if not under else F.try_divide(F.col(over).cast("double"), F.col(under).cast("double"))


@dataclass(frozen=True)
class Rule:
    """Rejects rows where every (feature, above, threshold) holds: above means >, else <=."""

    conditions: tuple[tuple[str, bool, float], ...]
    rejected: int  # rows it covered when it was learned, of either kind
    wrong: int  # of those, good ones

    def sql(self) -> str:
        return " AND ".join(f"`{f}` {'>' if above else '<='} {t!r}D" for f, above, t in self.conditions)


def verdict(rules: Iterable[Rule]) -> Column:
    """The list as one expression: true where no rule rejects."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(F.expr(rule.sql()), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, min_precision: float = 0.95, min_rows: int = 5) -> list[Rule]:
    """Rules from rows with FEATURES and a label (1 good, 0 bad). Counts by cell come to the driver, at most max_labelled."""
    names = list(FEATURES)
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.xxhash64(id_col).alias("h"), F.col(label_col).cast("int").alias("good"), *names)
    rows = rows.orderBy("h", *names).limit(max_labelled)
    cuts = rows.groupBy("good").agg(*(F.percentile_approx(n, SHARES, 1000).alias(n) for n in names)).collect()
    if len(cuts) < 2:
        return []
    at = {n: sorted({v for r in cuts for v in r[n]}) for n in names}
    level = {n: sum((F.when(F.col(n) > t, 1).otherwise(0) for t in at[n]), F.lit(0)) for n in names}
    cells = rows.groupBy((F.pmod(F.col("h"), F.lit(3)) == 0).alias("held"), "good", *(level[n].alias(n) for n in names)).agg(F.count("*").alias("n")).collect()
    counted = [(tuple(r[n] for n in names), r.good, r.n, r.held) for r in cells]
    grow, prune = ([c[:3] for c in counted if c[3] == held] for held in (False, True))
    return cover(sorted(grow), sorted(prune), [(n, at[n]) for n in names], min_precision, min_rows)


def _holds(cell: tuple[int, ...], conditions: list[tuple[int, bool, int]]) -> bool:
    return all((cell[f] > k) == above for f, above, k in conditions)


def _sums(cells: list, conditions: list) -> tuple[int, int]:
    """Bad and good rows under the conditions."""
    bad = good = 0
    for levels, is_good, n in cells:
        if _holds(levels, conditions):
            good += n * is_good
            bad += n * (1 - is_good)
    return bad, good


def cover(grow: list, prune: list, cuts: list[tuple[str, list[float]]], min_precision: float, min_rows: int) -> list[Rule]:
    """Sequential covering over (levels, good, n) cells; a condition is (feature, above, level)."""
    rules: list[Rule] = []
    while True:
        conditions = _grow(grow, cuts, min_rows)
        if not conditions:
            return rules

        def worth(k: int, conditions=conditions) -> tuple[float, int]:
            bad, good = _sums(prune, conditions[:k])
            return ((bad + 1) / (bad + good + 2), -k)

        pruned = conditions[: max(range(1, len(conditions) + 1), key=worth)]
        taken = next((c for c in (pruned, conditions) if _precise(c, grow, prune, min_precision, min_rows)), None)
        if taken:
            bad, good = _sums(grow + prune, taken)
            rules.append(Rule(tuple((cuts[f][0], above, cuts[f][1][k]) for f, above, k in taken), bad + good, good))
            grow, prune = ([c for c in cells if not _holds(c[0], taken)] for cells in (grow, prune))
        else:  # these bad rows can't be told from good ones: grow without them
            grow = [c for c in grow if c[1] or not _holds(c[0], conditions)]


def _precise(conditions: list, grow: list, prune: list, min_precision: float, min_rows: int) -> bool:
    """Whether enough rows are covered, and few enough good ones, on all rows and on those held out."""
    held, both = _sums(prune, conditions), _sums(grow + prune, conditions)
    return both[0] >= min_rows and all(bad >= min_precision * (bad + good) for bad, good in (held, both))


def _grow(cells: list, cuts: list, min_rows: int) -> list[tuple[int, bool, int]]:
    """Conditions added while the information gain is above 0 and good rows are covered."""
    conditions: list[tuple[int, bool, int]] = []
    bad, good = _sums(cells, [])
    while bad >= min_rows and good:
        best, choice = 1e-9, None
        for f, (_, values) in enumerate(cuts):
            count = [[0, 0] for _ in range(len(values) + 1)]
            for levels, is_good, n in cells:
                count[levels[f]][is_good] += n
            below = [0, 0]
            for k in range(len(values)):
                below = [below[0] + count[k][0], below[1] + count[k][1]]
                for above, p, q in ((False, *below), (True, bad - below[0], good - below[1])):
                    if p >= min_rows and (gain := p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))) > best:
                        best, choice = gain, (f, above, k)
        if not choice:
            break
        conditions.append(choice)
        cells = [c for c in cells if _holds(c[0], [choice])]
        bad, good = _sums(cells, [])
    return conditions


def judged(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of with_counts() with base_failed and kept, by rules learned on those that labels names. counts is read
    twice: give a written table."""
    rated = features(counts)
    rules = learn(rated.drop("quality").join(labels.select(id_col, "quality"), id_col), id_col)
    return rated.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*FEATURES)


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """FEATURES and quality of the labelled rows that learn() would take, counted for these alone."""
    few = labels.select(id_col, "quality").where(F.col("quality").isin(0, 1)).orderBy(F.xxhash64(id_col), "quality").limit(max_labelled)
    rows = docs.select(id_col, text_col).join(F.broadcast(few), id_col)  # at most max_labelled
    return features(with_counts(rows, text_col).drop(text_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that base rules and learned list keep, with their own columns."""
    named = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}  # own columns may have the counts' names
    rules = learn(staged(labelled_features(docs, labels, id_col, text_col), "labelled"), id_col)
    rated = features(with_counts(docs.withColumnsRenamed(named), named[text_col]))
    # a column that isn't deterministic keeps Spark from moving the filter below the counts, which would copy their
    # expressions into each of its conditions
    rated = rated.withColumn("_row", F.monotonically_increasing_id())
    kept = rated.where(~base_failed() & verdict(rules) & (F.col("_row") >= 0))
    return kept.select(*(F.col(f"`{new}`").alias(c) for c, new in named.items()))
