"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

All five-word sequences of a text are its shingles; line ends are white space like any other, and punctuation around
words is taken off. Windows of two blocks of STRIDE shingles begin at every block, so any STRIDE + 1 shingles in a row lie
in one window whole. A window has BANDS band values, each the least hash of its shingles under a hash function of its
own; a template's windows begin at each of its shingles, and their band values are a table that is joined to the texts'
windows. A window that shares a share j of its shingles with a template's meets it in some band with probability
1 - (1 - j) ** BANDS: 0.990 at j = 4/9, 0.998 at 1/2. The least that a template of five shingles leaves of a window is
j = 4/9; longer ones have many windows. A template of fewer shingles is retrieved by each of them (a window of one
shingle is its own least hash), and one of fewer than five words by the sequence of all its words.

Only templates that were retrieved are verified, around the windows that met them: that stretch must hold PERCENT % of
the template's shingles, or all its words in order. Verdicts depend on the text alone: they are made once for each text
that met a template, named by 128 bits of hash, and joined to all its copies.

Defined results: null and empty text hold no licence; texts of any length are scanned whole; repeated rows get equal
values; an empty table gives no rows; no template gives empty lists; other columns pass through, and one of the name of
the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import license_texts
from terravane.llm._shared import SPACE_CLASS, ascii_lower, free_names, staged

SHINGLE, WINDOW, STRIDE, BANDS, PERCENT = 5, 8, 4, 8, 75
#: Templates of this many shingles are retrieved by windows, of fewer by each shingle. Rows of band values that are
#: broadcast at most; a larger table is joined by its values. Slots of the hashes of texts that met a template: at most so
#: many rows tell, before texts are shuffled, which can't be among them.
LEAST, MAX_BROADCAST, SLOTS = 5, 4_000_000, 1 << 21
#: What is taken off words.
PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»–—•"
#: Short licence statements.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)




def words(text: Column) -> Column:
    """The words of a text, lower-case, without punctuation around them; line ends are white space."""
    each = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE_CLASS, -1)
    return F.filter(F.transform(each, lambda x: F.btrim(x, F.lit(PUNCT_CHARS))), lambda x: x != "")


def spaced(each: Column) -> Column:
    """Words with one space before and after each."""
    return F.concat(F.lit(" "), F.array_join(each, " "), F.lit(" "))


def _sequences(k: int) -> str:
    """Hashes of all sequences of k words of the word hashes in w, in order."""
    each = ", ".join(f"get(w, i + {d})" for d in range(k))
    return f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> xxhash64({each})) ELSE cast(array() AS array<bigint>) END"


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """Adds the word hashes w and the shingles s."""
    return df.withColumn("w", F.transform(words(text), lambda x: F.xxhash64(x))).withColumn("s", F.expr(_sequences(SHINGLE)))


def _band_values(start: str, size: int = WINDOW) -> str:
    """The least hashes of so many shingles from a place on; null where no shingle is left."""
    least = ", ".join(f"array_min(transform(x, h -> xxhash64({band}, h)))" for band in range(BANDS))
    return f"get(transform(array(slice(s, {start} + 1, {size})), x -> array({least})), 0)"


def template_table(spark: SparkSession, templates) -> list[tuple]:
    """(t, name, word count, shingles, text with spaces, needed texts) of each template; the caller's list is bounded."""
    rows = [(k, t[0], t[1], list(t[2]) if len(t) > 2 else []) for k, t in enumerate(templates)]
    made = with_shingles(spark.createDataFrame(rows, "t int, name string, text string, needed array<string>"), F.col("text"))
    made = made.select("t", "name", F.size("w").alias("n"), "s", spaced(words(F.col("text"))).alias("text"), F.transform("needed", lambda x: spaced(words(x))).alias("needed"))
    return [tuple(r) for r in made.where("n > 0").collect()]


def band_table(spark: SparkSession, known: list[tuple]) -> DataFrame:
    """(value, t): by what windows of texts are found to meet a template."""
    df = spark.createDataFrame([(t, n, s, text) for t, _, n, s, text, _ in known], "t int, n int, s array<bigint>, text string")
    df = df.withColumn("w", F.transform(F.split(F.btrim("text"), " "), lambda x: F.xxhash64(x)))
    windows = f"flatten(transform(sequence(0, greatest(size(s) - {WINDOW}, 0)), j -> {_band_values('j')}))"
    own = F.expr(f"CASE WHEN n < {SHINGLE} THEN array(" + " ".join(f"CASE WHEN n = {k} THEN get({_sequences(k)}, 0) END," for k in range(1, SHINGLE)).rstrip(",") + f") WHEN size(s) < {LEAST} THEN s ELSE {windows} END")
    return df.select(F.explode(F.array_distinct(own)).alias("value"), "t").where("value IS NOT NULL")


def tagged(text: Column) -> Column:
    """The ids in a text's SPDX tags, lower-case, without -only, -or-later and +."""
    word = r"[A-Za-z0-9.+-]+"
    tag = rf"(?i)SPDX-License-Identifier:[ \t(]*({word}(?:[ \t()]+(?:AND|OR|WITH)[ \t()]+{word})*)"
    plain = F.regexp_replace(ascii_lower(F.array_join(F.regexp_extract_all(text, F.lit(tag)), " and ")), r"[ \t()]+with[ \t()]+\S+", "")
    ids = F.transform(F.split(plain, r"[ \t()]+(?:and|or)[ \t()]+"), lambda x: F.regexp_replace(x, r"(-only|-or-later|\+|\.)+$", ""))
    return F.filter(ids, lambda x: x != "")


def _candidates(texts: DataFrame, known: list[tuple]) -> DataFrame:
    """(k1, k2, t, j): the windows j of each text that met template t. texts: k1, k2, text."""
    spark = texts.sparkSession
    bands = band_table(spark, known)
    short = sorted({n for _, _, n, *_ in known if n < SHINGLE})
    each = ["zip_with(get(m, j), coalesce(get(m, j + 1), get(m, j)), (a, b) -> least(a, b))"]
    if any(n >= SHINGLE and len(s) < LEAST for _, _, n, s, *_ in known):
        each.append(f"slice(s, {STRIDE} * j + 1, {STRIDE})")
    values = f"transform(sequence(0, (size(w) - 1) div {STRIDE}), j -> struct(cast(j AS int) AS j, concat({', '.join(each)}) AS v))"
    for k in short:  # sequences of k words, where the first of them begins such a template
        first = spark.createDataFrame([(text,) for _, _, n, _, text, _ in known if n == k], "text string").select(F.xxhash64(F.split(F.btrim("text"), " ")[0]))
        firsts = ", ".join(sorted({f"{r[0]}L" for r in first.collect()}))
        hashed = ", ".join(f"get(w, i + {d})" for d in range(k))
        some = f"filter(sequence(0, greatest(size(w) - {k}, 0)), i -> get(w, i) IN ({firsts}))"
        values = f"concat({values}, transform({some}, i -> struct(cast(i div {STRIDE} AS int) AS j, array(xxhash64({hashed})) AS v)))"
    blocks = with_shingles(texts, F.col("text"))
    blocks = blocks.withColumn("m", F.expr(f"transform(sequence(0, (size(w) - 1) div {STRIDE}), j -> {_band_values(f'{STRIDE} * j', STRIDE)})"))
    # outer: Spark would compute the arrays twice, first for a filter on their sizes
    windows = blocks.select("k1", "k2", F.explode_outer(F.expr(values)).alias("x"))
    found = windows.select("k1", "k2", "x.j", F.explode_outer("x.v").alias("value")).where("value IS NOT NULL")
    found = found.join(F.broadcast(bands) if bands.count() <= MAX_BROADCAST else bands, "value")
    return found.select("k1", "k2", "t", "j").distinct()


def _holds(known: list[tuple]) -> tuple[DataFrame, Column]:
    """The templates as a table, and the test of a text's words, shingles and windows js against one."""
    spark = SparkSession.getActiveSession()
    rows = [(t, name, n, sorted(set(s)), text, needed) for t, name, n, s, text, needed in known]
    table = spark.createDataFrame(rows, "t int, name string, n int, own array<bigint>, whole string, needed array<string>")
    table = table.withColumns({"reach": F.size("own") + WINDOW, "stride": F.greatest(F.floor(F.size("own") / 4), F.lit(STRIDE)).cast("int")})
    stretch = f"slice(s, greatest(b * stride - reach, 0) + 1, 2 * reach + {WINDOW} + stride)"  # one for all windows of a stride
    near = F.expr(f"exists(array_distinct(transform(js, j -> j * {STRIDE} div stride)), b -> 100 * size(array_intersect({stretch}, own)) >= {PERCENT} * size(own))")
    needed = (F.size("needed") == 0) | F.expr("exists(needed, x -> contains(text, x))")
    return table, needed & F.when(F.col("n") < SHINGLE, F.contains("text", F.col("whole"))).otherwise(near)


def found_licenses(docs: DataFrame, known: list[tuple], text_col: str = "text") -> DataFrame:
    """(k1, k2, names) of each text that holds a template; k1 and k2 are its hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    met = staged(_candidates(texts, known), "license-windows")
    # one row for each text that met a template; the copies are folded before the shuffle
    slots = met.select(F.pmod("k1", F.lit(SLOTS)).alias("slot")).distinct()  # at most SLOTS rows
    some = texts.withColumn("slot", F.pmod("k1", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    some = some.join(met.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("text").alias("text"))
    some = with_shingles(some, F.col("text")).withColumn("text", spaced(words(F.col("text")))).drop("w")
    table, holds = _holds(known)
    tried = some.join(met.groupBy("k1", "k2", "t").agg(F.collect_list("j").alias("js")), ["k1", "k2"])
    tried = tried.join(F.broadcast(table) if sum(len(s) for _, _, _, s, *_ in known) <= MAX_BROADCAST else table, "t")
    return staged(tried.where(holds).groupBy("k1", "k2").agg(F.collect_set("name").alias("names")), "license-names")


def scan(docs: DataFrame, templates=None, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """Adds the sorted names of the templates that the text holds; of all known ones and SPDX tags where none are given."""
    tags = templates is None
    known = template_table(docs.sparkSession, [*TEMPLATES, *license_texts.templates()] if tags else list(templates))
    names = F.array().cast("array<string>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df, drop = docs, []
    if known:
        drop = free_names(docs.columns, "_k1", "_k2", "_names")
        found = found_licenses(docs, known, text_col).toDF(*drop)
        df = df.withColumns({drop[0]: F.xxhash64(text), drop[1]: F.xxhash64(F.lit(1), text)}).join(found, drop[:2], "left")
        names = F.coalesce(F.col(drop[2]), names)
    if tags:
        names = F.when(F.contains(ascii_lower(text), F.lit("spdx-license-identifier")), F.concat(names, tagged(text))).otherwise(names)
    df = df.withColumn(out_col, F.array_sort(F.array_distinct(names))).drop(*drop)
    for one, other in license_texts.HOLDS.items() if tags else ():
        df = df.withColumn(out_col, F.when(F.array_contains(out_col, one), F.array_remove(out_col, other)).otherwise(F.col(out_col)))
    return df
