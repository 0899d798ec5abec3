"""Line dedup across documents.

Hashes of line keys are partitioned by range, with documents and positions as the secondary sort; a running window over
the sorted rows streams each key's first occurrence past its later ones. Every row that comes after the first document
of its key becomes a bit: decisions come back as compressed bitmaps, for each document the 64-line words that lose a
line, and never as text.

A key that many documents hold would be one long run in one task. Such keys are found on a bounded sample of the rows
(HOT_SAMPLE), which settles how work is dealt and nothing else: the first document of each is a minimum over all its
rows, summed up before the shuffle, and its rows are judged by that where they are. All other keys go through the sort.

Defined results: null text is one empty line; a null id counts as larger than every other; repeated ids decide alike,
each row by its own text; keys shorter than min_chars never go; an empty table gives no rows; columns of other names
pass through, n_lines and n_dropped are replaced where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm._shared import SPACE, ascii_lower, free_names, row_key, slices, staged

MIN_CHARS = 10
#: Rows that hot keys are looked for in, at most about; a key is hot with HOT_ROWS of them and an eighth of a partition.
HOT_SAMPLE, HOT_ROWS = 200_000, 50


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, text_hash, pos) of each line whose key is long enough; the key is two hashes of 64 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        row_key(F.col(id_col)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("pos", "line"),
    ).where(F.length("line") >= min_chars)
    key = F.btrim(F.col("line"), F.lit(SPACE))
    return lines.withColumn("key", key).where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_hash", "pos"
    )


def hot_keys(rows: DataFrame) -> DataFrame:
    """(h1, h2) of keys that hold much of a partition: fewer than HOT_SAMPLE / HOT_ROWS and than 8 for each partition."""
    n = rows.count()  # of a written table, from its footers
    sample = rows.sample(min(1.0, HOT_SAMPLE / max(n, 1)), 1) if n > HOT_SAMPLE else rows
    least = max(HOT_ROWS, min(n, HOT_SAMPLE) // (8 * slices(rows.sparkSession)))
    return sample.groupBy("h1", "h2").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("h1", "h2")


def sorted_firsts(rows: DataFrame) -> DataFrame:
    """Adds first_doc by a running window over range partitions of the hashes, sorted by hash, document and position."""
    order = ["h1", "h2", "doc", "pos"]
    ranged = rows.repartitionByRange(slices(rows.sparkSession), "h1", "h2").sortWithinPartitions(*order)
    running = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("first_doc", F.first("doc").over(running))


def lost_rows(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, pos) of the lines that a document before holds. rows: a written table."""
    hot = staged(hot_keys(rows), "hot-lines")
    judged = sorted_firsts(rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti"))  # hot keys are bounded, see there
    of_hot = rows.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    first = staged(of_hot.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc")), "hot-firsts")
    judged = judged.unionByName(of_hot.join(F.broadcast(first), ["h1", "h2"]))
    return judged.where("doc > first_doc").select("doc", "text_hash", "pos")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_hash, words) of each document that loses lines; words holds (word, bits) of 64 lines each, set bits
    go. Words without a set bit are left out."""
    lost = lost_rows(staged(line_rows(docs, id_col, text_col, min_chars), "lines"))
    word = lost.groupBy("doc", "text_hash", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return word.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """Takes the lines that the bitmaps name out of the text (null only where no line is lost and the text was null) and,
    with counts, adds n_lines and n_dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc, own_hash, words, lines, dense = free_names(docs.columns, "_doc", "_text_hash", "_words", "_lines", "_dense")
    own = docs.withColumns({doc: row_key(F.col(id_col)), own_hash: F.xxhash64(text)})
    bits = bitmaps.select(F.col("doc").alias(doc), F.col("text_hash").alias(own_hash), F.col("words").alias(words))
    joined = own.join(bits, [doc, own_hash], "left")
    # words are sorted: dense from the first to the last, the gaps filled, so that each line finds its own at once
    filled = F.expr(f"flatten(transform({words}, (x, k) -> concat(array_repeat(0L, x.word - coalesce(get({words}, k - 1).word + 1, x.word)), array(x.bits))))")
    joined = joined.withColumns({lines: F.split(text, "\n", -1), dense: filled})
    kept = F.expr(f"filter({lines}, (x, i) -> (coalesce(get({dense}, shiftright(i, 6) - get({words}, 0).word), 0L) & shiftleft(1L, i & 63)) = 0)")
    new = {text_col: F.when(F.col(words).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))}
    if counts:
        new["n_lines"] = F.size(lines).cast("long")
        new["n_dropped"] = F.coalesce(F.expr(f"aggregate({words}, 0L, (n, x) -> n + bit_count(x.bits))"), F.lit(0).cast("long"))
    return joined.withColumns(new).drop(doc, own_hash, words, lines, dense)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, counts: bool = True) -> DataFrame:
    """Documents without the lines that a document of smaller id holds."""
    return keep_lines(docs, drop_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col, counts)
