"""The opN_ queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import license_scan, line_dedup, ngram_join, packing, quality_rules, sharding, token_files, viterbi, warc, webp
from terravane.llm._shared import new_path, staged, table
from terravane.llm.bpe import tokenizer_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a WARC record for each page and reads the archives back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    warc.write_warc(warc.plan_records(pages), path)
    read = warc.read_warc(spark, path, "record_id string, type string, payload_digest string, refers_to string, payload_length long, payload binary")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    response = F.col("type") == "response"
    return read.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, warc.base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the learned list's verdict for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = staged(quality_rules.with_counts(docs).drop("text"), "counts")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_rules.judged(counts, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each whole text states."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", "licenses")


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as lossless WebP, read back and described."""
    return webp.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes, by virtual slots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slotted = staged(sharding.with_slots(docs).drop("text"), "slots")
    stats = sharding.slot_stats(slotted)
    path = new_path(spark, "slot-map")
    slot_map = sharding.initial_map(16)
    sharding.write_map(spark, slot_map, path)
    sharding.write_map(spark, sharding.rebalance(slot_map, {s: b for s, (b, _) in stats.items()}), path)
    placed = sharding.place(slotted, sharding.read_map(spark, path), stats, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.75 or more."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by streaming Viterbi search, and the text that they decode to."""
    return viterbi.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), end_id=1)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines counted and dropped, and the digest of what stays, for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as plane files and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-ids")
    token_files.encode_files(docs, path, tokenizer_path(), end_id=2)
    return token_files.with_global_start(token_files.read_documents(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_license_scan, op4_webp, op5_sharding, op6_ngram_join, op7_sentencepiece, op8_packing, op9_line_dedup, op10_token_files)}

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op1_warc": """
WITH digests AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM digests
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
""",
    "op6_ngram_join": f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {LETTERS}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached(doc_id, root) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT links.b, root FROM reached JOIN links ON links.a = reached.doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
""",
    "op9_line_dedup": f"""
WITH lines AS (
    SELECT doc_id, pos, lines[pos] AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS p(pos)
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
    SELECT k.doc_id, k.pos, k.line, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS gone FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
