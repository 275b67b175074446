"""The operators bound to the tables of the engine, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, linededup, minhash, mixing, packing, pii, quality, search, token_rollup, warc
from .common import materialize, read, scratch_path

TOKENIZER_JSON = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Production passes a secret of its own; a fixed one makes the query repeatable.
PSEUDONYM_KEY = "plumbline"
TOKENIZER = "byte_bpe_50k"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(read(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_archive(spark, path)


def op3_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return search.search_like(docs, docs.filter("doc_id % 50 = 0"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(read(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), mixing.by_length())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("text_hash", "host")


#: Documents under so many characters are taken out of the rollup again.
SHORTEST = 20


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads every document with an estimated count, revises it to the tokenizer's, deletes the very short ones, and sends all batches twice."""
    docs = read(spark, sf_dir, "documents").withColumn("before", F.floor(F.length("text") / 4).cast("long"))
    change = lambda df, op: df.withColumn("tokenizer", F.lit(TOKENIZER)).withColumn("op", F.lit(op))
    loaded = change(docs.select("source", "lang", F.col("before").alias("n_tokens"), F.lit(None).cast("long").alias("before")), "insert")
    counted = materialize(token_rollup.count_tokens(docs, TOKENIZER_JSON, TOKENIZER_RANKS, public_tokenizers.PATTERN), "counted")
    short = counted.filter(F.coalesce("before", F.lit(0)) < SHORTEST // 4)
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    for _ in range(2):
        for batch, changes in [("load-1", loaded), ("revise-1", change(counted, "revise")), ("delete-1", change(short, "delete"))]:
            rollup.commit(batch, changes)
    rollup.compact()
    return rollup.totals()


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER_JSON, TOKENIZER_RANKS, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_feistel_pseudonyms, op2_warc_archive, op3_bm25_search, op4_html_main_text, op5_minhash_near_dedup, op6_line_dedup, op7_source_mixing, op8_quality_rules, op9_token_rollup, op10_harmonic_packing]
    return {f.__name__: f for f in found}


SPACE_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {{docs}}),
keyed AS (SELECT *, {LOWER_SQL.format(f'trim(line, {SPACE_SQL})')} AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS first FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.first AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL.format('text')} AS w FROM {{docs}}),
wins AS (SELECT doc_id, i, w[i:i+7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) AS r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT *, trim(line, {SPACE_SQL}) AS t FROM lines WHERE trim(line, {SPACE_SQL}) <> ''),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
often AS (
  SELECT l.source, {LOWER_SQL.format('t')} AS k FROM full_lines l WHERE len({WORDS_SQL.format('t')}) <= {quality.LINE_WORDS} GROUP BY l.source, k
  HAVING count(DISTINCT text) > {quality.LINE_DOCS} * (SELECT ceil(n / {quality.PER_DOCS}) FROM hosts h WHERE h.source IS NOT DISTINCT FROM l.source)),
lost AS (
  SELECT doc_id, sum(len({WORDS_SQL.format('t')})) AS n FROM full_lines l JOIN often o
  ON l.source IS NOT DISTINCT FROM o.source AND {LOWER_SQL.format('t')} = o.k GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(translate(text, {SPACE_SQL}, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * n_removed_words <= {quality.DEPLETED_PERCENT} * n_words AS kept FROM failed
"""


_FIVE_BITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{c + 1}] >> {35 - 5 * j}) & 31)::INT + 1, 1)" for c in range(4) for j in range(8))
_CHUNKS = ", ".join(f"('0x' || h[{10 * c + 1}:{10 * c + 10}])::BIGINT" for c in range(4))

WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM p),
n AS (SELECT *, [{_CHUNKS}] AS v FROM d)
SELECT page_id, payload_bytes, {_FIVE_BITS} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, true AS verified
FROM n
"""

NEAR_DEDUP_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(LOWER_SQL.format('text'))} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, w[i:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY a, b),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id, min(b) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_archive": WARC_SQL,
        "op5_minhash_near_dedup": NEAR_DEDUP_SQL,
        "op6_line_dedup": LINE_DEDUP_SQL.format(docs="documents"),
        "op8_quality_rules": QUALITY_SQL.format(docs="documents"),
    }
