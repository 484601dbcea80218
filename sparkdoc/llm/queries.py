"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, line_dedup, passages, pieces, quality, secret_scan, sharding, url_filter
from .common import table

#: The model that op4 encodes with.
PIECES_MODEL = "piece_bpe_32k.model"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), sharding.layout(8))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES_MODEL))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.parsed(turns, chat.train(turns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, trees).select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), 50, 5)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 80, 100, 5).select("doc_id", "n_shingles", "component_id")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scanned(docs, secret_scan.train(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


# parts of operators' results that SQL can express, by the same code
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page."""
    return op1_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and slots of the whole table over all shards, and how many rows a further shard takes."""
    out = op2_sharding(spark, sf_dir)
    per = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"))
    return per.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("slots").alias("slots"), F.sum(F.col("last") + 1).alias("lasts"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", *quality.BASE, "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document."""
    return op10_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_RULE = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
URL_SQL = f"""
WITH parts AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM parts)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_RULE.format(t.split('/')[0], '/' + t.partition('/')[2])} THEN '{t}'" for _, t in _RULES)} END AS rule,
  CASE {' '.join(f"WHEN {_RULE.format(t.split('/')[0], '/' + t.partition('/')[2])} THEN '{v}'" for v, t in _RULES)} END AS verdict FROM cut
"""
SIZES_SQL = "SELECT count(*) AS n, (sum(strlen(coalesce(text, ''))) + count(*))::bigint AS size, count(*) AS slots, count(*) AS lasts, 0 AS first_shard, 7 AS last_shard FROM documents"
QUALITY_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
tokens AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
grams AS (SELECT rid, i, word AS a, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c FROM tokens WINDOW x AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams WHERE c IS NOT NULL) WHERE n > 1),
again AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
  SELECT doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    coalesce(lines.n, 0)::bigint AS n_dup_lines, coalesce(again.n, 0)::bigint AS n_repeat_words FROM words LEFT JOIN lines USING (rid) LEFT JOIN again USING (rid))
"""
_either = lambda name: "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in name)
_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS_SQL = f"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda x: length(x) >= 6))::bigint AS n_assign, len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs)),
hot AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT l.rid, l.pos, l.line, h.key IS NOT NULL AS dropped FROM lines l LEFT JOIN hot h ON l.key = h.key),
kept AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept FROM marked GROUP BY rid)
SELECT d.doc_id, k.n_lines, k.n_dropped, sha256(k.kept) AS kept_sha256 FROM kept k JOIN docs d USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_secret_scans": op10_secret_scans,
    "url_rules": url_rules,
    "document_sizes": document_sizes,
    "quality_base": quality_base,
    "secret_counts": secret_counts,
}
SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL, "url_rules": URL_SQL, "document_sizes": SIZES_SQL, "quality_base": QUALITY_SQL, "secret_counts": SECRETS_SQL}
