"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.llm.byte_bpe import round_trip
from trove.llm.fingerprints import compare_edits
from trove.llm.language_id import collect_profiles, held_out, identify, train_profiles
from trove.llm.order_minhash import near_duplicates
from trove.llm.packing import pack
from trove.llm.quality_rules import robust_outliers
from trove.llm.token_counts import count_tokens
from trove.llm.training_order import training_order
from trove.llm.url_filters import filter_urls, rule_table
from trove.llm.warc import archive_round_trip
from trove.plans.tables import spread, table


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the five fixed rules on every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


OP2_SQL = """
WITH rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'),
                                     ('example.net/de/8', 'block'), ('org/es/', 'block')),
cut AS (SELECT rule, verdict, substr(rule, 1, instr(rule, '/') - 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM rules),
parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN LATERAL (
  SELECT rule, verdict FROM cut
  WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  ORDER BY length(rule) DESC, length(rule_host) DESC LIMIT 1) best ON true
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by profiles of the documents that are not held out."""
    docs = spread(table(spark, sf_dir, "documents"))
    profiles = collect_profiles(train_profiles(docs.where(~held_out(F.col("doc_id")))))
    found = identify(docs, profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and robust distance of every document."""
    return robust_outliers(spread(table(spark, sf_dir, "documents")))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(spread(table(spark, sf_dir, "documents")), tokenizer_file("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return round_trip(spread(table(spark, sf_dir, "documents")), tokenizer_file("byte_bpe_50k.tiktoken"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return archive_round_trip(spread(table(spark, sf_dir, "pages")))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, html, hex, max(page_id) OVER (PARTITION BY html) AS response,
  array_to_string(list_transform(string_split(hex, ''), lambda c: right(bin(instr('0123456789abcdef', c) + 15), 4)), '') AS b FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
      + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM bits
"""


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shuffled sequences in fixed-stride shards, read back."""
    return training_order(spread(table(spark, sf_dir, "documents")), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), key=20240101)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return compare_edits(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage."""
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_url_filters": op2_url_filters,
        "op3_language_id": op3_language_id,
        "op4_token_counts": op4_token_counts,
        "op5_order_minhash": op5_order_minhash,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_packing": op7_packing,
        "op8_warc": op8_warc,
        "op9_training_order": op9_training_order,
        "op10_fingerprints": op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"op2_url_filters": OP2_SQL, "op8_warc": OP8_SQL}
