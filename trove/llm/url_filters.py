"""URL filters: expand, join on short hash prefixes, confirm full digests, apply rule precedence.

A rule is a host and a path prefix written as one string (``example.com/en/7``).  It fits its host and every
subdomain of it, for paths that start with the rule's path.  Each URL is expanded into exactly one expression per
*shape* of rule (number of host labels, length of path), so the expansion is bounded by the rule list and not by
the URLs.  Expressions meet rules by equality of the first 32 bits of SHA-256; a full digest then confirms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
#: Rules up to this many are broadcast (about 25 MB); more are joined by a salted shuffle.
BROADCAST_RULES = 100_000
SALTS = 16
MAX_SHAPES = 4096


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """A rule frame (rule, verdict) from pairs; rules must hold a ``/`` after the host."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    pages: any frame with the id and URL columns; other columns are ignored, whatever their names.
    rules: (rule string, verdict string).  Of all rules that fit, the longest wins (host and path together, then the
    longer host); among equal rules ``block`` goes before ``allow``.  Rules that are null or lack a ``/`` never fit.
    Null URLs and URLs without ``://`` have an empty host and path, fit nothing and get the default.  Repeated rows
    give repeated results; no rules or no rows give the defaults or no rows.
    """
    cut = F.instr("rule", "/")
    ready = (
        rules.select("rule", "verdict")
        .where(cut > 0)
        .withColumn("rule_host", F.translate(F.substring("rule", F.lit(1), cut - 1), UPPER, LOWER))
        .withColumn("rule_path", F.substring(F.col("rule"), cut, F.length("rule")))
        .groupBy("rule_host", "rule_path")
        .agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))  # block sorts after allow
        .withColumn("labels", F.size(F.split("rule_host", r"\.")))
        .withColumn("path_len", F.length("rule_path"))
    )
    shapes = [(r.labels, r.path_len) for r in ready.select("labels", "path_len").distinct().orderBy("labels", "path_len").limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} combinations of host labels and path length")

    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    if not shapes:
        return base.select(F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("host_labels", F.split("host", r"\."))
    literal = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("path_len")) for a, b in shapes])

    def expression(s: Column) -> Column:
        suffix = F.array_join(F.slice("host_labels", -s["labels"], s["labels"]), ".")
        fits = (F.size("host_labels") >= s["labels"]) & (F.length("path") >= s["path_len"])
        return F.when(fits, F.concat(suffix, F.substring(F.col("path"), F.lit(1), s["path_len"])))

    expanded = parts.select("id", "url", "host", "path", F.posexplode(F.transform(literal, expression)).alias("pos", "expr"))
    expanded = expanded.withColumn("digest", F.sha2("expr", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)).drop("expr")
    # one row per short prefix; its list holds the few full digests that share 32 bits
    rule = F.struct(F.sha2(F.concat("rule_host", "rule_path"), 256).alias("digest"), (F.length("rule_host") + F.col("path_len")).alias("total"), F.length("rule_host").alias("host_len"), "rule", "verdict")
    keyed = ready.select(rule.alias("r")).groupBy(F.substring("r.digest", 1, PREFIX_HEX).alias("rule_prefix")).agg(F.collect_list("r").alias("candidates"))
    if ready.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        matched = expanded.join(F.broadcast(keyed), F.col("prefix") == F.col("rule_prefix"), "left")
    else:
        salted = expanded.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
        spread = keyed.withColumn("rule_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        matched = salted.join(spread, (F.col("prefix") == F.col("rule_prefix")) & (F.col("salt") == F.col("rule_salt")), "left")
    confirmed = F.get(F.filter("candidates", lambda c: c["digest"] == F.col("digest")), F.lit(0))
    rank = F.when(confirmed.isNotNull(), F.struct(confirmed["total"].alias("total"), confirmed["host_len"].alias("host_len"), confirmed["rule"].alias("rule"), confirmed["verdict"].alias("verdict")))
    # the expressions of one row stand next to each other, so the partial aggregate folds them before the shuffle
    judged = (
        matched.select("id", "url", "host", "path", "pos", rank.alias("rank"))
        .groupBy("id", "url")
        .agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("rank").alias("best"), F.count_if(F.col("pos") == 0).alias("copies"))
    )
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")
    ).drop("_copy")
