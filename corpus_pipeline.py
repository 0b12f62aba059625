"""Training-corpus pipeline: language, quality, near duplicates, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.llm.catalog import tokenizer_file
from trove.llm.language_id import UNDETERMINED, collect_profiles, held_out, identify, train_profiles
from trove.llm.order_minhash import near_duplicates
from trove.llm.packing import pack
from trove.llm.quality_rules import robust_outliers
from trove.plans.scratch import materialise, sized
from trove.plans.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose n-grams agree less than this with the nearest language are of none; prose scores 0.4 and more.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are in one of the learned languages; those without a letter or like none of them go."""
    profiles = collect_profiles(train_profiles(docs.where(~held_out(F.col("doc_id")))))
    found = identify(docs, profiles, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie far from their language and source."""
    marked = docs.withColumn("mark", F.xxhash64("text", "lang", "source"))
    verdicts = materialise(robust_outliers(marked, keep=["mark"]), "pipeline-quality")
    out = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("out_id"), F.col("in_mark").alias("out_mark")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("out_id")) & (F.col("mark") == F.col("out_mark"))
    return marked.join(sized(out), on, "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, that of the smallest id; of repeated ids one row."""
    classes = materialise(near_duplicates(docs), "pipeline-classes")
    out = classes.where("doc_id <> class_id").select("doc_id")
    kept = docs.join(sized(out), "doc_id", "left_anti").select(*COLUMNS)
    repeated = materialise(classes.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(sized(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(sized(repeated), "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("language ID", language), ("quality rules", quality), ("near-dedup", near_dedup), ("packing", packing)]

#: Rank distances, concentration steps and sketches are not for SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
