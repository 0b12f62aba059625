"""Connected components by alternating large-star and small-star steps, each a grouped minimum and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trove.plans.scratch import discard, materialise

MAX_ROUNDS = 60
#: Shares of a hub's rows, each joined by itself.
SALTS = 8


def _with_least(rows: DataFrame, key: str, by: str, least: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with (c, m) on ``key`` = c; a hub's rows are dealt by ``by`` over ``SALTS`` keys, which Spark can split further."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    spread = least.withColumn("_share", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return dealt.join(spread, (F.col(key) == F.col("c")) & (F.col("_salt") == F.col("_share")), how)


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a scratch table, and their count and sum of hashes, taken while they were written."""
    seen = Observation()
    table = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "links")
    return table, (seen.get["n"], seen.get["s"])


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    # large star: larger neighbours of a node go to the smallest node around it, those of a smallest node stay
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("m"), F.lit(False).alias("above")).union(edges.select("v", "u", F.lit(True)))
    low = both.groupBy("c").agg(F.min("m").alias("m"), F.max("above").alias("above")).where("above AND m < c").select("c", "m")
    large = _with_least(edges, "v", "u", low, "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
    # small star: a node and its smaller neighbours go to the smallest of these
    low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"), F.max("v").alias("most"))
    linked = _with_least(large, "u", "v", low.where("m < most").select("c", "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links, root being the smallest id of its component (root = node included).

    Links with a null end or equal ends add nothing but their node.  Grouped minima are pre-aggregated before the
    shuffle and the joins read scratch tables, so Spark can split a hub's partition.
    """
    nodes = links.select(F.col(a).alias("node")).union(links.select(F.col(b))).where("node IS NOT NULL").distinct()
    edges, before = _written(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        spent, (edges, now) = edges, _written(_step(edges))
        discard(spent)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return nodes.join(edges.groupBy("u").agg(F.min("v").alias("r")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("r", "node").alias("root"))


def extended(roots: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A scratch table of (node, root) for every node of ``roots`` and of the links: components over what was a root before.

    roots: (node, root) as ``components`` gives them, in a scratch table.
    """
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = materialise(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct(), "ends")
    top = materialise(components(ends), "tops")
    discard(ends)
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    found = materialise(moved.union(top.join(roots.select("node"), "node", "left_anti")), "extended")
    discard(top)
    return found
