"""Notes, links and hop-limited search over edge frames (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.plans.scratch import materialise
from trove.plans.tables import table

MAX_HOPS = 4
MAX_TAGS = 8


def wikilinks(body: Column) -> Column:
    """``[[target]]`` and ``[[target|alias]]`` as an array of (target, alias), trimmed; empty targets are skipped."""

    def part(raw: Column) -> Column:
        cut = F.instr(raw, "|")
        target = F.trim(F.when(cut > 0, F.substring(raw, F.lit(1), cut - 1)).otherwise(raw))
        alias = F.when(cut > 0, F.trim(F.substring(raw, cut + 1, F.length(raw))))
        return F.struct(target.alias("target"), alias.alias("alias"))

    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1)), part), lambda x: x["target"] != "")


def hyperlinks(html: Column) -> Column:
    """Targets of anchors in document order."""
    return F.regexp_extract_all(html, F.lit('<a href="([^"]+)"'), F.lit(1))


def _field(head: Column, name: str) -> Column:
    found = F.trim(F.regexp_extract(head, rf"(?m)^{name}:(.*)$", 1))
    return F.nullif(F.regexp_replace(found, r"^[\"'](.*)[\"']$", "$1"), F.lit(""))


def parse_notes(rows: DataFrame, source: str = "source_text", stem: str = "stem") -> DataFrame:
    """Add id, title, tags, status, score and body from Markdown with a front matter.

    The block opens only on the first line and must be closed; otherwise the whole text is the body.  Tags may be a list
    in brackets, separated by commas, or one a line; quotes go, empty ones go, and ``MAX_TAGS`` remain.  A score that is
    no number is 0; a missing id is the file's stem.
    """
    block = F.regexp_extract(source, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace(source, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", "")
    inline = _field(F.col("_head"), "tags")
    listed = F.regexp_extract_all("_head", F.lit(r"(?m)^[ \t]*-[ \t]+(.+)$"), F.lit(1))
    raw = F.when(inline.isNotNull(), F.split(F.regexp_replace(inline, r"^\[|\]$", ""), ",")).otherwise(listed)
    clean = F.transform(raw, lambda t: F.regexp_replace(F.trim(t), r"^[\"'](.*)[\"']$", "$1"))
    out = rows.withColumn("_head", block)
    return (
        out.withColumn("id", F.coalesce(_field(F.col("_head"), "id"), F.col(stem)))
        .withColumn("title", _field(F.col("_head"), "title"))
        .withColumn("tags", F.slice(F.filter(clean, lambda t: t != ""), 1, MAX_TAGS))
        .withColumn("status", _field(F.col("_head"), "status"))
        .withColumn("score", F.coalesce(F.expr("try_cast(trim(regexp_extract(_head, '(?m)^score:(.*)$', 1)) AS double)"), F.lit(0.0)))
        .withColumn("body", body)
        .drop("_head")
    )


def note_edges(notes: DataFrame) -> DataFrame:
    """(src, dst, alias, place) for every link of parsed notes."""
    return notes.select(F.col("id").alias("src"), F.posexplode(wikilinks(F.col("body"))).alias("place", "link")).select("src", F.col("link.target").alias("dst"), F.col("link.alias").alias("alias"), "place")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, source_text) of the Markdown files of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").withColumn("_path", F.col("_metadata.file_name"))
    return files.select(F.regexp_replace("_path", r"\.md$", "").alias("stem"), F.col("value").alias("source_text"))


def edges_from(edges: DataFrame, node: str) -> DataFrame:
    """Edges that leave a node."""
    return edges.where(F.col("src") == node)


def edges_to(edges: DataFrame, node: str) -> DataFrame:
    """Edges that reach a node."""
    return edges.where(F.col("dst") == node)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every node, in one aggregation."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hop_distances(edges: DataFrame, roots: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(root, node, hop): the fewest hops from each root (column node) to what it reaches, up to ``max_hops``.

    Each round joins the frontier with the edges and drops what was reached before; rounds are written tables, so the
    plan does not grow, and a cycle ends by itself.
    """
    max_hops = min(max_hops, MAX_HOPS)
    reached = materialise(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("hop")).distinct(), "hops")
    frontier = reached
    for hop in range(1, max_hops + 1):
        found = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialise(found.join(reached, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        reached = reached.unionByName(frontier)
    return reached


def shortest_hop(edges: DataFrame, source: str, target: str) -> int | None:
    """Fewest hops between two nodes: 0 for the same, null beyond the limit; an unknown node is refused."""
    known = degrees(edges).where(F.col("node").isin(source, target)).select("node").collect()
    if {source, target} - {r.node for r in known}:
        raise KeyError("unknown node")
    spark = edges.sparkSession
    found = hop_distances(edges, spark.createDataFrame([(source,)], "node string")).where(F.col("node") == target)
    row = found.agg(F.min("hop")).first()
    return row[0]


def graph_levels(edges: DataFrame, root: str, depth: int = MAX_HOPS) -> DataFrame:
    """(hop, name, degree): what a root reaches, with real out-degrees; depth is held to 0..4."""
    depth = max(0, min(depth, MAX_HOPS))
    spark = edges.sparkSession
    hops = hop_distances(edges, spark.createDataFrame([(root,)], "node string"), depth)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return hops.join(out, F.col("node") == F.col("src"), "left").select("hop", F.col("node").alias("name"), F.coalesce("degree", F.lit(0)).alias("degree"))


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign-key edges: order to customer, customer and supplier to nation, nation to region."""
    t = lambda name: table(spark, sf_dir, name)
    tag = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    frames = [
        t("orders").select(tag("o", "o_orderkey").alias("src"), tag("c", "o_custkey").alias("dst")),
        t("customer").select(tag("c", "c_custkey"), tag("n", "c_nationkey")),
        t("supplier").select(tag("s", "s_suppkey"), tag("n", "s_nationkey")),
        t("nation").select(tag("n", "n_nationkey"), tag("r", "n_regionkey")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out
