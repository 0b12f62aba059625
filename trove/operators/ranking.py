"""Ranked recall: recency, frequency, semantic and structural signals, weighted, vetoed and ordered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.functions.vectors import cosine, cosine_distance, dot

MAX_HOPS = 4
HALF_LIFE_US = 60_000_000
HALF_SATURATION = 10


@dataclass(frozen=True)
class Weights:
    """Signal weights; they must be non-negative and sum to one within a thousandth."""

    recency: float = 0.2
    frequency: float = 0.2
    semantic: float = 0.4
    structural: float = 0.2

    def valid(self) -> bool:
        parts = (self.recency, self.frequency, self.semantic, self.structural)
        return all(p >= 0 for p in parts) and abs(sum(parts) - 1) <= 0.001


@dataclass(frozen=True)
class Query:
    """What a recall is asked for; invalid weights give way to the defaults."""

    at_us: int
    vector: Column
    class_key: int | None = None
    weights: Weights | None = None
    max_hops: int = MAX_HOPS

    def effective(self) -> Weights:
        return self.weights if self.weights and self.weights.valid() else Weights()


def recency(last_us: Column, at_us: Column, half_life: int = HALF_LIFE_US) -> Column:
    """1 now or later, else 1 / (1 + age / half-life); 0 for a half-life of 0."""
    if half_life == 0:
        return F.when(last_us >= at_us, 1.0).otherwise(0.0)
    return F.when(last_us >= at_us, 1.0).otherwise(1.0 / (1.0 + (at_us - last_us) / F.lit(float(half_life))))


def frequency(count: Column, half: int = HALF_SATURATION) -> Column:
    """0 for none, else n / (n + half); 1 for a half of 0."""
    if half == 0:
        return F.when(count == 0, 0.0).otherwise(1.0)
    return F.when(count == 0, 0.0).otherwise(count / (count + F.lit(float(half))))


def semantic(a: Column, b: Column) -> Column:
    """Cosine moved to [0, 1]."""
    return (cosine(a, b) + 1.0) / 2.0


def structural(hop: Column) -> Column:
    """1, .8, .6, .4, .2 for hops 0 to 4; null beyond, which callers refuse."""
    return F.when(hop <= MAX_HOPS, (5.0 - hop) / 5.0)


def scored(candidates: DataFrame, query: Query, vector: str = "embedding") -> DataFrame:
    """Add the four signals, intent_ok, hop_ok and score (0 where the class key differs)."""
    w = query.effective()
    ok = F.lit(True) if query.class_key is None else F.col("class_key") == query.class_key
    out = (
        candidates.withColumn("hop_ok", F.col("hop") <= min(MAX_HOPS, query.max_hops))
        .withColumn("intent_ok", ok)
        .withColumn("recency", recency(F.col("last_us"), F.lit(query.at_us)))
        .withColumn("frequency", frequency(F.col("access_count")))
        .withColumn("semantic", semantic(F.col(vector), query.vector))
        .withColumn("structural", structural(F.col("hop")))
    )
    total = F.col("recency") * w.recency + F.col("frequency") * w.frequency + F.col("semantic") * w.semantic + F.col("structural") * w.structural
    return out.withColumn("score", F.when(F.col("intent_ok"), F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))).otherwise(0.0))


def rank_all(candidates: DataFrame, query: Query, keep: int | None = None, input_order: bool = False) -> DataFrame:
    """Admitted candidates by falling score, then key.

    ``keep`` limits the result; ``input_order`` takes the first ``keep`` by key before sorting instead of the best.
    """
    found = scored(candidates, query).where("hop_ok AND intent_ok")
    if keep is not None and input_order:
        found = found.orderBy("key").limit(keep)
    found = found.orderBy(F.desc("score"), "key")
    return found.limit(keep) if keep is not None and not input_order else found


def top_k(candidates: DataFrame, query: Query, k: int) -> DataFrame:
    """The k best admitted candidates (TakeOrderedAndProject: no full sort); ties keep the smallest key."""
    return rank_all(candidates, query, keep=k)


def dispatch_stats(candidates: DataFrame, query: Query) -> DataFrame:
    """One row: scanned, ranked, vetoed_hop, vetoed_intent."""
    return scored(candidates, query).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("hop_ok") & F.col("intent_ok")).alias("ranked"),
        F.count_if(~F.col("hop_ok")).alias("vetoed_hop"),
        F.count_if(F.col("hop_ok") & ~F.col("intent_ok")).alias("vetoed_intent"),
    )


def best_match(vectors: DataFrame, query: Column, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The nearest row by cosine distance; the smallest id wins ties; no rows give none."""
    return vectors.select(F.col(id_col), cosine_distance(F.col(vector), query).alias("distance")).orderBy("distance", id_col).limit(1)


def route(queries: DataFrame, seats: DataFrame, by: str = "dot") -> DataFrame:
    """The best seat of every query (query_id, vector) among few seats (seat_id, class_vector).

    Seats are a bounded routing table and are broadcast after a check of their number.
    """
    many = seats.limit(4097).count()
    if many > 4096:
        raise ValueError("a routing table holds 4096 seats at most")
    table = seats.agg(F.collect_list(F.struct("seat_id", "class_vector")).alias("seats")).withColumn("_one", F.lit(1))
    held = queries.withColumn("_one", F.lit(1)).join(F.broadcast(table), "_one")
    # the best seat of a row is found inside the row: no pairs are made
    best = F.array_max(F.transform("seats", lambda s: F.struct(measure_of(by, F.col("vector"), s["class_vector"]).alias("measure"), (-s["seat_id"]).alias("minus"))))
    return held.select("query_id", best.alias("b")).select("query_id", (-F.col("b.minus")).alias("seat_id"), (F.col("b.measure") if by == "dot" else -F.col("b.measure")).alias("measure"))


def measure_of(by: str, a: Column, b: Column) -> Column:
    """Dot product, or negative cosine distance, of a query and a seat."""
    return dot(a, b) if by == "dot" else -cosine_distance(a, b)


def intent_gate(rows: DataFrame, intent: int) -> DataFrame:
    """Add status (0 scored, 1 too far, 2 other intent), gate_score and verified."""
    wrong = (F.lit(intent) != 0) & (F.col("class_key") != intent)
    status = F.when(F.col("hop") > MAX_HOPS, 1).when(wrong, 2).otherwise(0)
    out = rows.withColumn("status", status.cast("long"))
    return out.withColumn("gate_score", F.when(F.col("status") == 0, F.col("score")).otherwise(0.0)).withColumn("verified", (F.col("status") == 0).cast("long"))


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by one aggregate with map-side combine."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def rank_within(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group; Spark limits each group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
