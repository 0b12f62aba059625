"""Queries over records: scans, lookups, changes, ranking and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.functions import vectors as V
from trove.operators import ranking as R
from trove.operators import record_ops as O
from trove.plans.model import candidates, records, spoked
from trove.plans.registry import query
from trove.plans.tables import table

RECORDS = """WITH records AS (
  SELECT event_id AS slot_id, 1000 + list_position(['click','error','purchase','signup','view'], event_type)::BIGINT AS opcode,
    user_id AS subject_id, event_type AS predicate_id, json_extract_string(props, '$.k')::BIGINT AS target_id,
    CASE WHEN event_id % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS flags, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS epoch,
    ts, value, CASE WHEN event_id % 16 = 5 THEN 'tombstone' WHEN event_id % 16 = 11 THEN 'leased' ELSE 'committed' END AS status
  FROM events)
"""
COLUMNS = ["slot_id", "opcode", "subject_id", "predicate_id", "target_id", "flags", "epoch", "value", "status"]
LIST = ", ".join(COLUMNS)


@query("scan_all", RECORDS + f"SELECT {LIST} FROM records WHERE status = 'committed'")
def _(s, d):
    return O.scan_all(records(s, d)).select(*COLUMNS)


@query("scan_all_capped", RECORDS + f"SELECT {LIST} FROM records WHERE status = 'committed' ORDER BY slot_id LIMIT 1024")
def _(s, d):
    return O.scan_all(records(s, d), limit=1024).select(*COLUMNS)


@query("point_lookup", RECORDS + f"SELECT {LIST} FROM records WHERE subject_id = 42 AND status = 'committed'")
def _(s, d):
    return O.point_lookup(records(s, d), 42).select(*COLUMNS)


@query("scan_subject", RECORDS + f"SELECT {LIST} FROM records WHERE subject_id = 7 AND status IN ('committed', 'tombstone')")
def _(s, d):
    return O.scan_subject(records(s, d), 7).select(*COLUMNS)


@query("opcode_scan", RECORDS + f"SELECT {LIST} FROM records WHERE opcode = 1003 AND status = 'committed'")
def _(s, d):
    return O.scan_opcode(records(s, d), 1003).select(*COLUMNS)


@query("multi_constraint", RECORDS + f"SELECT {LIST} FROM records WHERE subject_id = 42 AND epoch >= 5 AND flags & 1 <> 0")
def _(s, d):
    return O.multi_constraint(records(s, d), 42, 5).select(*COLUMNS)


@query("early_exit", RECORDS + f"SELECT {LIST} FROM records WHERE subject_id = 8 ORDER BY slot_id LIMIT 10")
def _(s, d):
    return O.early_exit(records(s, d), 8).select(*COLUMNS)


@query("count_by_opcode", RECORDS + "SELECT count(*) FILTER (opcode = 1002) AS n FROM records")
def _(s, d):
    return O.count_opcode(records(s, d), 1002)


@query("leading_valid", RECORDS + "SELECT count(*) AS n FROM records WHERE slot_id < (SELECT min(slot_id) FROM records WHERE status = 'tombstone')")
def _(s, d):
    return O.leading_valid(records(s, d).withColumn("ok", F.col("status") != "tombstone"), "slot_id", "ok")


@query("spoke_route", RECORDS + "SELECT subject_id % 10 AS spoke, count(*) AS n, min(slot_id) AS first_slot FROM records GROUP BY 1")
def _(s, d):
    return spoked(records(s, d)).groupBy("spoke").agg(F.count(F.lit(1)).alias("n"), F.min("slot_id").alias("first_slot"))


@query("spoke_scan", RECORDS + "SELECT slot_id, subject_id, subject_id % 10 AS spoke FROM records WHERE subject_id % 10 = 3 AND status = 'committed'")
def _(s, d):
    return spoked(records(s, d)).where("spoke = 3 AND status = 'committed'").select("slot_id", "subject_id", "spoke")


KEYS = "SELECT DISTINCT c_custkey % 97 AS subject_id FROM customer"


@query("batch_lookup", RECORDS + f"SELECT {LIST} FROM records WHERE subject_id IN ({KEYS})")
def _(s, d):
    return O.batch_lookup(records(s, d), table(s, d, "customer").select((F.col("c_custkey") % 97).alias("subject_id"))).select(*COLUMNS)


@query("batch_multi_constraint", RECORDS + f"SELECT {LIST} FROM records WHERE subject_id IN ({KEYS}) AND epoch >= 5 AND flags & 1 <> 0")
def _(s, d):
    keys = table(s, d, "customer").select((F.col("c_custkey") % 97).alias("subject_id"))
    return O.batch_lookup(records(s, d).where((F.col("epoch") >= 5) & (F.col("flags").bitwiseAND(1) != 0)), keys).select(*COLUMNS)


SYNTH = """WITH synth AS (SELECT range AS id, range % 10 AS epoch, range // 10000 AS spoke, range % 10000 // 10 AS entity FROM range(1000000))
"""


@query("synthetic_lookup", SYNTH + "SELECT id, 4096 + epoch AS opcode, printf('s_%04d_%06d', spoke, entity) AS subject_id, CASE WHEN epoch % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS flags, epoch FROM synth WHERE spoke = 42 AND entity = 123 AND epoch >= 5 AND epoch % 2 = 1")
def _(s, d):
    rows = O.synthetic(s)
    return rows.where((F.col("subject_id") == "s_0042_000123") & (F.col("epoch") >= 5) & (F.col("flags").bitwiseAND(1) != 0)).select("id", "opcode", "subject_id", "flags", "epoch")


@query("synthetic_spokes", SYNTH + "SELECT spoke, count(*) AS n FROM synth GROUP BY spoke")
def _(s, d):
    return O.synthetic(s).withColumn("spoke", O.spoke_of("subject_id")).groupBy("spoke").agg(F.count(F.lit(1)).alias("n"))


@query("header_rows", "SELECT tag, count(*) AS n, max(tag * 4294967296 + range) AS last FROM (SELECT range, CASE WHEN range < 400000 THEN 1 WHEN range < 700000 THEN 2 ELSE 3 END::BIGINT AS tag FROM range(1000000)) GROUP BY tag")
def _(s, d):
    return O.header_rows(s, 1_000_000).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.max("provenance").alias("last"))


@query("insert_rows", RECORDS + "SELECT slot_id, opcode, subject_id, flags, epoch FROM records UNION ALL SELECT o_orderkey + 10000000, 4001, o_custkey, 0, 1 FROM orders")
def _(s, d):
    new = table(s, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("slot_id"), F.lit(4001).cast("long").alias("opcode"), F.col("o_custkey").alias("subject_id"))
    return O.insert_rows(records(s, d).select("slot_id", "opcode", "subject_id", "flags", "epoch"), new)


@query("update_epoch", RECORDS + "SELECT slot_id, CASE WHEN subject_id = 42 AND status = 'committed' THEN (epoch + 1) % 4294967296 ELSE epoch END AS epoch FROM records")
def _(s, d):
    return O.bump_epoch(records(s, d), 42).select("slot_id", "epoch")


@query("delete_rows", RECORDS + "SELECT CASE WHEN subject_id = 42 AND status = 'committed' THEN 'tombstone' ELSE status END AS status, count(*) AS n FROM records GROUP BY 1")
def _(s, d):
    return O.delete_subject(records(s, d), 42).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- ranking and vectors

CAND = """WITH cand AS (
  SELECT key, label::BIGINT AS class_key, epoch_us(last_ts) AS last_us, access_count, key % 6 AS hop, embedding::DOUBLE[] AS e,
    list_transform(embedding[1:48], lambda x: greatest(least(round(x::DOUBLE * 127), 127), -128)::INT) AS fp
  FROM (SELECT user_id AS key, count(*) AS access_count, max(ts) AS last_ts FROM events GROUP BY 1) u JOIN embeddings ON vec_id = key),
q AS (SELECT embedding::DOUBLE[] AS qe, list_transform(embedding[1:48], lambda x: greatest(least(round(x::DOUBLE * 127), 127), -128)::INT) AS qf FROM embeddings WHERE vec_id = 0),
sig AS (SELECT cand.*, qe, qf, epoch_us(TIMESTAMP '2024-01-15') AS at_us,
  CASE WHEN last_us >= epoch_us(TIMESTAMP '2024-01-15') THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0 + (epoch_us(TIMESTAMP '2024-01-15') - last_us) / 60000000.0::DOUBLE) END AS recency,
  access_count / (access_count + 10.0::DOUBLE) AS frequency,
  (greatest(least(list_inner_product(e, qe) / sqrt(list_inner_product(e, e) * list_inner_product(qe, qe)), 1), -1) + 1) / 2 AS semantic,
  CASE WHEN hop <= 4 THEN (5.0::DOUBLE - hop) / 5.0 END AS structural FROM cand, q),
scored AS (SELECT *, greatest(least(recency * 0.2::DOUBLE + frequency * 0.2::DOUBLE + semantic * 0.4::DOUBLE + structural * 0.2::DOUBLE, 1), 0) AS score FROM sig)
"""
AT_US = 1705276800 * 1_000_000


def _vector(s, d, k: int = 0) -> list[float]:
    """One query vector: a single row by primary key."""
    return [float(x) for x in table(s, d, "embeddings").where(F.col("vec_id") == k).select("embedding").first()[0]]


def recall_query(s, d, **more) -> R.Query:
    return R.Query(AT_US, F.array(*[F.lit(x) for x in _vector(s, d)]), **more)


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Round the doubles that both engines sum in their own order."""
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("ranked_recall", CAND + "SELECT key, access_count, hop, round(score, 6) AS score FROM scored WHERE hop <= 4 ORDER BY scored.score DESC, key LIMIT 10")
def ranked_recall(s, d):
    """Flagship: the ten best candidates of a recall."""
    return _r(R.top_k(candidates(s, d), recall_query(s, d), 10).select("key", "access_count", "hop", "score"), "score")


@query("rank_all", CAND + "SELECT key, round(score, 6) AS score FROM scored WHERE hop <= 4 AND class_key = 3")
def _(s, d):
    return _r(R.rank_all(candidates(s, d), recall_query(s, d, class_key=3)).select("key", "score"), "score")


@query("rank_input_order", CAND + "SELECT key, round(score, 6) AS score FROM scored WHERE hop <= 3 ORDER BY key LIMIT 20")
def _(s, d):
    return _r(R.rank_all(candidates(s, d), recall_query(s, d, max_hops=3), keep=20, input_order=True).select("key", "score"), "score")


@query("top_k", CAND + "SELECT key, round(score, 6) AS score FROM scored WHERE hop <= 2 ORDER BY scored.score DESC, key LIMIT 4")
def _(s, d):
    return _r(R.top_k(candidates(s, d), recall_query(s, d, max_hops=2), 4).select("key", "score"), "score")


@query("top_k_by_class", CAND + "SELECT class_key, key, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY class_key ORDER BY scored.score DESC, key) AS place FROM scored WHERE hop <= 4) WHERE place <= 3")
def _(s, d):
    ranked = R.rank_within(R.scored(candidates(s, d), recall_query(s, d)).where("hop_ok"), "class_key", "score", "key", 3)
    return _r(ranked.select("class_key", "key", "score", F.col("place").cast("long").alias("place")), "score")


@query("dispatch_stats", CAND + "SELECT count(*) AS scanned, count(*) FILTER (hop <= 4 AND class_key = 3) AS ranked, count(*) FILTER (hop > 4) AS vetoed_hop, count(*) FILTER (hop <= 4 AND class_key <> 3) AS vetoed_intent FROM scored")
def _(s, d):
    return R.dispatch_stats(candidates(s, d), recall_query(s, d, class_key=3))


@query("signals", CAND + "SELECT key, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(semantic, 6) AS semantic, structural FROM sig")
def _(s, d):
    out = R.scored(candidates(s, d), recall_query(s, d)).select("key", "recency", "frequency", "semantic", "structural")
    return _r(out, "recency", "frequency", "semantic")


@query("dot_i8", CAND + "SELECT key, list_sum(list_transform(list_zip(fp, qf), lambda p: p[1] * p[2]))::DOUBLE AS dot FROM sig")
def _(s, d):
    c = candidates(s, d)
    q = c.where("key = 0").select("fp").first()
    first = F.array(*[F.lit(x) for x in q[0]]) if q else F.array_repeat(F.lit(0), 48)
    return c.select("key", V.dot(F.col("fp"), first).alias("dot"))


@query("cosine_i8", CAND + "SELECT key, round(list_inner_product(fp::DOUBLE[], qf::DOUBLE[]) / sqrt(list_inner_product(fp::DOUBLE[], fp::DOUBLE[]) * list_inner_product(qf::DOUBLE[], qf::DOUBLE[])), 6) AS similarity FROM sig")
def _(s, d):
    c = candidates(s, d)
    q = c.where("key = 0").select("fp").first()
    first = F.array(*[F.lit(x) for x in q[0]]) if q else F.array_repeat(F.lit(0), 48)
    return _r(c.select("key", V.cosine(F.col("fp"), first).alias("similarity")), "similarity")


EMB = "WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, qe FROM embeddings, q) "


def _emb(s, d):
    return table(s, d, "embeddings"), F.array(*[F.lit(x) for x in _vector(s, d)])


@query("dot_f32", EMB + "SELECT vec_id, round(list_inner_product(e, qe), 6) AS dot FROM v")
def _(s, d):
    e, q = _emb(s, d)
    return _r(e.select("vec_id", V.dot(F.col("embedding"), q).alias("dot")), "dot")


@query("cosine_f32", EMB + "SELECT vec_id, abs(round(1 - list_inner_product(e, qe) / sqrt(list_inner_product(e, e) * list_inner_product(qe, qe)), 6)) AS distance FROM v")
def _(s, d):
    e, q = _emb(s, d)
    return e.select("vec_id", F.abs(F.round(V.cosine_distance(F.col("embedding"), q), 6)).alias("distance"))


@query("l2_f32", EMB + "SELECT vec_id, round(list_distance(e, qe), 6) AS distance FROM v")
def _(s, d):
    e, q = _emb(s, d)
    return _r(e.select("vec_id", V.l2(F.col("embedding"), q).alias("distance")), "distance")


@query("best_match", EMB + "SELECT vec_id, round(1 - list_inner_product(e, qe) / sqrt(list_inner_product(e, e) * list_inner_product(qe, qe)), 6) AS distance FROM v WHERE vec_id <> 0 ORDER BY 2, 1 LIMIT 1")
def _(s, d):
    e, q = _emb(s, d)
    return _r(R.best_match(e.where("vec_id <> 0"), q), "distance")


SEATS = "WITH seats AS (SELECT vec_id AS seat_id, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 16), pairs AS (SELECT vec_id AS query_id, seat_id, embedding::DOUBLE[] AS e, c FROM embeddings, seats WHERE vec_id >= 16) "


def _seats(s, d):
    e = table(s, d, "embeddings")
    return e.where("vec_id >= 16").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.where("vec_id < 16").select(F.col("vec_id").alias("seat_id"), F.col("embedding").alias("class_vector"))


@query("route_dot", SEATS + "SELECT query_id, seat_id, round(m, 6) AS measure FROM (SELECT *, list_inner_product(e, c) AS m, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(e, c) DESC, seat_id) AS r FROM pairs) WHERE r = 1")
def _(s, d):
    return _r(R.route(*_seats(s, d), by="dot"), "measure")


@query("route_cosine", SEATS + "SELECT query_id, seat_id, round(m, 6) AS measure FROM (SELECT *, 1 - list_cosine_similarity(e, c) AS m, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(e, c), seat_id) AS r FROM pairs) WHERE r = 1")
def _(s, d):
    return _r(R.route(*_seats(s, d), by="cosine"), "measure")


@query("intent_gate", CAND + "SELECT key, CASE WHEN hop > 4 THEN 1 WHEN class_key <> 3 THEN 2 ELSE 0 END::BIGINT AS status, round(CASE WHEN hop <= 4 AND class_key = 3 THEN score ELSE 0 END, 6) AS gate_score, CASE WHEN hop <= 4 AND class_key = 3 THEN 1 ELSE 0 END::BIGINT AS verified FROM scored")
def _(s, d):
    out = R.intent_gate(R.scored(candidates(s, d), recall_query(s, d)), 3).select("key", "status", "gate_score", "verified")
    return _r(out, "gate_score")


@query("embedding_slots", "SELECT vec_id, round(list_sum(embedding[1:16]::DOUBLE[]), 5) AS head, round(list_sum(embedding[49:64]::DOUBLE[]), 5) AS tail FROM embeddings")
def _(s, d):
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), 5)
    return table(s, d, "embeddings").select("vec_id", total(F.slice("embedding", 1, 16)).alias("head"), total(F.slice("embedding", 49, 16)).alias("tail"))


@query("latest_per_subject", RECORDS + "SELECT subject_id, max(slot_id) AS slot_id, arg_max(opcode, slot_id) AS opcode FROM records GROUP BY subject_id")
def _(s, d):
    return R.latest_per_key(records(s, d).select("subject_id", "slot_id", "opcode"), "subject_id", "slot_id")


@query("fingerprint_fold", """WITH b AS (SELECT item_id, encode(text) AS t, octet_length(encode(text)) AS n FROM benchmark),
f AS (SELECT item_id, bucket, list_sum(list_transform(CASE WHEN bucket < n THEN range(bucket, n, 48) ELSE [] END, lambda i: ('0x' || substr(hex(t), 2 * i + 1, 2))::BIGINT))::BIGINT AS s FROM b, range(48) r(bucket))
SELECT item_id, list(((coalesce(s, 0) + 128) % 256 - 128)::BIGINT ORDER BY bucket) AS folded FROM f GROUP BY item_id""")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", V.fold48(F.encode("text", "UTF-8")).alias("folded"))


@query("nibble_products", """WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
n AS (SELECT item_id, list_transform(range(0, length(h) // 2), lambda i: [instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1, instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1]) AS p FROM b)
SELECT item_id, (0.5 * list_sum(list_transform(flatten(p), lambda d: (d + 8) % 16 - 8)))::DOUBLE AS y FROM n""")
def _(s, d):
    q = V.nibbles(F.encode("text", "UTF-8"))
    return table(s, d, "benchmark").select("item_id", (F.aggregate(q, F.lit(0), lambda t, x: t + x) * 0.5).alias("y"))
