"""Queries of the SQL surface: bound statements, table functions, user functions, recovery and notes as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.functions import vectors as V
from trove.operators import ranking as R
from trove.operators import record_ops as O
from trove.operators import recovery as W
from trove.operators import slots as S
from trove.operators import texts as T
from trove.plans.model import candidates, records, spoked
from trove.plans.record_queries import CAND, COLUMNS, LIST, RECORDS, SYNTH, recall_query
from trove.plans.registry import query
from trove.plans.scratch import materialise, scratch_path
from trove.plans.tables import table

# ---- statements with bound values


@query("bound_select", RECORDS + f"SELECT {LIST} FROM records WHERE subject_id = 42 AND epoch >= 5 AND predicate_id = 'click'")
def _(s, d):
    rows = records(s, d).select(*COLUMNS)
    return s.sql("SELECT * FROM {rows} WHERE subject_id = :subject AND epoch >= :epoch AND predicate_id = :kind", args={"subject": 42, "epoch": 5, "kind": "click"}, rows=rows)


@query("bound_insert", RECORDS + "SELECT slot_id, opcode, subject_id, target_id, flags, epoch FROM records UNION ALL SELECT 90000001, 1, 77, 5, 0, 1")
def _(s, d):
    rows = records(s, d).select("slot_id", "opcode", "subject_id", "target_id", "flags", "epoch")
    text = "SELECT * FROM {rows} UNION ALL SELECT CAST(? AS BIGINT), CAST(1 AS BIGINT), CAST(? AS BIGINT), CAST(? AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT)"
    return s.sql(text, args=[90_000_001, 77, 5], rows=rows)


# ---- table functions and user functions


@query("recall_function", CAND + "SELECT row_number() OVER (ORDER BY b.score DESC, key)::BIGINT AS rank, round(100 * b.score, 4) AS score100, 'user_' || key AS name FROM (SELECT key, score FROM scored WHERE hop <= 4 ORDER BY scored.score DESC, key LIMIT 10) b WHERE true QUALIFY rank <= 5")
def _(s, d):
    """A SQL table function over the ranked candidates: at most ten rows, whatever is asked for."""
    R.scored(candidates(s, d), recall_query(s, d)).where("hop_ok").select("key", "score").createOrReplaceTempView("trove_recall_candidates")
    s.sql("""CREATE OR REPLACE TEMPORARY FUNCTION trove_recall(k INT) RETURNS TABLE (rank BIGINT, score100 DOUBLE, name STRING)
      RETURN SELECT rank, score100, name FROM (
        SELECT CAST(row_number() OVER (ORDER BY score DESC, key) AS BIGINT) AS rank, round(100 * score, 4) AS score100, concat('user_', key) AS name
        FROM (SELECT key, score FROM trove_recall_candidates ORDER BY score DESC, key LIMIT 10)) WHERE rank <= trove_recall.k""")
    return s.sql("SELECT * FROM trove_recall(5)")


class Steps:
    """A table function: the numbers from 1 to n, with what is left of n."""

    def eval(self, n: int):
        for k in range(1, (n or 0) + 1):
            yield k, n - k


@query("table_function", "SELECT o_orderkey, r.k::BIGINT AS step, (o_orderkey % 4 - r.k)::BIGINT AS rest FROM orders, range(1, 4) r(k) WHERE r.k <= o_orderkey % 4")
def _(s, d):
    s.udtf.register("trove_steps", F.udtf(Steps, returnType="step: bigint, rest: bigint"))
    return s.sql("SELECT o_orderkey, step, rest FROM {orders}, LATERAL trove_steps(CAST(o_orderkey % 4 AS INT))", orders=table(s, d, "orders"))


@query("scalar_function", "SELECT p_partkey, round(p_retailprice * (1 + p_size / 100.0), 4) AS price FROM part")
def _(s, d):
    @F.pandas_udf("double")
    def priced(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * (1 + size / 100.0)

    return table(s, d, "part").select("p_partkey", F.round(priced("p_retailprice", "p_size"), 4).alias("price"))


@query("aggregate_function", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY c_nationkey")
def _(s, d):
    @F.pandas_udf("double")
    def spread(values: pd.Series) -> float:
        return values.max() - values.min()

    return table(s, d, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 4).alias("spread"))


@query("math_functions", "SELECT p_partkey, round(sqrt(p_size), 6) AS root, round(ln(p_retailprice), 6) AS log, power(p_size, 2)::DOUBLE AS square, p_partkey % 7 AS rest, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down, sign(p_size - 25)::INT AS side, abs(p_size - 25)::INT AS apart FROM part")
def _(s, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(s, d, "part").select(
        "p_partkey", F.round(F.sqrt(size), 6).alias("root"), F.round(F.ln(price), 6).alias("log"), F.pow(size, 2).alias("square"), (F.col("p_partkey") % 7).alias("rest"),
        F.ceil(price).alias("up"), F.floor(price).alias("down"), F.signum(size - 25).cast("int").alias("side"), F.abs(size - 25).alias("apart"),
    )


# ---- batches of lookups over the million benchmark records

ASKED = SYNTH + ", asked AS (SELECT range AS q, range * 7 % 100 AS s, range * 31 % 1000 AS e FROM range(5000)) "


def _asked(s) -> DataFrame:
    """5,000 subjects: of query q spoke 7q mod 100 and entity 31q mod 1000."""
    return s.range(5000).select(F.col("id").alias("q"), F.format_string("s_%04d_%06d", F.col("id") * 7 % 100, F.col("id") * 31 % 1000).alias("subject_id"))


@query("batch_lookup_million", ASKED + "SELECT q, count(*) AS n, min(id) AS first_id, sum(opcode)::BIGINT AS opcodes FROM asked JOIN (SELECT *, 4096 + epoch AS opcode FROM synth) ON spoke = s AND entity = e GROUP BY q")
def _(s, d):
    found = O.synthetic(s).select("id", "opcode", "subject_id").join(F.broadcast(_asked(s)), "subject_id")
    return found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("opcode").alias("opcodes"))


@query("batch_multi_million", ASKED + "SELECT q, count(*) AS n, min(id) AS first_id FROM asked JOIN synth ON spoke = s AND entity = e WHERE epoch >= 5 AND epoch % 2 = 1 GROUP BY q")
def _(s, d):
    rows = O.synthetic(s).where((F.col("epoch") >= 5) & (F.col("flags").bitwiseAND(1) != 0)).select("id", "subject_id")
    return rows.join(F.broadcast(_asked(s)), "subject_id").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("spoke_sweep", RECORDS + "SELECT opcode, count(*) AS n, min(slot_id) AS first_slot FROM records WHERE subject_id % 10 = 3 AND status = 'committed' GROUP BY opcode")
def _(s, d):
    """One spoke of records written by spoke: the scan reads that folder alone."""
    path = scratch_path(s, "spokes")
    spoked(records(s, d)).select("slot_id", "opcode", "status", "spoke").repartition("spoke").write.partitionBy("spoke").parquet(path)
    swept = s.read.parquet(path).where("spoke = 3 AND status = 'committed'")
    return swept.groupBy("opcode").agg(F.count(F.lit(1)).alias("n"), F.min("slot_id").alias("first_slot"))


# ---- vectors


@query("fixed_dimension", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS dot FROM embeddings")
def _(s, d):
    e = V.of_dimension(F.col("embedding"), 64)
    return table(s, d, "embeddings").select("vec_id", F.round(V.dot(e, e), 5).alias("dot"))


@query("nibble_matrix", """WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
n AS (SELECT item_id, flatten(list_transform(range(0, length(h) // 2), lambda i: [instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1, instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1])) AS p FROM b)
SELECT item_id, (0.25 * list_sum(list_transform(range(0, len(p)), lambda i: (i % 7 - 3) * ((p[i + 1] + 8) % 16 - 8))))::DOUBLE AS y FROM n""")
def _(s, d):
    """Product of a matrix of signed nibbles (a row of bytes an item) with a vector, times a scale."""
    rows = table(s, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("tile"))
    return rows.select("item_id", V.nibble_product(F.col("tile"), lambda i: i % 7 - 3, 0.25).alias("y"))


# ---- rings, double buffers and progress


@query("ring_push", "SELECT CASE WHEN event_id >= event_id // 3000 * 3000 + 1024 THEN 'full' ELSE 'accepted' END AS outcome, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def _(s, d):
    """Writes against a reader that catches up every 3,000 places: a full ring refuses instead of overwriting."""
    at = F.col("event_id")
    rows = table(s, d, "events").select(at, S.push_outcome(at, F.floor(at / 3000) * 3000, 1024).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("buffer_swap", "SELECT 'before' AS reader, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'after', count(*) FROM orders")
def _(s, d):
    """Two versions of a table behind one name: a reader that began before the swap keeps its version."""
    orders = table(s, d, "orders")
    materialise(orders.where("o_orderstatus = 'F'"), "front").createOrReplaceTempView("trove_buffer")
    before = s.table("trove_buffer")
    materialise(orders, "back").createOrReplaceTempView("trove_buffer")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reader"), "n")
    return count(before, "before").union(count(s.table("trove_buffer"), "after"))


@query("progress_log", "SELECT event_type AS phase, count(*) AS n, max(event_id) AS last_task FROM events GROUP BY 1")
def _(s, d):
    """Progress events appended as JSON lines and read back with their schema."""
    from trove.streaming.flows import write_progress

    path = scratch_path(s, "progress")
    write_progress(table(s, d, "events").select(F.col("event_type").alias("phase"), F.col("event_id").alias("task"), F.lit('quote " and \\ kept').alias("status")), path)
    back = s.read.schema("phase string, task long, status string").json(path).where(F.col("status") == 'quote " and \\ kept')
    return back.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.max("task").alias("last_task"))


# ---- stored rows, faults and recovery

BAD = "event_id % 16 = 7"


def _events(s, d) -> DataFrame:
    rows = table(s, d, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("segment"), (F.col("event_id") % 1000).alias("slot"), "user_id", "event_type")
    return W.stored(rows, F.concat_ws("|", "event_type", "user_id", "event_id"))


@query("fault_verdicts", "SELECT ['flip_first','flip_last','cut_tail','cut_all','append','zero','swap_digest','none'][(event_id * 31 + 20) % 8 + 1] AS kind, count(*) AS n, count(*) FILTER ((event_id * 31 + 20) % 8 <> 7) AS found FROM events GROUP BY 1")
def _(s, d):
    kind = W.fault_of(F.col("event_id"), 20)
    hit = W.with_fault(_events(s, d).withColumn("kind", kind), F.col("kind"))
    return hit.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~W.sound()).alias("found"))


@query("read_modes", "SELECT 'permissive' AS mode, count(*) AS n, count(*) FILTER (event_id % 16 = 7) AS corrupt FROM events UNION ALL SELECT 'dropcorrupt', count(*) FILTER (event_id % 16 <> 7), 0 FROM events")
def _(s, d):
    hit = W.with_fault(_events(s, d), F.when(F.expr(BAD), "flip_last").otherwise("none"))
    count = lambda mode: W.read_mode(hit, mode).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.count_if("corrupt").alias("corrupt"))
    return count("permissive").union(count("dropcorrupt"))


def damaged(s, d) -> DataFrame:
    """All events as stored rows, every sixteenth with a flipped bit."""
    return W.with_fault(_events(s, d), F.when(F.expr(BAD), "flip_first").otherwise("none")).select("event_id", "segment", "slot", "payload", "digest")


SEGMENTS = "WITH r AS (SELECT event_id, event_id // 1000 AS segment, event_id % 1000 AS slot, event_id % 16 = 7 AS bad FROM events), t AS (SELECT segment, min(slot) FILTER (bad AND slot >= 400) AS torn FROM r GROUP BY segment), k AS (SELECT r.*, CASE WHEN NOT bad THEN 'healthy' WHEN slot < 400 THEN 'corrupt' ELSE 'torn' END AS health FROM r JOIN t USING (segment) WHERE torn IS NULL OR slot <= torn) "


@query("recover_segments", SEGMENTS + "SELECT segment, health, count(*) AS n, max(event_id) AS last_event FROM k GROUP BY 1, 2")
def _(s, d):
    """All events as stored rows of many segments, written, damaged, read back and recovered by position."""
    back = W.recover(materialise(damaged(s, d), "segments"), "segment", "slot", 400)
    return back.groupBy("segment", "health").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query("repaired_copy", SEGMENTS + "SELECT segment, count(*) FILTER (health = 'healthy') AS rows_kept, count(*) FILTER (health = 'corrupt') AS tombstones FROM k GROUP BY segment")
def _(s, d):
    """Opening a damaged table: the input stays, a repaired copy has tombstones for bad rows and no torn tail."""
    hit = W.with_fault(_events(s, d), F.when(F.expr(BAD), "cut_tail").otherwise("none"))
    found = W.recover(hit, "segment", "slot", 400).where("health <> 'torn'")
    copy = found.select("segment", "slot", F.when(F.col("health") == "healthy", F.col("payload")).alias("payload"), (F.col("health") == "corrupt").alias("tombstone"))
    return materialise(copy, "repaired").groupBy("segment").agg(F.count_if(~F.col("tombstone")).alias("rows_kept"), F.count_if("tombstone").alias("tombstones"))


# ---- notes and lines


@query("note_cells", "WITH n AS (SELECT doc_id, 'note ' || doc_id || ' ' || coalesce(source, '') AS title, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL) SELECT doc_id, title, bytes AS body_bytes, least(bytes, 952 - octet_length(encode(title)))::BIGINT AS stored, bytes > 952 - octet_length(encode(title)) AS truncated FROM n WHERE octet_length(encode(title)) <= 952")
def _(s, d):
    title = F.concat(F.lit("note "), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit("")))
    cells = T.note_cell(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", title.alias("title"), F.col("text").alias("body")))
    return cells.select("doc_id", "title", "body_bytes", F.octet_length("body").cast("long").alias("stored"), "truncated")


@query("note_ids", "SELECT doc_id, md5('doc:' || doc_id) AS id128 FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.id128(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("id128"))


@query("hex_export", "SELECT item_id, rpad(lower(substr(hex(encode(text)), 1, 128)), 128, '0') AS payload_hex FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", T.hex_payload(F.encode("text", "UTF-8"), 64).alias("payload_hex"))


@query("line_counts", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(*) AS lines_seen, count(*) FILTER (regexp_matches(line, '[^ \\t\\r\\f\\v]')) AS with_text, count(*) FILTER (regexp_matches(line, '[0-9]')) AS with_number FROM l")
def _(s, d):
    lines = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.agg(F.count(F.lit(1)).alias("lines_seen"), F.count_if(F.col("line").rlike(r"[^ \t\r\f\x0b]")).alias("with_text"), F.count_if(F.col("line").rlike("[0-9]")).alias("with_number"))


@query("token_headers")
def _(s, d):
    tokens = T.tokenise(table(s, d, "pages"), "page_id", "html").where("kind <> 'space'")
    return tokens.select(T.token_header(F.col("kind"), F.col("lexeme")).alias("h")).groupBy("h.opcode", "h.predicate").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("h.subject")).alias("longest"))
