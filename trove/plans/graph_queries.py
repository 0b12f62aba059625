"""Queries over graphs, texts, gates, chunks and slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from trove.functions.hashing import fnv1a32, token_hash16
from trove.operators import chunks as C
from trove.operators import gates as A
from trove.operators import graph as G
from trove.operators import slots as S
from trove.operators import texts as T
from trove.plans.model import records
from trove.plans.record_queries import RECORDS
from trove.plans.registry import query
from trove.plans.tables import table

EDGES = """edges AS (
  SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst FROM orders UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)
"""


def _reverse(edges):
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query("bfs_hops", "WITH RECURSIVE " + EDGES + ", walk(node, hop) AS (SELECT 'r:1', 0 UNION SELECT src, hop + 1 FROM walk JOIN edges ON dst = node WHERE hop < 4) SELECT min(hop) AS hop, node FROM walk GROUP BY node")
def _(s, d):
    return G.hop_distances(_reverse(G.key_edges(s, d)), s.createDataFrame([("r:1",)], "node string")).select("hop", "node")


@query("bfs_many_roots", "WITH RECURSIVE " + EDGES + ", walk(root, node, hop) AS (SELECT 'o:' || o_orderkey, 'o:' || o_orderkey, 0 FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT root, dst, hop + 1 FROM walk JOIN edges ON src = node WHERE hop < 4) SELECT root, node, min(hop) AS hop FROM walk GROUP BY root, node")
def _(s, d):
    roots = table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node"))
    return G.hop_distances(G.key_edges(s, d), roots)


@query("graph_levels", "WITH RECURSIVE " + EDGES + ", walk(node, hop) AS (SELECT 'n:3', 0 UNION SELECT src, hop + 1 FROM walk JOIN edges ON dst = node WHERE hop < 4), deg AS (SELECT dst, count(*) AS degree FROM edges GROUP BY dst) SELECT w.hop, w.node AS name, coalesce(degree, 0) AS degree FROM (SELECT node, min(hop) AS hop FROM walk GROUP BY node) w LEFT JOIN deg ON dst = node")
def _(s, d):
    return G.graph_levels(_reverse(G.key_edges(s, d)), "n:3", depth=8)


@query("out_edges", "WITH " + EDGES + "SELECT src, dst FROM edges WHERE src = 'c:7'")
def _(s, d):
    return G.edges_from(G.key_edges(s, d), "c:7")


@query("in_edges", "WITH " + EDGES + "SELECT src, dst FROM edges WHERE dst = 'n:7'")
def _(s, d):
    return G.edges_to(G.key_edges(s, d), "n:7")


@query("degrees", "WITH " + EDGES + "SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node")
def _(s, d):
    return G.degrees(G.key_edges(s, d))


@query("hyperlinks", "SELECT page_id, (i - 1)::BIGINT AS place, l[i] AS target FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1) AS l FROM pages), range(1, 1000) r(i) WHERE i <= len(l)")
def _(s, d):
    out = table(s, d, "pages").select("page_id", F.posexplode(G.hyperlinks(F.col("html"))).alias("place", "target"))
    return out.withColumn("place", F.col("place").cast("long"))


def _notes(s, d):
    docs = table(s, d, "documents")
    text = F.concat(F.lit("---\nid: note-"), F.col("doc_id").cast("string"), F.lit("\ntitle: \"A "), F.col("source"), F.lit("\"\ntags: ["), F.col("lang"), F.lit(", '"), F.col("source"), F.lit("', , x]\nscore: "), F.col("n_chars").cast("string"), F.lit("\n---\nSee [["), F.col("source"), F.lit("]] and [["), F.col("lang"), F.lit("| alias ]] but not [[ ]].\n"), F.col("text"))
    return G.parse_notes(docs.select("doc_id", F.col("doc_id").cast("string").alias("stem"), text.alias("source_text")))


@query("note_parse", "SELECT doc_id, 'note-' || doc_id AS id, 'A ' || source AS title, [lang, source, 'x'] AS tags, n_chars::DOUBLE AS score, 'See [[' || source || ']] and [[' || lang || '| alias ]] but not [[ ]].' || chr(10) || text AS body FROM documents")
def _(s, d):
    return _notes(s, d).select("doc_id", "id", "title", "tags", "score", "body")


@query("note_edges", "SELECT 'note-' || doc_id AS src, source AS dst, NULL::VARCHAR AS alias, 0 AS place FROM documents UNION ALL SELECT 'note-' || doc_id, lang, 'alias', 1 FROM documents")
def _(s, d):
    return G.note_edges(_notes(s, d))


# ---- gates

GATED = RECORDS + ", g AS (SELECT slot_id, 'user_' || subject_id AS subject, predicate_id AS predicate, target_id::VARCHAR AS target, opcode, slot_id % 16 AS flags, epoch FROM records), coded AS (SELECT *, (CASE WHEN subject IN ('user_3', 'user_5', 'user_8', 'user_13', 'user_21', 'user_34') THEN 1 WHEN flags & 8 <> 0 OR opcode = 2097152 OR contains(predicate, 'gnu') OR contains(target, '77') THEN 4 WHEN flags & 1 = 0 THEN 2 WHEN flags & 2 <> 0 THEN 3 WHEN epoch < 10 THEN 5 ELSE 0 END)::BIGINT AS gate_code FROM g) "
DENIED, TOKENS = ["user_3", "user_5", "user_8", "user_13", "user_21", "user_34"], ["gnu", "77"]


def _gated(s, d):
    r = records(s, d)
    g = r.select("slot_id", F.concat(F.lit("user_"), F.col("subject_id").cast("string")).alias("subject"), F.col("predicate_id").alias("predicate"), F.col("target_id").cast("string").alias("target"), "opcode", (F.col("slot_id") % 16).alias("flags"), "epoch")
    return g.withColumn("gate_code", A.gate_code(*[F.col(c) for c in ("subject", "predicate", "target", "opcode", "flags", "epoch")], DENIED, TOKENS, 10))


@query("gate_codes", GATED + "SELECT slot_id, gate_code FROM coded")
def _(s, d):
    return _gated(s, d).select("slot_id", "gate_code")


@query("gate_audit", GATED + "SELECT gate_code, count(*) AS n FROM coded GROUP BY 1")
def _(s, d):
    return _gated(s, d).groupBy("gate_code").agg(F.count(F.lit(1)).alias("n"))


@query("gated_lanes", GATED + "SELECT slot_id % 4 AS lane, count(*) FILTER (gate_code = 0) AS admitted, count(*) FILTER (gate_code <> 0) AS refused FROM coded GROUP BY 1")
def _(s, d):
    return _gated(s, d).groupBy((F.col("slot_id") % 4).alias("lane")).agg(F.count_if(F.col("gate_code") == 0).alias("admitted"), F.count_if(F.col("gate_code") != 0).alias("refused"))


@query("epoch_fence", RECORDS + "SELECT subject_id, count(*) FILTER (epoch < top) AS stale, max(top) AS current FROM (SELECT subject_id, epoch, max(epoch) OVER (PARTITION BY subject_id) AS top FROM records) GROUP BY subject_id")
def _(s, d):
    r = records(s, d)
    top = r.groupBy("subject_id").agg(F.max("epoch").alias("top"))
    return r.join(top, "subject_id").groupBy("subject_id").agg(F.count_if(F.col("epoch") < F.col("top")).alias("stale"), F.max("top").alias("current"))


@query("load_cascade", """WITH x AS (SELECT event_id, event_id * 7 % 101 AS a, event_id % 5 = 0 AS l, event_id * 13 % 101 AS b, event_id % 6 AS p, event_id * 37 % 20000 AS z FROM events),
y AS (SELECT *, CASE WHEN p > 3 THEN 0 ELSE p END AS q FROM x)
SELECT event_id, (CASE WHEN q = 3 THEN 2 WHEN l THEN CASE WHEN q = 2 THEN 1 ELSE 0 END WHEN q = 0 THEN 0 WHEN q = 1 THEN CASE WHEN a > 80 OR b > 85 THEN 0 ELSE 1 END WHEN z > 8192 AND a < 90 THEN 2 ELSE 1 END)::BIGINT AS target FROM y""")
def _(s, d):
    e = F.col("event_id")
    return table(s, d, "events").select("event_id", A.load_target(e * 7 % 101, e % 5 == 0, e * 13 % 101, e % 6, e * 37 % 20000).alias("target"))


@query("liveness", "SELECT CASE WHEN event_id % 3 = 0 THEN 'dead' WHEN event_id % 5 <> 0 THEN 'active' WHEN event_id % 7 <> 0 THEN 'idle' ELSE 'hung' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    e = F.col("event_id")
    return table(s, d, "events").groupBy(A.liveness(e % 3 != 0, e % 5 == 0, e % 7 == 0).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("provenance_bits", "SELECT event_id, (event_id % 4) | ((event_id % 3) << 8) | ((event_id % 5) << 12) | ((user_id % 65536) << 16) | ((event_id % 65536) << 32) AS packed, event_id % 3 AS outcome, event_id % 65536 AS session FROM events")
def _(s, d):
    e = F.col("event_id")
    out = table(s, d, "events").select("event_id", A.pack_bits(source=e % 4, outcome=e % 3, hop=e % 5, embedder=F.col("user_id"), session=e).alias("packed"))
    return out.select("event_id", "packed", A.unpack_bits(F.col("packed"), "outcome").alias("outcome"), A.unpack_bits(F.col("packed"), "session").alias("session"))


FNV = "list_reduce(list_prepend(2166136261::UHUGEINT, list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::UHUGEINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"


@query("fnv_hash", "SELECT DISTINCT source, " + FNV.format("source") + "::BIGINT AS h FROM documents")
def _(s, d):
    return table(s, d, "documents").select("source").distinct().select("source", fnv1a32(F.col("source")).alias("h"))


@query("token_hash16", "SELECT lang, (xor(h, h >> 16) & 65535)::BIGINT AS h16 FROM (SELECT lang, " + FNV.format("lang") + "::BIGINT AS h FROM (SELECT DISTINCT lang FROM documents))")
def _(s, d):
    return table(s, d, "documents").select("lang").distinct().select("lang", token_hash16(F.col("lang")).alias("h16"))


@query("descriptor_errors", "SELECT CASE WHEN octet_length(encode(source)) > 4 THEN 'embedder_too_long' WHEN doc_id % 6 > 4 THEN 'hop' WHEN source <> 'src1' THEN 'embedder' WHEN doc_id % 4 = 0 OR lang = '' THEN 'incomplete' END AS fault, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    fault = A.descriptor_error(F.col("source"), F.col("lang"), F.col("doc_id") % 6, F.col("doc_id") % 4, "src1", most=4)
    return table(s, d, "documents").groupBy(fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("majority_bits", "SELECT user_id, (" + " + ".join(f"CASE WHEN 2 * sum((event_id >> {b}) & 1) > count(*) THEN {1 << b} ELSE 0 END" for b in range(8)) + ")::BIGINT AS folded FROM events GROUP BY user_id")
def _(s, d):
    return A.majority_bits(table(s, d, "events"), "user_id", "event_id", 8)


@query("triple_intake", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'verb' WHEN length('u' || user_id * 100000000000000) > 16 THEN 'length' END AS refusal FROM events")
def _(s, d):
    line = F.concat_ws(" ", F.concat(F.lit("u"), (F.col("user_id") * 100000000000000).cast("string")), F.col("event_type"), F.lit("x"))
    return table(s, d, "events").select("event_id", A.triple_intake(line, ["click", "view"])["refusal"].alias("refusal"))


@query("joint_energy", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN event_id % 6 > 4 THEN 'refused' WHEN value * 20 + user_id + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 100 END >= 500 THEN 'vetoed' ELSE 'accepted' END AS verdict FROM events) GROUP BY 1")
def _(s, d):
    e = F.col("event_id")
    v = A.joint_energy(F.col("value") * 20, F.col("user_id").cast("double"), F.lit(100.0), F.when(e % 3 == 0, 0.0).otherwise(1.0), e % 6)
    return table(s, d, "events").groupBy(v["verdict"].alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("device_coordinates", "SELECT event_id, x / 640.0::DOUBLE AS nx, 1.0::DOUBLE - y / 480.0::DOUBLE * 2.0::DOUBLE AS dy, x BETWEEN 100 AND 300 AND y BETWEEN 50 AND 400 AS hit FROM (SELECT event_id, (event_id % 640)::DOUBLE AS x, (event_id * 7 % 480)::DOUBLE AS y FROM events)")
def _(s, d):
    x, y = (F.col("event_id") % 640).cast("double"), (F.col("event_id") * 7 % 480).cast("double")
    p = A.device_coordinates(x, y, F.lit(640.0), F.lit(480.0))
    return table(s, d, "events").select("event_id", p["nx"].alias("nx"), p["dy"].alias("dy"), A.inside(x, y, 100, 50, 300, 400).alias("hit"))


@query("packet_json", "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS packet FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("packet"))


@query("sha256_hex", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# ---- texts

WORDS = "WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM benchmark) "


def _words(s, d, name="benchmark", key="item_id"):
    return table(s, d, name).select(key, F.explode(T.words_of(F.col("text"))).alias("word"))


@query("vocabulary_semi", WORDS + ", t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM documents) SELECT doc_id, count(*) AS n FROM t WHERE word IN (SELECT word FROM w) GROUP BY doc_id")
def _(s, d):
    hits = T.in_vocabulary(_words(s, d, "documents", "doc_id"), _words(s, d))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("vocabulary_index", WORDS + "SELECT word, row_number() OVER (ORDER BY encode(word)) - 1 AS place FROM (SELECT DISTINCT word FROM w)")
def _(s, d):
    return T.vocabulary_index(_words(s, d))


PATTERNS = "WITH p AS (SELECT n_nationkey AS pattern_id, n_regionkey::BIGINT AS subject, ['click','error','purchase','signup','view'][n_nationkey % 5 + 1] AS predicate, 1 + n_nationkey % 3 AS severity FROM nation), f AS (SELECT subject, predicate, min(pattern_id) AS pattern_id, arg_min(severity, pattern_id) AS severity FROM p GROUP BY 1, 2), e AS (SELECT event_id, user_id % 7 AS subject, event_type AS predicate FROM events), m AS (SELECT e.*, pattern_id, severity FROM e LEFT JOIN f USING (subject, predicate)) "


def _matched(s, d):
    types = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    n = table(s, d, "nation")
    p = n.select(F.col("n_nationkey").alias("pattern_id"), F.col("n_regionkey").cast("long").alias("subject"), F.get(types, F.col("n_nationkey") % 5).alias("predicate"), (F.lit(1) + F.col("n_nationkey") % 3).alias("severity"))
    e = table(s, d, "events").select("event_id", (F.col("user_id") % 7).alias("subject"), F.col("event_type").alias("predicate"))
    return T.match_patterns(e, p)


@query("pattern_match", PATTERNS + "SELECT event_id, subject, predicate, pattern_id, severity FROM m")
def _(s, d):
    return _matched(s, d)


@query("incident_severity", PATTERNS + "SELECT pattern_id, count(*) + 1 AS frequency, CASE WHEN count(*) + 1 >= 3 THEN 'systemic' ELSE 'incident' END AS level FROM m WHERE pattern_id IS NOT NULL GROUP BY 1")
def _(s, d):
    return T.escalate(_matched(s, d))


CENSUS = "SELECT c_custkey, c_custkey || '  12  3  ' || c_name || '  ' || c_mktsegment || '  ' || (c_custkey % 90) || '  M  W  clerk  100  200  Ohio' AS line FROM customer"


def _census(s, d):
    k = F.col("c_custkey").cast("string")
    line = F.concat(k, F.lit("  12  3  "), F.col("c_name"), F.lit("  "), F.col("c_mktsegment"), F.lit("  "), (F.col("c_custkey") % 90).cast("string"), F.lit("  M  W  clerk  100  200  Ohio"))
    return table(s, d, "customer").select("c_custkey", line.alias("line"))


@query("fixed_width", "WITH l AS (" + CENSUS + ") SELECT c_custkey, string_split_regex(trim(line), ' {2,}')[1:5] AS fields FROM l")
def _(s, d):
    return _census(s, d).select("c_custkey", T.fixed_width(F.col("line"), 5).alias("fields"))


@query("census_lines", "SELECT c_custkey, substr(c_name, 1, 14) || ' ' || substr(c_mktsegment, 1, 1) AS subject, 'Ohio' AS target, (c_custkey % 90)::VARCHAR AS age FROM customer")
def _(s, d):
    return _census(s, d).select("c_custkey", T.census_line(F.col("line")).alias("c")).select("c_custkey", "c.subject", "c.target", "c.age")


@query("tokenise")
def _(s, d):
    return T.tokenise(table(s, d, "pages"), "page_id", "html").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("lexeme")).alias("chars"))


@query("soundex_precision")
def _(s, d):
    return T.soundex_precision(_words(s, d, "documents", "doc_id").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id"), "lang", "word", "then")


@query("triples", "SELECT event_id, CASE event_type WHEN 'click' THEN 1001 WHEN 'view' THEN 1002 END::BIGINT AS opcode, substr('user-number-' || user_id * 100000, 1, 16) AS subject FROM events")
def _(s, d):
    t = T.triple(F.concat(F.lit("user-number-"), (F.col("user_id") * 100000).cast("string")), F.col("event_type"), F.lit("x"), {"click": 1001, "view": 1002})
    return table(s, d, "events").select("event_id", t.alias("t")).select("event_id", "t.opcode", "t.subject")


# ---- chunks

CHUNKED = "WITH p AS (SELECT doc_id AS key, encode(text) AS data, octet_length(encode(text)) AS total FROM documents), n AS (SELECT *, CASE WHEN total <= 960 THEN 1 ELSE (total + 935) // 936 END::BIGINT AS parts FROM p) "


@query("chunk_split", CHUNKED + "SELECT key, seq, parts, total, CASE WHEN seq + 1 < parts THEN key || ':' || (seq + 1) END AS next_key, least(total - seq * CASE WHEN parts = 1 THEN 960 ELSE 936 END, CASE WHEN parts = 1 THEN 960 ELSE 936 END)::BIGINT AS size FROM n, range(5) r(seq) WHERE parts <= 5 AND seq < parts")
def _(s, d):
    out = C.split_payloads(table(s, d, "documents"), "doc_id", "text")
    return out.select("key", "seq", "parts", "total", "next_key", F.octet_length("part").cast("long").alias("size"))


@query("chunk_refused", CHUNKED + "SELECT key, total, parts FROM n WHERE parts > 5")
def _(s, d):
    return C.refused(table(s, d, "documents"), "doc_id", "text")


@query("chunk_roundtrip", CHUNKED + "SELECT key, sha256(data) AS digest, NULL::VARCHAR AS fault FROM n WHERE parts <= 5")
def _(s, d):
    back = C.join_payloads(C.split_payloads(table(s, d, "documents"), "doc_id", "text"))
    return back.select("key", F.sha2("data", 256).alias("digest"), "fault")


# ---- slots

LOG = "WITH log AS (SELECT event_id // 4 AS slot_id, event_id AS seq, ['claimed','committed','committed','released'][event_id % 4 + 1] AS state, user_id, value FROM events WHERE event_id % 7 <> 3), last AS (SELECT slot_id, arg_max(state, seq) AS state, max(seq) AS seq FROM log GROUP BY slot_id) "


def _log(s, d):
    return S.slot_log(table(s, d, "events"))


@query("slot_latest", LOG + "SELECT slot_id, state, seq FROM last")
def _(s, d):
    return S.latest_state(_log(s, d))


@query("slot_states", LOG + "SELECT k.state, count(slot_id) AS n FROM (VALUES ('claimed'), ('committed'), ('released'), ('unreserved')) k(state) LEFT JOIN last USING (state) GROUP BY 1")
def _(s, d):
    return S.state_counts(_log(s, d), s)


@query("gap_watermark", LOG + "SELECT coalesce(min(r.s), (SELECT max(slot_id) + 1 FROM last))::BIGINT AS watermark FROM range(10000000) r(s) WHERE r.s <= (SELECT max(slot_id) FROM last) AND r.s NOT IN (SELECT slot_id FROM last WHERE state IN ('committed', 'released'))")
def _(s, d):
    return S.gap_watermark(S.latest_state(_log(s, d)))


@query("drain_projection", LOG + "SELECT slot_id, max(seq) AS seq, arg_max(user_id, seq) AS user_id, arg_max(value, seq) AS value FROM log WHERE state = 'committed' GROUP BY slot_id")
def _(s, d):
    return S.project(_log(s, d))


@query("active_leases", "WITH c AS (SELECT 'f' || user_id AS path, event_type AS holder, event_id AS claimed_at, event_id + 300 AS expires FROM events) SELECT path, arg_max(holder, claimed_at) AS holder, max(expires) AS expires FROM c GROUP BY path HAVING max(expires) > 9500")
def _(s, d):
    c = table(s, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("holder"), F.col("event_id").alias("at"), (F.col("event_id") + 300).alias("expires"))
    return S.active_leases(c, 9500)


@query("sequence_gaps", LOG + ", b AS (SELECT *, lag(seq) OVER (PARTITION BY slot_id % 8 ORDER BY seq) AS p FROM log) SELECT slot_id % 8 AS lane, count(*) FILTER (seq - p > 1) AS breaks, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM b GROUP BY 1")
def _(s, d):
    return S.sequence_gaps(_log(s, d).withColumn("lane", F.col("slot_id") % 8), "lane", "seq")


@query("value_percentiles", "SELECT count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events")
def _(s, d):
    return S.index_percentiles(table(s, d, "events"), "value", [("p50", 0.5), ("p99", 0.99)])


@query("ring_read", "SELECT CASE WHEN 500 >= max(event_id) + 1 THEN 'empty' WHEN 500 < max(event_id) + 1 - 1024 THEN 'lagging' ELSE 'ok' END AS outcome, CASE WHEN 500 <= max(event_id) AND 500 >= max(event_id) + 1 - 1024 THEN max(CASE WHEN event_id = 500 THEN value END) END AS value FROM events")
def _(s, d):
    return S.ring_read(table(s, d, "events"), "event_id", 500, 1024)


@query("ring_latest", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def _(s, d):
    return S.ring_latest(table(s, d, "events").select("event_id", "user_id", "event_type"), "event_id")
