"""Plain SQL breadth over the tables: joins, grouping, windows, sets, time and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trove.operators import relational as X
from trove.plans.registry import query
from trove.plans.tables import table


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose Spark SQL text runs over temporary views of the tables it names."""

    def run(s, d, text=text):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages"):
            if t in text:
                table(s, d, t).createOrReplaceTempView(t)
        return s.sql(text)

    query(name, oracle or text)(run)


_sql("join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_sql("join_full", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier) a FULL JOIN (SELECT c_nationkey FROM customer) b ON s_nationkey = c_nationkey GROUP BY 1")
_sql("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
_sql("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_sql("pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
_sql("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("cube_customers", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
_sql("grouping_sets", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
_sql("distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
_sql("having_filter", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60")
_sql("window_running", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
_sql("window_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS dense FROM customer", "SELECT c_custkey, (rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC))::INT AS place, (dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC))::INT AS dense FROM customer")
_sql("window_frame", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low FROM events")
_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
_sql("scalar_subquery", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_sql("correlated_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
_sql("common_table", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n = m")
_sql("recursive_hops", "WITH RECURSIVE walk(k, depth) AS (SELECT 1L, 0 UNION ALL SELECT k * 2, depth + 1 FROM walk WHERE depth < 8) SELECT k, depth FROM walk", "WITH RECURSIVE walk(k, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT k * 2, depth + 1 FROM walk WHERE depth < 8) SELECT k, depth FROM walk")
_sql("json_fields", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
_sql("time_buckets", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_sql("case_and_null", "SELECT coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic IS NULL THEN 'unknown' ELSE 'clean' END AS tone, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
_sql("string_functions", "SELECT doc_id, upper(lang) AS lang, substr(text, 1, 5) AS head, length(text) AS n, replace(source, 'src', 's') AS src FROM documents", "SELECT doc_id, upper(lang) AS lang, substr(text, 1, 5) AS head, length(text)::INT AS n, replace(source, 'src', 's') AS src FROM documents")
_sql("turns_per_conversation", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, max(turn) AS last_turn FROM conversations GROUP BY conv_id")


@query("pivot_types", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("click"), F.count_if(F.col("event_type") == "view").alias("view"))


@query("as_of_join", "SELECT v.event_id, p.value AS value FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.event_id >= p.event_id")
def _(s, d):
    e = table(s, d, "events")
    out = X.as_of(e.where("event_type = 'view'").select("event_id", "user_id"), e.where("event_type = 'purchase'").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return out.select("event_id", "value")


@query("range_join", "SELECT event_id, c_custkey FROM events JOIN (SELECT c_custkey, c_custkey * 40 AS low, c_custkey * 40 + 25 AS high FROM customer) c ON event_id >= low AND event_id < high")
def _(s, d):
    spans = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") * 40).alias("low"), (F.col("c_custkey") * 40 + 25).alias("high"))
    return X.range_join(table(s, d, "events").select("event_id"), "event_id", spans, "low", "high", 100).select("event_id", "c_custkey")


@query("sessions", "WITH m AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER w > 200 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session FROM m) SELECT user_id, session, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM n GROUP BY 1, 2")
def _(s, d):
    return X.sessions(table(s, d, "events").select("user_id", "event_id"), "user_id", "event_id", 200)


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders) WHERE place <= 2")
def _(s, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("place", F.row_number().over(order)).where("place <= 2").select("o_custkey", "o_orderkey", "place")


@query("approx_users")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("middle"))
