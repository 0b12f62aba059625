"""Every registered query of the record library against DuckDB, and rows-only ones against plain Python."""

import os
from datetime import datetime
from glob import glob

import duckdb
import pytest

from trove.plans import catalog
from trove.plans.tables import table
from trove.streaming.flows import lease_decisions

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for path in glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    want = con.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in want.columns) for r in df.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_tokens_cover_the_text(spark):
    from trove.operators.texts import tokenise

    df = spark.createDataFrame([(1, 'let x_1 = "a\\"b // no" + 2.5; // yes\n'), (2, ""), (3, None)], "id long, text string")
    rows = sorted((r.place, r.kind, r.lexeme) for r in tokenise(df, "id", "text").collect())
    assert "".join(r[2] for r in rows) == df.first().text
    kinds = [r[1] for r in rows if r[1] != "space"]
    assert kinds == ["identifier", "identifier", "punctuation", "string", "punctuation", "number", "punctuation", "comment"]


def test_every_page_is_tokenised(spark):
    from trove.operators.texts import _TOKEN

    want = {}
    for page in table(spark, DIR, "pages").select("html").collect():
        for m in _TOKEN.finditer(page.html or ""):
            n, chars = want.get(m.lastgroup, (0, 0))
            want[m.lastgroup] = n + 1, chars + len(m.group())
    assert {r.kind: (r.n, r.chars) for r in catalog.queries()["tokenise"](spark, DIR).collect()} == want


def test_token_headers_count_the_tokens(spark):
    from trove.operators.texts import KINDS

    tokens = {KINDS.index(r.kind) + 1: r.n for r in catalog.queries()["tokenise"](spark, DIR).collect() if r.kind != "space"}
    found = catalog.queries()["token_headers"](spark, DIR).collect()
    assert {r.opcode: r.n for r in found} == tokens and {r.predicate for r in found} == {"lex_token"} and max(r.longest for r in found) <= 16


def plain_soundex(word):
    codes = {c: d for d, letters in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in letters}
    w = word.upper()
    out, last = w[0], codes.get(w[0], "")
    for c in w[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


def test_phonetic_search_matches_a_plain_one(spark):
    from trove.operators.texts import soundex_precision

    names = [("a", "Robert"), ("a", "Rupert"), ("a", "robert"), ("a", "Rubin"), ("b", "Ashcraft"), ("b", "Tymczak"), ("b", "Rabert")]
    got = {r.grp: (r.hits, r.exact, r.precision) for r in soundex_precision(spark.createDataFrame(names, "g string, n string"), "g", "n", "Robert").collect()}
    want = {}
    for g in ("a", "b"):
        hits = [n for k, n in names if k == g and plain_soundex(n) == plain_soundex("Robert")]
        exact = sum(n.lower() == "robert" for n in hits)
        want[g] = len(hits), exact, round(exact / len(hits), 6)
    assert got == want


def test_approximate_users_are_near_the_exact_ones(spark):
    rows = table(spark, DIR, "events").toPandas()
    for r in catalog.queries()["approx_users"](spark, DIR).collect():
        part = rows[rows.event_type == r.event_type]
        assert abs(r.users - part.user_id.nunique()) <= 0.1 * part.user_id.nunique() + 1
        assert part.value.quantile(0.45) <= r.middle <= part.value.quantile(0.55)


def test_a_corrupt_row_stops_a_strict_read(spark):
    from pyspark.sql import functions as F

    from trove.operators import recovery

    rows = recovery.stored(spark.range(5).withColumn("segment", F.lit(0)), F.concat(F.lit("row "), F.col("id").cast("string")))
    hit = recovery.with_fault(rows, F.when(F.col("id") == 3, "append").otherwise("none"))
    assert recovery.read_mode(rows, "failfast").count() == 5 and recovery.read_mode(hit, "dropcorrupt").count() == 4
    with pytest.raises(Exception, match="fails its digest"):
        recovery.read_mode(hit, "failfast").collect()
    with pytest.raises(ValueError):
        recovery.read_mode(hit, "ignore")


def test_vectors_of_another_dimension_are_refused(spark):
    from trove.functions.vectors import of_dimension

    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(of_dimension(df.v, 2)).count() == 1
    with pytest.raises(Exception, match="expected 3 numbers"):
        df.select(of_dimension(df.v, 3)).collect()


def test_a_spoke_is_read_from_its_folder_alone(spark):
    plan = catalog.queries()["spoke_sweep"](spark, DIR)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(spoke" in plan


def test_leases_match_a_replay(spark):
    got = sorted((r.path, r.at, r.holder, r.verdict) for r in catalog.queries()["stream_leases"](spark, DIR).collect())
    rows = table(spark, DIR, "events").toPandas()
    rows["path"] = "f" + (rows.user_id % 20).astype(str)
    rows["at"], rows["holder"], rows["expires"] = rows.event_id, rows.event_type, rows.event_id + 100
    want = [x for path, part in rows.groupby("path") for x in lease_decisions(path, part, None)[0]]
    assert got == sorted(want)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
