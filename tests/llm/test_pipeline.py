"""The pipeline, stage by stage against plain versions, and the registered queries with SQL."""

import duckdb
import pytest

import corpus_pipeline
from trove.llm import catalog
from trove.llm.language_id import UNDETERMINED
from trove.llm.order_minhash import near_duplicates
from trove.plans.tables import table

from .test_corpus_operators import between, brute_classes, check_pieces, encoded
from .test_text_operators import base_stats

DIR = "/root/testdata/sf0.001"


def test_stages_decide_and_keep_the_columns(spark):
    docs = table(spark, DIR, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = corpus_pipeline.language(spark, docs, DIR).cache()
    assert first.columns == corpus_pipeline.COLUMNS
    dropped = set(texts) - {r.doc_id for r in first.select("doc_id").collect()}
    predicted = {r.doc_id: r for r in catalog.op3_language_id(spark, DIR).collect()}
    assert dropped == {i for i, r in predicted.items() if r.lang_pred == UNDETERMINED or r.score < corpus_pipeline.LEAST_SCORE}

    second = corpus_pipeline.quality(spark, first, DIR).cache()
    assert second.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in second.collect()}
    for i in {r.doc_id for r in first.collect()}:
        words, _, symbols, _, repeated = base_stats(texts[i])
        failed = words < 50 or 100 * repeated > 50 * words
        assert i not in kept if failed or symbols > words / 2 else i in kept or symbols

    third = corpus_pipeline.near_dedup(spark, second, DIR).cache()
    left = sorted(r.doc_id for r in third.collect())
    most, least = brute_classes({i: texts[i] for i in kept})
    got = {r.doc_id: r.class_id for r in near_duplicates(second).collect()}
    assert between(got, most, least) and left == sorted(set(got.values()))

    pieces = corpus_pipeline.packing(spark, third, DIR).collect()
    assert check_pieces(pieces, encoded({i: texts[i] for i in left})) < 0.05
    assert corpus_pipeline.run(spark, DIR).count() == len(pieces)


def test_stages_bear_odd_rows(spark, odd_docs, no_docs):
    odd = odd_docs.select(*corpus_pipeline.COLUMNS)
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    # null, empty, blank and letterless texts go, and every row of a learned language stays
    assert {"1", "2", "6", "7"}.isdisjoint(got := ids(corpus_pipeline.language(spark, odd, DIR))) and got.count("4") == 2
    assert ids(corpus_pipeline.quality(spark, odd, DIR)) == ["3"]  # all others have under fifty words
    once = ids(corpus_pipeline.near_dedup(spark, odd, DIR))
    assert once == sorted(["1", "2", "3", "4", "7", "8", "None"])
    pieces = corpus_pipeline.packing(spark, odd, DIR).collect()
    assert sorted(str(p.doc_id) for p in pieces if p.start == 0) == ids(odd)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs.select(*corpus_pipeline.COLUMNS), DIR).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(map(str, (tuple(r[c] for c in want.columns) for r in df.collect())))
    assert got == sorted(map(str, want.fetchall()))
