"""Answers are compared as a whole, however long they are."""

import difflib

import duckdb
import pytest
from test_catalog import DIR, rows_of

from lodestone.plans import catalog
from lodestone.plans import inputs as I


def test_similarity_of_whole_texts(spark):
    want = {(r["conv_id"], r["turn"]): round(difflib.SequenceMatcher(None, r["expected"].lower(), r["answer"].lower()).ratio(), 4) for r in I.turns(spark, DIR).collect()}
    got = {(r["conv_id"], r["turn"]): r["similarity"] for r in catalog.queries()["sequence_similarity"](spark, DIR).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["score_answers", "eval_summary"])
def test_scores_take_the_whole_evidence(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DIR}/conversations.parquet')")
    assert "[1:200]" not in catalog.oracle_sql()[name]
    assert rows_of(catalog.queries()[name](spark, DIR).toPandas()) == rows_of(con.execute(catalog.oracle_sql()[name]).df())
