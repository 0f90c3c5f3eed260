"""The stages of the pipeline against plain versions of themselves, and the registered queries against their SQL."""

import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_ops import brute_components, brute_dedup, docs_of, near_texts

import corpus_pipeline as P
from lodestone.llm import mixing, quality, queries
from lodestone.llm.shared import written

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = P.keep_quality(spark, docs, DIR)
    scores = quality.quality_scores(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    assert kept.columns == docs.columns
    mixed = P.mix_sources(spark, kept, DIR)
    want = {r["doc_id"]: r["copies"] for r in mixing.systematic_mix(kept).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


def test_copies_and_near_copies(spark):
    texts = near_texts(12, 120)
    docs = docs_of(spark, texts)
    got = {r["doc_id"] for r in P.drop_copies(spark, docs, DIR).collect()}
    assert got == {i for i, w in brute_dedup(enumerate(texts)).items() if w[2]}
    got = {r["doc_id"] for r in P.drop_near_copies(spark, docs, DIR).collect()}
    assert got == {i for i, (_, c) in brute_components(texts, 5, 80).items() if c == i}


def test_near_copies_with_null_and_shared_ids(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    near = lambda t: f"{t} end"
    # two texts and a near copy under null; two texts under 5, one of them near to that of 3; a repeated row; texts without shingles
    rows = [(None, a), (None, b), (None, near(a)), (5, c), (5, near(d)), (3, d), (7, "once more"), (7, "once more"), (8, "one"), (None, ""), (None, None), (8, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, DIR).collect()]
    firsts = [x for x in got if x[1] in (a, near(a))]
    assert len(firsts) == 1 and firsts[0][0] is None
    want = [(None, b), (5, c), (3, d), (7, "once more"), (8, "one"), (None, ""), (None, None), (8, " ")]
    assert sorted(map(repr, got)) == sorted(map(repr, [*firsts, *want]))


@pytest.mark.parametrize("empty", [False, True])
def test_edges_of_each_stage(spark, tmp_path, empty):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1, words, "en", "a", 9), (1, words, "en", "a", 9), (2, words + " more", None, "a", None), (3, "x " * 400_000, "en", "b", 1), (None, words, "en", "b", 1)]
    docs = spark.createDataFrame([] if empty else rows, kind).withColumn("size", F.lit(1)).withColumn("__id", F.lit("clash"))
    spark.createDataFrame([(1, 1, 0)] if not empty else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(P.STAGES) - 1 or out.columns == P.COLUMNS
        docs = written(out, "edges")
        counts.append(docs.count())
    # all have label 1; of the equal texts, and then of the near ones, doc 1 stays; what has no words isn't taken
    assert counts == [0] * 5 if empty else counts[:3] == [7, 4, 3] and counts[3] == counts[4] > 0
    if not empty:
        assert {r["doc_id"] for r in docs.collect()} <= {1, 3}


def test_run(spark):
    out = P.run(spark, DIR)
    rows = out.collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    a, b = queries.queries()[name](spark, DIR).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(b.columns)

    def plain(value):
        if pd.isna(value):
            return "null"
        return f"{float(value):.6f}" if isinstance(value, numbers.Number) and not isinstance(value, bool) else str(value)

    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[cols].astype(object).itertuples(index=False))
    assert sorted(a.columns) == cols and rows(a) == rows(b)
