import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import display_path, under
from lodestone.operators import audit, grounding, registry
from lodestone.sources import io


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("__x")).select(column).first()[0]


def test_paths(spark):
    p = F.col("p")
    for path, inside, shown in (("/srv/app/a/b.pdf", True, "a/b.pdf"), ("/srv/app", True, "."), ("/srv/apple/b.pdf", False, "/srv/apple/b.pdf"), ("/srv/app\\c", False, "c")):
        assert one(spark, under(p, "/srv/app/"), p=path) is inside
        assert one(spark, display_path(p, "/srv/app"), p=path) == shown


def test_trees_of_lists_objects_and_none(spark):
    t = F.col("t")
    deep = '{"pages": {"1": {}, "2": {}}, "a": [{"label": "Table Item"}, {"b": {"label": "picture", "text": "\\"label\\":\\"table\\""}}], "label" : "TABLE"}'
    assert one(spark, io.tree_pages(t), t=deep) == 2 and one(spark, io.tree_labels(t, ["table", "table_item"]), t=deep) == 2
    assert one(spark, io.tree_labels(t, ["picture"]), t=deep) == 1
    for text in ("{", "", None, "[1]", '{"pages": 3}'):
        assert one(spark, io.tree_pages(t.cast("string")), t=text) == 0 and one(spark, io.tree_labels(t.cast("string"), ["table"]), t=text) == 0


def test_names_find_the_first_document_that_ends_so(spark):
    names = spark.createDataFrame([("a", "x.pdf"), ("b", "no.pdf"), ("c", ""), ("d", None)], "doc_id string, filename string")
    docs = spark.createDataFrame([(2, "h2", "/d/x.pdf"), (1, "h1", "/d/my x.pdf"), (3, "h3", "/d/X.pdf"), (4, "h4", None)], "document_id int, content_hash string, source_path string")
    chunks = spark.createDataFrame([(1, "h1"), (1, "h1"), (1, "old"), (2, "h2")], "document_id int, content_hash string")
    got = [tuple(r) for r in registry.registered(names, docs, chunks).orderBy("doc_id").collect()]
    assert got == [("a", "x.pdf", 1, "h1", 2), ("b", "no.pdf", None, None, 0), ("c", "", None, None, 0), ("d", "", None, None, 0)]
    assert registry.registered(names.limit(0), docs, chunks).count() == 0


def test_prompts_group_by_kind_and_keep_order(spark):
    e = spark.createDataFrame([(1, "T1", 2, 1, "t", "s"), (1, "C2", 1, 2, "b", "s"), (1, "c1", 1, 1, "a", None), (1, "X1", 3, 1, None, "s"), (2, "V1", 3, 1, "v", "s")], "query_id int, citation_id string, part int, ord int, text string, source string")
    got = {r[0]: r[1] for r in grounding.prompts(e).collect()}
    assert got[1] == "Text evidence:\n[c1] Source: \na\n\n[C2] Source: s\nb\n\nTable evidence:\n[T1] Source: s\nt\n\nOther evidence:\n[X1] Source: s\n"
    assert got[2] == "Visual evidence:\n[V1] Source: s\nv"
    assert grounding.prompts(e.limit(0)).count() == 0


def test_a_reasoned_table_stands_alone_where_it_exists(spark):
    schema = "query_id int, rank int, text string, source string"
    texts = spark.createDataFrame([], schema)
    tables = spark.createDataFrame([(1, 1, "a", "s"), (1, 2, "b", "s"), (2, 1, "c", "s")], schema)
    seen = spark.createDataFrame([(1, 1, "V1", "v", "s")], "query_id int, rank int, citation_id string, text string, source string")
    reasoned = spark.createDataFrame([(1, 2, "T2", "more"), (2, 5, "T5", "nothing there")], "query_id int, evidence_index int, citation_id string, reasoning_text string")
    got = [(r.query_id, r.citation_id, r.text) for r in grounding.grounding(texts, tables, seen, reasoned).orderBy("query_id", "part", "ord").collect()]
    assert got == [(1, "T2", "more\n\nSupporting table evidence:\nb"), (1, "V1", "v"), (2, "T1", "c")]
    assert grounding.grounding(texts, tables, seen).count() == 4


def test_observations_leave_out_what_is_empty(spark):
    schema = "supported boolean, observation_type string, question_answered string, confidence string, extracted_facts array<string>, visible_entities array<string>, numeric_values array<string>, limitations array<string>, abstain_reason string, reasoning string"
    rows = spark.createDataFrame([(True, "chart", "yes", "high", ["a", "b"], [], None, ["small"], "", None), (None, None, None, None, None, None, None, None, None, None)], schema)
    got = [r[0] for r in rows.select(grounding.observation_text(F.struct("*"))).collect()]
    assert got == ["Status: supported\nObservation Type: chart\nQuestion Answered: yes\nConfidence: high\nFacts: a; b\nLimitations: small", "Status: not supported\nObservation Type: \nQuestion Answered: \nConfidence: "]


def test_a_model_that_fails_keeps_the_order(spark):
    pairs = spark.createDataFrame([(q, i, i, f"q{q}", "x" * i) for q in (1, 2) for i in (1, 2, 3)], "query_id int, id int, rank int, question string, text string")

    def load():
        def score(found):
            if found[0][0] == "q2":
                raise RuntimeError("no")
            return [len(t) for _, t in found]

        return score

    def gone():
        raise ImportError("no model")

    ids = lambda df: {q: [(r.id, r.rerank_score, r.status) for r in df.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert ids(grounding.optionally_reranked(pairs, load, 2)) == {1: [(3, 3.0, "applied"), (2, 2.0, "applied")], 2: [(1, None, "failed"), (2, None, "failed")]}
    assert ids(grounding.optionally_reranked(pairs, gone, 1)) == {q: [(1, None, "unavailable")] for q in (1, 2)}
    assert ids(grounding.optionally_reranked(pairs, None, 1)) == {q: [(1, None, "disabled")] for q in (1, 2)}
    assert grounding.optionally_reranked(pairs.limit(0), load, 1).count() == 0
    for scores in ([0.5], [0.5] * 9, None, [None, 1.0, 2.0], "ab"):  # another number of scores than of pairs, or no numbers
        assert {x[1:] for rows in ids(grounding.optionally_reranked(pairs, lambda s=scores: lambda _: s, 3)).values() for x in rows} == {(None, "failed")}


def test_modes_missing_tables_and_lookups(spark):
    hits = lambda k: spark.createDataFrame([(1, 1, 7, 0.5)], "query_id int, rank int, id int, score double")
    assert [tuple(r) for r in grounding.search("bm25", None, hits, 5).collect()] == [(1, 1, 7, 0.5)]
    with pytest.raises(ValueError):
        grounding.search("fuzzy", hits, hits, 5)
    assert grounding.table_or_empty(spark, "no_such_table_here", "a int").count() == 0
    records = spark.createDataFrame([("b", "p"), ("c", None)], "table_id string, point_id string")
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id int, rank int, table_id string")
    assert [(r.rank, r.table_id) for r in grounding.records_of(found, grounding.indexed_only(records), "table_id").collect()] == [(1, "b")]


def test_audit_reports_and_failed_stages(spark):
    docs = spark.createDataFrame([("h1", "{}", "a\n\nb"), ("h2", "{", "a"), ("h3", "{}", None), ("h4", None, None)], "content_hash string, canonical string, markdown string")
    stages = audit.staged(docs)
    assert [(r.failed_stage, r.audit_status) for r in stages.orderBy("content_hash").collect()] == [(None, "completed"), ("read_canonical", "failed"), ("read_markdown", "failed"), ("read_canonical", "failed")]
    full = stages.selectExpr("*", "1 AS page_count", "0 AS table_count", "0 AS figure_count", "'layout' AS parser", "cast(array() AS array<struct<type:string,stage:string>>) AS errors", "2 AS chunk_count")
    rows = audit.verdicts(audit.summary(full)).join(stages.select("content_hash", "audit_status", "failed_stage"), "content_hash").selectExpr("*", "'r' AS audit_run_id", "'layout' AS parser_name", "cast(NULL AS int) AS elapsed_ms", "failed_stage AS error_message")
    got = {r.content_hash: (r.json, r.markdown) for r in audit.reports(rows).collect()}
    assert "**Elapsed:** n/a ms\n\n## Readiness Verdicts" in got["h1"][1] and "- Text: 4 chars, 4 avg/page\n" in got["h1"][1] and '"verdicts":{"quality_status"' in got["h1"][0]
    assert got["h2"][1].endswith("ms\n\n## Error\n\nread_canonical\n") and "verdicts" not in got["h2"][0]
