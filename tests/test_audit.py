import duckdb
import pytest

from lodestone.operators import audit
from lodestone.plans import records

SCHEMA = "content_hash string, markdown string, page_count int, table_count int, figure_count int, parser string, errors array<struct<type:string,stage:string>>, chunk_count int"


def audited(spark, markdown="", pages=1, tables=0, figures=0, parser="docling", errors=(), chunks=0):
    rows = spark.createDataFrame([("h", markdown, pages, tables, figures, parser, [tuple(e) for e in errors], chunks)], SCHEMA)
    return audit.verdicts(audit.summary(rows)).first()


@pytest.mark.parametrize("parser,errors,used,reason", [("docling", [], False, None), ("pypdfium2-text", [("parser_selection", None)], True, "size_threshold"), ("pypdfium2-text", [("x", "docling_primary_parser")], True, "docling_failed"), ("pypdfium2-text", [], True, "manual_backend"), ("pypdfium2-text", [("x", "y")], True, "unknown")])
def test_fallback(spark, parser, errors, used, reason):
    got = audited(spark, parser=parser, errors=errors)
    assert (got["fallback_used"], got["fallback_reason"]) == (used, reason)


def test_empty_pages(spark):
    got = audited(spark, "<!-- page 1 -->\n\nSome text.\n\n<!-- page 2 -->\n\n\n\n<!-- page 3 -->\n\nMore text.\n\n<!-- page 4 -->\n\n", 4)
    assert got["empty_page_count"] == 2 and got["text_chars_total"] == 20 and got["avg_chars_per_page"] == 10.0
    assert got["text_readiness"] == "poor" and got["quality_status"] == "poor"
    assert "high_empty_page_ratio" in got["risk_flags"] and "low_text_density" in got["risk_flags"]


def test_good_document(spark):
    table = "\n".join("a  b  c" for _ in range(3))
    got = audited(spark, "<!-- page 1 -->\n" + "x" * 300 + "\nFigure 1 shows\n" + table, 1, 1, 1)
    assert (got["text_readiness"], got["table_readiness"], got["visual_readiness"], got["quality_status"]) == ("good",) * 4
    assert got["risk_flags"] == []


def test_parse_trees_come_before_text(spark):
    table = "\n".join("a  b  c" for _ in range(3))
    tree = '{"tables": [{"prov": [{"page_no": 2}, {"page_no": 0}]}, {"prov": [{"page_no": 2}]}, {}], "pictures": [{"captions": [{"text": ""}, {"text": "x"}]}, {"captions": []}, {}]}'
    trees = [("a", tree, True), ("b", "{broken", True), ("c", None, True), ("d", None, False), ("e", "{}", None)]
    rows = [(h, f"Figure 1\n{table}", 1, 1, 1, "docling", [], 0, t, e) for h, t, e in trees]
    got = {r.content_hash: r for r in audit.verdicts(audit.summary(spark.createDataFrame(rows, SCHEMA + ", tree string, tree_expected boolean"))).collect()}
    counts = {h: (r.table_candidate_count, r.table_like_page_count, r.figure_candidate_count, r.caption_candidate_count) for h, r in got.items()}
    assert counts == {"a": (3, 1, 3, 1), "b": (1, 1, 1, 1), "c": (1, 1, 1, 1), "d": (1, 1, 1, 1), "e": (0, 0, 0, 0)}
    assert {h for h, r in got.items() if "missing_docling_json" in r.risk_flags} == {"b", "c"} and got["e"].table_readiness == "weak"


@pytest.mark.parametrize("markdown,references,captions", [("éfig 1", 1, 1), ("figé ñchart", 2, 0), ("FIG.ü Exhibitß3", 2, 0), ("éfig.a 2", 1, 0), ("afig figa fig_ _fig 1 figure2", 0, 1), ("fig. fig.", 2, 0), ("фdiagram", 1, 0)])
def test_letters_beyond_ascii_end_a_figure_word(spark, markdown, references, captions):
    """SQL's words are of ASCII letters; Java's, before 19, were of those of all scripts."""
    got = audited(spark, markdown)
    assert (got["figure_candidate_count"], got["caption_candidate_count"]) == (references, captions)


def as_in_sql(spark, folder, name):
    texts = ["éfig 1 von\nä", "ein figé", "ñfigure und ßchart 2\nÉexhibit", "diagram", "prosa"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = records.QUERIES[name](spark, str(folder))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({records.SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_summary_is_that_of_sql(spark, tmp_path):
    got, want = as_in_sql(spark, tmp_path, "audit_summary")
    assert got == want


def test_verdicts_are_those_of_sql(spark, tmp_path):
    got, want = as_in_sql(spark, tmp_path, "audit_verdicts")
    assert got == want
