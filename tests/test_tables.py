from pyspark.sql import functions as F

from lodestone.operators import reasoning, tables, visuals
from lodestone.plans.evidence import MATRIX

MARKDOWN = """<!-- page 7 -->
Segment Summary
| Metric | 2025 | 2024 |
|---|---:|---:|
| Revenue | $78,454 | $70,114 |
| Net income | $27,761 | $24,846 |

<!-- page 8 -->
Segment & Corporate results
As of or for the year ended December 31,
(in millions, except ratios)
""" + MATRIX


def lines(spark):
    return tables.lines(spark.createDataFrame([("d", MARKDOWN)], "doc string, md string"), "doc", F.col("md"))


def test_pages_and_pipe_tables(spark):
    pages = tables.pages(lines(spark))
    assert {r["page"] for r in pages.collect()} == {7, 8}
    (t,) = tables.pipe_tables(pages).collect()
    assert t["headers"] == ["Metric", "2025", "2024"] and t["rows"] == [["Revenue", "$78,454", "$70,114"], ["Net income", "$27,761", "$24,846"]] and t["readiness"] == "good"


def test_spans_have_the_matrix(spark):
    got = tables.spans(lines(spark)).collect()
    assert any(r["last"] - r["first"] >= 3 for r in got)


def test_matrix_answer(spark):
    q = spark.createDataFrame([(0, "Which segment had the highest 2025 net income?"), (1, "Who?"), (2, "total assets in 2025?")], "query_id int, question string")
    t = spark.createDataFrame([(i, "t1", 1, None, [], "", "(in millions)\n" + MATRIX) for i in range(3)], "query_id int, table_id string, evidence_index int, headers array<string>, rows array<array<string>>, context string, raw_text string")
    got = {r["query_id"]: r for r in reasoning.answers(q, t).collect()}
    assert (got[0]["status"], got[0]["label"], got[0]["value"], got[0]["display_value"], got[0]["citation"]) == ("supported", "Commercial & Investment Bank", 27761.0, "$27,761 million", "T1")
    assert got[1]["status"] == "unsupported_intent" and got[2]["status"] == "no_observation"


def test_structured_answer(spark):
    q = spark.createDataFrame([(0, "Which segment had the highest 2025 net income?")], "query_id int, question string")
    rows = [["Consumer & Community Banking", "$18,245", "$17,603"], ["Commercial & Investment Bank", "$27,761", "$24,846"]]
    t = spark.createDataFrame([(0, "t1", 1, ["Segment", "2025", "2024"], rows, "Segment net income by year", "")], "query_id int, table_id string, evidence_index int, headers array<string>, rows array<array<string>>, context string, raw_text string")
    got = reasoning.answers(q, t).first()
    assert got["label"] == "Commercial & Investment Bank"
    assert got["reasoning"] == (
        "Computed table observation:\nMetric: net income\nYear: 2025\nOperation: max\nCandidates from T1: Consumer & Community Banking: $18,245; Commercial & Investment Bank: $27,761\n"
        "Result: Commercial & Investment Bank has the highest value at $27,761. Cite T1 for this result."
    )


def test_candidates_are_the_first_eight_of_the_chosen_table(spark):
    q = spark.createDataFrame([(0, "Which country had the lowest 2025 net income?")], "query_id int, question string")
    rows = [[f"Land {i:02d}", str(100 - i)] for i in range(12)]
    schema = "query_id int, table_id string, evidence_index int, headers array<string>, rows array<array<string>>, context string, raw_text string"
    t = spark.createDataFrame([(0, "far", 2, ["Land", "2025"], [["Elsewhere", "500"]], "Net income", ""), (0, "near", 1, ["Land", "2025"], [*rows, *rows[:1], ["", None]], "Net income", None)], schema)
    got = reasoning.answers(q, t).first()
    assert (got["label"], got["value"], got["citation"]) == ("Land 11", 89.0, "T1")
    assert "Elsewhere" not in got["reasoning"] and "Candidates from T1: " + "; ".join(f"Land {i:02d}: ${100 - i}" for i in range(8)) + "\n" in got["reasoning"]


def test_grids(spark):
    g = spark.createDataFrame([("a", [False], [["Segment", "2025"], ["", ""], ["X", "1"], ["Y", "2"]]), ("b", [False], [["1", "2"], ["3", ""]]), ("c", [False], [["", ""]])], "id string, flags array<boolean>, grid array<array<string>>")
    got = {r["id"]: r for r in tables.grid_tables(g).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["headers"] == ["Segment", "2025"] and got["a"]["readiness"] == "good" and got["a"]["risk_flags"] == []
    assert got["b"]["headers"] is None and got["b"]["risk_flags"] == ["missing_header"]


def test_figures(spark):
    d = spark.createDataFrame([("h" * 64, "Intro Figure 9 <!-- page 3 --> see Figure 1 here <!-- page 7 --> Chart 2, figure 1", 2, 0, 10), ("i" * 64, "Figure 1", 0, 0, 0)], "content_hash string, markdown string, figure_count int, pictures_with_page int, page_count int")
    got = {(r["label"], r["page"]) for r in visuals.figure_candidates(d).collect()}
    assert got == {("Figure 9", None), ("Figure 1", 3), ("Chart 2", 7)}
    assert visuals.page_renders(d.withColumn("artifact_dir", F.lit("x"))).count() == 10


def test_span_records_keep_pages_and_texts_apart(spark):
    grid = "Revenue 10 20 30\nNet income 1 2 3\nTotal assets 4 5 6"
    text = f"## Results #\n\n{grid}\n\n<!-- page 2 -->\n{grid}\nTotal loss 7 8 9\n\n<!-- page 3 -->\n{grid}"
    docs = spark.createDataFrame([("a", text), ("b", grid), ("c", ""), ("d", "plain words"), ("e", None)], "doc string, t string")
    got = {r.table_id: r for r in tables.span_records(tables.lines(docs, "doc", F.col("t"))).collect()}
    assert set(got) == {"a:table_text:0000:00", "a:table_text:0002:00", "b:table_text:0000:00"}  # page 3 repeats the first text
    assert got["a:table_text:0000:00"].title == "Results" and got["a:table_text:0000:00"].raw_text == grid
    assert got["a:table_text:0002:00"].page == 2 and got["a:table_text:0002:00"].n_rows == 4
    assert list(got["b:table_text:0000:00"].risk_flags) == ["fallback_text_span", "missing_page_markers"]
    chunks = spark.createDataFrame([("a", "a:0", 0, 1, 1), ("a", "a:7", 7, 2, 3)], "content_hash string, chunk_id string, chunk_index int, page_start int, page_end int")
    near = {r.page: r for r in tables.span_records(tables.lines(docs.where("doc = 'a'"), "doc", F.col("t")), chunks).collect()}
    assert near[2].source_chunk_id == "a:7" and near[2].table_id == "a:table_text:0007:00"


def test_headings_as_of_a_page(spark):
    h = spark.createDataFrame([("a", 1, 1, "one"), ("a", 5, None, "free"), ("a", 9, 3, "three")], "doc string, ord int, page int, text string")
    i = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, None), ("b", 4, 1)], "doc string, id int, page int")
    assert {r.id: r.heading for r in tables.heading_as_of(i, h).collect()} == {1: "free", 2: "three", 3: "three", 4: None}
