from pyspark.sql import functions as F

from lodestone.operators import evidence_records, tables

GRIDS = "doc string, ord int, page int, caption string, heading string, flags array<boolean>, grid array<array<string>>"
DOCS = "content_hash string, pictures array<struct<caption:string,page:int>>, page_count int, figure_count int, artifact_dir string, markdown string"
PIPE = "| Metric | 2025 | 2024 |\n|---|---:|---:|\n| Revenue | 78,454 | 70,114 |"


def records(spark, texts, grids=(), **options):
    rows = tables.lines(spark.createDataFrame(texts, "doc string, t string"), "doc", F.col("t"))
    return evidence_records.table_records(rows, spark.createDataFrame(list(grids), GRIDS), **options).orderBy("doc", "table_index").collect()


def test_kinds_are_numbered_on_and_equal_texts_are_one(spark):
    text = f"<!-- page 3 -->\n## Results\n\n{PIPE}\n\n<!-- page 4 -->\n{PIPE}\nplain\n\nRevenue 10 20 30\nNet income 1 2 3\nTotal assets 4 5 6"
    grid = [["Segment", "2025"], ["", ""], ["X", "1"], ["Y", "2"]]
    grids = [("a", 0, 1, " Sales ", "Part one", [False], grid), ("a", 1, 2, "", None, [False], grid), ("a", 2, 2, None, None, [], None)]
    got = records(spark, [("a", text), ("b", None), ("c", ""), ("d", "words")], grids)
    assert [(r.table_id, r.source_kind, r.page) for r in got] == [("a:table:0000", "docling_table", 1), ("a:table:0001", "markdown_table", 3), ("a:table_text:0004:00", "text_pattern", 4)]
    one, two, three = got
    assert one.title == "Sales" and one.section_heading == "Part one" and one.raw_text == "Segment | 2025\nX | 1\nY | 2"
    assert one.markdown_table == "| Segment | 2025 |\n| --- | --- |\n| X | 1 |\n| Y | 2 |" and one.readiness == "good" and one.n_rows == 2
    assert two.title == "Results" and two.n_rows == 1 and two.n_cols == 3 and two.readiness == "good" and list(two.risk_flags) == ["single_row_table"] and two.raw_text == PIPE
    assert three.raw_text.startswith("Revenue 10") and three.table_type == "table_like_text" and three.n_rows == 3 and three.table_index == 2


def test_a_run_of_bars_is_one_table(spark):
    got = records(spark, [("a", "x | y\n||a|b||\n|---|---|\n|1|2|3|\n|---|---|\n| 4 |\n| | |")], fallback_used=True)
    assert len(got) == 1 and got[0].raw_text.startswith("||a|b||") and got[0].n_cols == 3 and got[0].n_rows == 3
    assert list(got[0].risk_flags) == ["fallback_parser_used", "missing_page_markers"] and got[0].title == "x | y"


def test_a_table_that_is_also_table_like_text_counts_once(spark):
    table = "| Revenue | 2025 | 2024 | 2023 |\n|---|---|---|---|\n| Net income | 1 | 2 | 3 |"
    assert [r.source_kind for r in records(spark, [("a", f"\n{table}\n")])] == ["markdown_table"]


def test_text_of_any_length_is_kept_whole_without_a_limit(spark):
    text = "\n".join(f"Revenue {i} {i + 1} {i + 2} and more" for i in range(1_000))
    assert len(records(spark, [("a", text)])[0].raw_text) <= 10_000
    assert records(spark, [("a", text)], most=None)[0].raw_text == text


def test_visuals_of_all_kinds(spark):
    text = "<!-- page 1 -->\nSee Figure 12 and figure 1.\n<!-- page 2 -->\nFigure 1 again, Chart 2\n<!-- page 2 -->\nlast"
    rows = [("h" * 64, [("Figure 7: growth", None), (" ", None)], 2, 3, "dir", text), ("i" * 64, [("Chart 1", 2)], 1, 1, None, text), ("j" * 64, None, 0, 1, "dir", None), ("k" * 64, [], None, 1, "dir", "Fig. 3")]
    headings = spark.createDataFrame([("h" * 64, 0, 1, "One"), ("h" * 64, 5, 2, "Two")], "doc string, ord int, page int, text string")
    out = evidence_records.visual_records(spark.createDataFrame(rows, DOCS), headings).collect()
    got = {r.visual_id: r for r in out}
    assert len(got) == len(out) == 7 + 2 + 1
    h = "h" * 12
    assert got[f"{h}:picture:0000"].figure_label == "Figure 7" and got[f"{h}:picture:0000"].readiness == "good" and got[f"{h}:picture:0001"].readiness == "weak"
    assert got[f"{h}:page:0001"].nearby_text == "See Figure 12 and figure 1." and got[f"{h}:page:0002"].nearby_text == "last" and got[f"{h}:page:0002"].section_heading == "Two"
    assert [(got[f"{h}:figcand:{n:04d}"].figure_label, got[f"{h}:figcand:{n:04d}"].page) for n in (4, 5, 6)] == [("Figure 12", 1), ("Figure 1", 1), ("Chart 2", 2)]
    assert got[f"{'i' * 12}:picture:0000"].nearby_text == "last" and got[f"{'i' * 12}:picture:0000"].artifact_path is None
    assert got[f"{h}:page:0001"].artifact_path == "dir/visuals/pages/page_0001.jpg" and got[f"{'k' * 12}:figcand:0000"].page is None
