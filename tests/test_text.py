import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, expr, **values):
    names = list(values)
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("cell,value", [("$27,761", 27761.0), ("(425)", -425.0), ("32%", 32.0), ("-", None), ("NM", None), ("", None), ("(1,204", 1204.0), ("abc", None), ("1e5", 100000.0)])
def test_numbers(spark, cell, value):
    assert one(spark, T.numeric(F.col("c")), c=cell) == value


def test_numbers_keep_their_digits_in_each_place(spark):
    assert one(spark, T.line_numbers(F.col("c")), c="Net income $ 18,245 $ 17,603 $ 27,761 (12) 5 %") == ["18,245", "17,603", "27,761", "(12)", "5 %"]


def test_table_intent(spark):
    got = one(spark, T.table_intent(F.col("q")), q="Which segment had the highest 2025 net income?")
    assert got["detected"] and got["matches"] == ["2025", "net income", "segment", "highest"]
    assert not one(spark, T.table_intent(F.col("q")), q="Which strategy does the report recommend for upper-middle-income countries?")["detected"]


@pytest.mark.parametrize("question,found", [("see fig. 3", False), ("see fig.3", True), ("the charts", True), ("as shown here", False), ("shown in the graphs", True)])
def test_visual_intent(spark, question, found):
    assert one(spark, T.visual_intent(F.col("q")), q=question)["detected"] is found


@pytest.mark.parametrize("category,kind,mode", [("Mixed", "table", "auto"), ("Text", "paragraph", "visual"), ("Table Lookup", "", "table"), ("Text Factual", "text", "text")])
def test_router(spark, category, kind, mode):
    assert one(spark, T.evidence_mode(F.col("a"), F.col("b")), a=category, b=kind) == mode


def test_abstentions(spark):
    assert one(spark, T.abstains_in_query(F.col("a")), a="I can't answer")
    assert not one(spark, T.abstains_in_query(F.col("a")), a="I can’t answer")
    assert one(spark, T.abstains_in_evaluation(F.col("a")), a="I can’t answer")


def test_token_recall(spark):
    r = T.token_recall(F.col("e"), F.col("o"))
    assert one(spark, r, e="apple banana cherry", o="apple banana cherry date") == 1.0
    assert one(spark, r, e="apple banana cherry", o="apple date") == 0.3333
    assert one(spark, r, e="", o="apple") == 0.0


def test_labels(spark):
    assert one(spark, T.page_label(F.col("a"), F.col("b")), a=3, b=5) == "3-5"
    assert one(spark, T.page_label(F.col("a"), F.col("b")), a=0, b=5) == "5"
    assert one(spark, T.page_label(F.col("a"), F.col("b")), a=0, b=0) == "unknown"
    assert one(spark, T.citation_ids(F.col("a")), a="[c2] [T1] [C2] [X9]") == ["C2", "T1"]
    assert one(spark, T.figure_label(F.col("a")), a="see figure 12 and Chart 2") == "Figure 12"
    assert one(spark, T.chunk_index(F.col("a")), a="ab:text:0007") == 7
    assert one(spark, T.chunk_index(F.col("a")), a="ab") is None
    assert one(spark, T.collapsed(F.col("a")), a=" a  b\n") == "a b"
