import json

from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.sources import io, providers
from lodestone.streaming import ingest


def test_files_to_canonical_documents_and_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.pdf").write_bytes(b"%PDF-1.7 one\ftwo")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"no")
    files = io.inspected_files(spark, str(tmp_path / "in"))
    got = {r["filename"].replace("%20", " "): r["is_pdf"] for r in files.collect()}
    assert got == {"a b.pdf": True, "bad.pdf": False}

    def parse(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        return list(enumerate(content.decode().split("\f"), 1))

    pages = io.parsed(files, parse)
    assert pages.where("error IS NOT NULL").count() == 1
    docs = io.canonical(files, io.markdown(pages))
    io.write_canonical(docs, str(tmp_path / "out"))
    back = io.read_canonical(spark, str(tmp_path / "out")).collect()
    assert len(back) == 1 and back[0]["parse"]["page_count"] == 2 and len(back[0]["pages"]) == 2
    assert io.routed(files, threshold=5).where("parser = 'text'").count() == 1


def test_corrupt_json_is_a_row(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"schema_version": "v"}) + "\n{broken\n")
    rows = io.read_canonical(spark, str(tmp_path)).cache()
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text("qa_id,doc_id,category,question,expected_answer,expected_evidence_type,expected_pages,expected_source_notes,should_abstain,difficulty,status,reviewer_notes\nq1,d,c,What?,a,,,,Yes,,,\nq2,d,c,,a,,,,no,,,\n")
    (q,) = io.read_questions(spark, str(tmp_path / "q.csv")).collect()
    assert q["qa_id"] == "q1" and q["should_abstain"] is True
    assert io.allowed("/a/b/../c", ["/a"]) and not io.allowed("/ab", ["/a"])


def test_providers(spark):
    d = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in providers.embedded(d, "text", providers.hash_model, 1).collect()}
    assert got[1] == providers.hash_vector("x") and len(got[2]) == 16
    assert providers.extractive_answer("what is x", [("C1", "no"), ("C2", "x is y")]) == "x is y [C2]"


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"doc_id": i, "text": t, "arrived": "2024-01-01T00:00:00Z"} for i, t in enumerate(["one\ntwo", "one\ntwo", "three"])]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ingest.chunk_stream(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one\n\ntwo", "three"}


def test_event_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["n"], r["value"]) for r in ingest.event_windows(e).collect()) == [(1, 4.0), (2, 3.0)]


def test_plan_of_top_k_limits_before_the_window(spark):
    hits = spark.range(100).selectExpr("id % 3 AS query_id", "id", "id * 1.0D AS score")
    plan = lexical.ranked(hits, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
