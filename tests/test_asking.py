"""Questions to cited answers with a second search, and evaluation runs with limits and reports."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestone.operators import asking, evaluation_run, grounding, registry

NO = "I do not have enough evidence."


def searching(spark, hits, seen):
    frame = spark.createDataFrame(hits, "query_id long, rank int, id long, text string, source string")

    def search(questions, k):
        seen.append((k, sorted(r["query_id"] for r in questions.collect())))
        return frame.where(F.col("rank") <= k).join(questions.select("query_id"), "query_id", "left_semi")

    return search


def test_only_declined_questions_are_searched_again(spark):
    questions = spark.createDataFrame([(1, "a", "text"), (2, "b", "auto"), (3, "c", "text"), (4, "d", "table"), (5, "e", "text"), (1, "a", "text"), (None, "x", "text")], "query_id long, question string, mode string")
    hits = [(q, r, 10 * q + r, f"q{q} hit {r}", "s") for q in (1, 2, 4, 5) for r in range(1, 9)]
    seen, read_ids = [], []

    def read(rows):
        read_ids.append(sorted(r["query_id"] for r in rows.collect()))
        good = F.contains("prompt", F.lit("q1 hit 1")) | F.contains("prompt", F.lit("q2 hit 4"))
        return rows.select("query_id", F.when(good, F.concat(F.lit("Yes [C1] and [c9], ["), F.when(F.col("query_id") == 2, "C4").otherwise("C2"), F.lit("]."))).otherwise(NO).alias("answer"))

    rows = {r["query_id"]: r for r in asking.answered(questions, searching(spark, hits, seen), read, 2).collect()}
    assert seen == [(2, [1, 2, 3, 4, 5]), (4, [2, 5])]
    assert read_ids == [[1, 2, 4, 5], [2, 5]]
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1]["citations"] == ["C1", "C2"] and rows[2]["citations"] == ["C1", "C4"] and rows[1]["retrieved_count"] == 2 and rows[2]["retrieved_count"] == 4
    assert (rows[2]["initial_answer_was_abstention"], rows[2]["retry_answer_was_abstention"], rows[2]["retry_top_k"]) == (True, False, 4)
    assert (rows[5]["abstention_retry_triggered"], rows[5]["retry_answer_was_abstention"], rows[5]["answer"]) == (True, True, NO)
    assert rows[4]["abstention_retry_triggered"] is False and rows[4]["initial_answer_was_abstention"] is True
    assert rows[3]["answer"] == grounding.NO_EVIDENCE and rows[3]["status"] == "no_evidence" and rows[3]["retry_top_k"] is None


def test_verdicts_and_no_questions(spark):
    questions = spark.createDataFrame([(1, "a", "text"), (2, "b", "text")], "query_id long, question string, mode string")
    read = lambda rows: rows.select("query_id", F.lit("Fine [C1].").alias("answer"))

    def verify(rows):
        assert all("Answer:\nFine" in r["prompt"] for r in rows.collect())
        return rows.select("query_id", F.when(F.col("query_id") == 1, "unsupported").otherwise("supported").alias("verdict"), F.lit("").alias("revised_answer"))

    search = searching(spark, [(q, 1, q, "t", "s") for q in (1, 2)], [])
    rows = {r["query_id"]: r for r in asking.answered(questions, search, read, verify=verify).collect()}
    assert rows[1]["answer"] == grounding.NO_EVIDENCE and rows[1]["citations"] == [] and rows[2]["citations"] == ["C1"]
    assert asking.answered(questions.where("query_id = 9"), search, read).count() == 0


def loop(questions, doc_ids, limit, indexed, outcome):
    done, out = 0, {}
    for qa, doc in sorted(questions, key=lambda q: q[0]):
        if doc_ids and doc not in doc_ids:
            out[qa] = "skipped_by_filter"
        elif limit is not None and done >= limit:
            out[qa] = "skipped_by_limit"
        elif doc not in indexed:
            out[qa] = "skipped_not_indexed"
        else:
            out[qa] = outcome(qa)
            done += out[qa] == "evaluated"
    return out


@pytest.mark.parametrize("limit", [None, 0, 1, 7, 40, 500])
def test_statuses_equal_the_loop(spark, limit):
    draw = random.Random(limit or 3)
    questions = [(i, draw.choice(["a", "b", "c", "d", None])) for i in range(120)]
    outcome = lambda qa: "provider_failed" if qa % 7 == 3 else "failed" if qa % 5 == 4 else "evaluated"
    tried = []

    def attempt(rows):
        tried.extend(r["qa_id"] for r in rows.collect())
        return rows.select("qa_id", F.when(F.col("qa_id") % 7 == 3, "provider_failed").when(F.col("qa_id") % 5 == 4, "failed").otherwise("evaluated").alias("status"))

    frame = spark.createDataFrame(questions, "qa_id long, doc_id string")
    indexed = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "doc_id string")
    for doc_ids in (None, ["a", "c"]):
        tried.clear()
        got = evaluation_run.admitted(frame, ["qa_id"], doc_ids, limit, indexed, attempt).collect()
        want = loop(questions, doc_ids, limit, {"a", "b"}, outcome)
        assert {r["qa_id"]: r["status"] for r in got} == want
        assert len(tried) == len(set(tried)) and (limit is None or len(tried) <= limit + sum(outcome(t) != "evaluated" for t in tried))
        assert all((r["skip_reason"] is None) == (not r["status"].startswith("skipped")) for r in got)


RESULTS = "qa_id long, doc_id string, category string, status string, skip_reason string, latency_ms double, answer_present boolean, citation_presence boolean, abstention_detected boolean, abstention_correct boolean, should_abstain boolean, expected_answer_token_recall double, answer_token_recall double, retrieved_evidence_token_recall double, evidence_answer_gap double, question string"


def test_report_and_its_files(spark, tmp_path):
    draw = random.Random(8)
    rows = []
    for i in range(60):
        status = draw.choice(["evaluated", "evaluated", "failed", "skipped_by_limit"])
        ok = status == "evaluated"
        rows.append((i, draw.choice(["d1", "d2", None]), draw.choice(["Text", "Table"]), status, None if ok else "why", round(draw.uniform(1, 900), 3) if ok and i % 9 else None, ok or None, bool(i % 2) if ok else None, bool(i % 3 == 0) if ok else None, bool(i % 4) if ok and i % 5 else None, bool(i % 6 == 0), 0.25 if ok else None, 0.5 if ok else None, round(i / 100, 2) if ok else None, 0.1 if ok else None, "q"))
    frame = spark.createDataFrame(rows, RESULTS)
    got = {(r["grouping"], r["key"]): r for r in evaluation_run.report(frame).collect()}
    assert set(got) == {("all", ""), *(("status", s) for s in {r[3] for r in rows}), ("category", "Text"), ("category", "Table"), ("doc_id", "d1"), ("doc_id", "d2"), ("doc_id", "None")}
    for (grouping, key), r in got.items():
        own = [x for x in rows if grouping == "all" or str(x[{"status": 3, "category": 2, "doc_id": 1}[grouping]]) == key]
        done = [x for x in own if x[3] == "evaluated"]
        times = sorted(x[5] for x in done if x[5] is not None)
        assert (r["n"], r["evaluated"], r["failed"]) == (len(own), len(done), sum(x[3] == "failed" for x in own))
        assert r["latency_ms_p50"] == (round(statistics.median(times), 2) if times else None)
        assert r["latency_ms_p95"] == (round(times[round(0.95 * (len(times) - 1))], 2) if times else None)
        right = [x[9] for x in done if x[9] is not None]
        assert r["abstention_correct_rate"] == (round(sum(right) / len(right), 4) if right else None)
        quiet = [bool(x[8]) for x in done if not x[10]]
        assert r["false_abstention_rate"] == (round(sum(quiet) / len(quiet), 4) if quiet else None)
    evaluation_run.write_run(frame, "run", f"{tmp_path}/run")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/run/report.md").collect()]
    assert lines[:3] == ["# Report - run", "", "## Summary"] and f"- Questions seen: {len(rows)}" in lines and f"- failed: {sum(r[3] == 'failed' for r in rows)}" in lines
    assert spark.read.json(f"{tmp_path}/run/summary.json").count() == len(got)
    assert evaluation_run.report(frame.where("qa_id < 0")).count() == 0


def test_names_by_suffix_with_wildcards(spark):
    names = [("n1", "Report_2024.pdf"), ("n2", "b.pdf"), ("n3", "none.pdf"), ("n4", "___"), ("n5", None), ("n6", ""), ("n7", "a_c"), ("n8", "x%z_.md"), ("n9", "UP.PDF"), ("n10", "q\\r.pdf")]
    paths = ["/d/report-2024.pdf", "/d/Report_2024.PDF", "/d/old-report 2024.pdf", "/e/b.pdf", "/f/b.pdf", "/f/ab.pdf", "/g/zabc", "/g/xyyz1.md", "/g/up.pdf", "/h/q\\r.pdf", None]
    documents = spark.createDataFrame([(f"h{i}", p) for i, p in enumerate(paths)], "content_hash string, source_path string")
    frame = spark.createDataFrame([(i, n, k) for k, (i, n) in enumerate(names)], "doc_id string, filename string, ord int")
    got = {r["doc_id"]: (r["n"], r["content_hash"], r["status"]) for r in registry.resolve_ids(frame, documents).collect()}
    assert got["n1"] == (1, "h1", "resolved") and got["n2"] == (2, "h3", "ambiguous") and got["n3"] == (0, None, "not_found")
    assert got["n4"] == got["n5"] == got["n6"] == (0, None, "not_found")
    assert got["n7"] == (1, "h6", "resolved") and got["n8"] == (1, "h7", "resolved") and got["n9"] == (1, "h8", "resolved") and got["n10"] == (1, "h9", "resolved")
    assert {(r["doc_id"], r["content_hash"]) for r in registry.suffix_matches(frame, documents).where("doc_id IN ('n1', 'n2')").collect()} == {("n1", "h0"), ("n1", "h1"), ("n1", "h2"), ("n2", "h3"), ("n2", "h4"), ("n2", "h5")}
    back = {r["content_hash"]: r["doc_id"] for r in registry.reverse_ids(documents, frame).collect()}
    assert back["h1"] == "n1" and back["h0"] is None and back["h5"] == "n2" and back["h10"] is None and back["h8"] == "n9"
