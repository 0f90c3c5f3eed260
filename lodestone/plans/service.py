"""Queries over whole jobs: questions to cited answers, evaluation runs and reports, index actions, names by suffix."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import asking, evaluation_run, lexical, registry, word_index
from lodestone.plans import evaluation, retrieval
from lodestone.plans import inputs as I
from lodestone.sources import stored, versions

NO = "I do not have enough evidence."
FILTER, INDEXED, LIMIT = ["d0", "d1", "d2", "d3", "d4"], ["d0", "d1", "d3", "d5"], 150


def cited_answers(s, d):
    """All benchmark questions by the stored word index, four hits each, eight for those that decline. The stand-in for a model
    answers by the first document it is shown whose id ends in 0 or 5, and declines else."""
    docs = I.table(s, d, "documents")
    index = word_index.build(docs, "doc_id", F.col("text"))

    def search(questions, k):
        hits = word_index.topk(index, questions, "query_id", F.col("question"), k).select("query_id", "id", "score")
        texts = docs.select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("source"))
        # few hits meet all texts: written, their size is known to the join
        return stored.kept(lexical.ranked(hits, k), "hits").join(texts, "id").select("query_id", "rank", "id", "text", "source")

    def read(rows):
        shown = r"\[(C[0-9]+)\] Source: file ([0-9]*[05])\n"
        cited, name = F.regexp_extract("prompt", shown, 1), F.regexp_extract("prompt", shown, 2)
        return rows.select("query_id", F.when(cited != "", F.concat(F.lit("Document "), name, F.lit(" says so ["), cited, F.lit("]."))).otherwise(NO).alias("answer"))

    out = asking.answered(I.questions(s, d).withColumn("mode", F.lit("text")), search, read, 4)
    return out.select("query_id", "answer", "status", F.array_join("citations", ",").alias("citations"), "retrieved_count", "abstention_retry_triggered", "retry_top_k", "initial_answer_was_abstention", "retry_answer_was_abstention")


def _run(s, d, doc_ids, limit):
    """Turns as golden questions of seven documents, scored; some fail."""
    scored = stored.kept(evaluation._scored(s, d).drop("expected", "answer", "evidence"), "scored")
    key = F.col("conv_id") * 1000 + F.col("turn")
    ended = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "provider_failed").when((F.col("conv_id") + F.col("turn")) % 13 == 0, "failed").otherwise("evaluated")
    rows = scored.withColumn("qa_id", key).withColumn("ended", ended).withColumn("latency_ms", (F.col("conv_id") * 37 % 1000) + F.col("turn") * 0.5)
    questions = rows.select("qa_id", F.concat(F.lit("d"), (F.col("conv_id") % 7).cast("string")).alias("doc_id"), F.concat(F.lit("t"), (F.col("turn") % 4).cast("string")).alias("category"))
    measures = [c for c in scored.columns if c not in ("conv_id", "turn")] + ["latency_ms"]
    attempt = lambda q: rows.join(q.select("qa_id"), "qa_id", "left_semi").select("qa_id", F.col("ended").alias("status"), *measures)
    indexed = s.createDataFrame([(x,) for x in INDEXED], "doc_id string")
    return evaluation_run.admitted(questions, ["qa_id"], doc_ids, limit, indexed, attempt)


def eval_statuses(s, d):
    """Who is evaluated of all turns, with a filter and a limit."""
    return _run(s, d, FILTER, LIMIT).select("qa_id", "doc_id", "status", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))


def eval_report(s, d):
    """The report over all turns, by status, category, document and in all."""
    return evaluation_run.report(_run(s, d, None, None))


def index_actions(s, d):
    """M2, M4: what an index does with each document; users' events are their runs."""
    docs = I.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("content_hash"), "doc_id")
    status = F.when(F.col("event_type") == "purchase", "indexed").when(F.col("event_type") == "click", "no_evidence").otherwise("failed")
    runs = I.table(s, d, "events").where("user_id % 4 < 2").groupBy("user_id").agg(F.min_by(status, "event_id").alias("status")).select(F.col("user_id").cast("string").alias("content_hash"), "status")
    return versions.index_actions(docs, runs, docs.where("doc_id % 3 > 0"))


def suffix_names(s, d):
    """nations' and regions' names of files, with an underscore for any character, against the paths of all customers."""
    path = F.concat(F.lit("/data/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".PDF"))
    docs = I.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("content_hash"), path.alias("source_path"))
    n = I.table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.concat(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("_.pdf")).alias("filename"))
    r = I.table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.concat(F.lit("customer_00000000"), F.col("r_regionkey").cast("string"), F.lit(".pdf")).alias("filename"))
    return registry.resolve_ids(n.unionByName(r), docs)


QUERIES = {f.__name__: f for f in (cited_answers, eval_statuses, eval_report, index_actions, suffix_names)}

_ASKED = f"""{retrieval._bm25_sql()},
r4 AS (SELECT query_id, arg_min(doc_id, rank) FILTER (WHERE doc_id % 5 = 0 AND rank <= 4) AS a4, min(rank) FILTER (WHERE doc_id % 5 = 0 AND rank <= 4) AS k4,
  arg_min(doc_id, rank) FILTER (WHERE doc_id % 5 = 0 AND rank <= 8) AS a8, min(rank) FILTER (WHERE doc_id % 5 = 0 AND rank <= 8) AS k8, count(*) FILTER (WHERE rank <= 4) AS n4, count(*) FILTER (WHERE rank <= 8) AS n8 FROM ranked GROUP BY query_id),
b AS (SELECT item_id AS query_id, r4.* EXCLUDE (query_id), r4.query_id IS NULL AS nothing, a4 IS NULL AND r4.query_id IS NOT NULL AS again FROM benchmark LEFT JOIN r4 ON r4.query_id = item_id)"""
_TRIED = f"""{evaluation._SCORED}, q AS (SELECT *, conv_id * 1000 + turn AS qa_id, 'd' || conv_id % 7 AS doc_id, 't' || turn % 4 AS category, (conv_id * 37 % 1000) + turn * 0.5::DOUBLE AS latency_ms, conv_id % 3 = 0 AS should_abstain,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN 'provider_failed' WHEN (conv_id + turn) % 13 = 0 THEN 'failed' ELSE 'evaluated' END AS ended FROM sc)"""
_INDEXED = "doc_id IN ('" + "', '".join(INDEXED) + "')"
_AVG = "round_even(avg({0}) FILTER (WHERE status = 'evaluated'), 4)"

SQL = {
    "cited_answers": f"""WITH {_ASKED} SELECT query_id,
CASE WHEN nothing THEN 'I do not have enough evidence from the indexed document to answer.' WHEN a4 IS NOT NULL THEN 'Document ' || a4 || ' says so [C' || k4 || '].' WHEN a8 IS NOT NULL THEN 'Document ' || a8 || ' says so [C' || k8 || '].' ELSE '{NO}' END AS answer,
CASE WHEN nothing THEN 'no_evidence' ELSE 'unchecked' END AS status, CASE WHEN a4 IS NOT NULL THEN 'C' || k4 WHEN a8 IS NOT NULL THEN 'C' || k8 ELSE '' END AS citations,
CASE WHEN nothing THEN 0 WHEN again THEN n8 ELSE n4 END AS retrieved_count, again AS abstention_retry_triggered, CASE WHEN again THEN 8 END AS retry_top_k, again AS initial_answer_was_abstention, CASE WHEN again THEN a8 IS NULL END AS retry_answer_was_abstention FROM b""",
    "eval_statuses": f"""WITH {_TRIED}, f AS (SELECT *, doc_id IN ('{"', '".join(FILTER)}') AS inside, {_INDEXED} AS known FROM q),
c AS (SELECT *, coalesce(sum((inside AND known AND ended = 'evaluated')::INT) OVER (ORDER BY qa_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM f),
t AS (SELECT *, CASE WHEN NOT inside THEN 'skipped_by_filter' WHEN done >= {LIMIT} THEN 'skipped_by_limit' WHEN NOT known THEN 'skipped_not_indexed' ELSE ended END AS status FROM c)
SELECT qa_id, doc_id, status, CASE status WHEN 'skipped_by_filter' THEN 'doc_id filter' WHEN 'skipped_by_limit' THEN 'evaluation limit reached' WHEN 'skipped_not_indexed' THEN 'No indexed text chunks found for ' || doc_id ELSE '' END AS skip_reason FROM t""",
    "eval_report": f"""WITH {_TRIED}, t AS (SELECT *, CASE WHEN {_INDEXED} THEN ended ELSE 'skipped_not_indexed' END AS status FROM q),
g AS (SELECT status AS s, category AS c, doc_id AS f, grouping_id(status, category, doc_id) AS g, count(*) AS n, count(*) FILTER (WHERE status = 'evaluated') AS evaluated, count(*) FILTER (WHERE starts_with(status, 'skipped')) AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed,
  {_AVG.format("answer_present::INT")} AS answer_present_rate, {_AVG.format("citation_presence::INT")} AS citation_presence_rate, {_AVG.format("expected_answer_token_recall")} AS average_expected_answer_token_recall, {_AVG.format("(abstention_correct = 'true')::INT")} AS abstention_correct_rate,
  round_even(avg((abstention_correct = 'true')::INT) FILTER (WHERE status = 'evaluated' AND should_abstain), 4) AS true_abstention_accuracy, round_even(avg(abstention_detected::INT) FILTER (WHERE status = 'evaluated' AND NOT should_abstain), 4) AS false_abstention_rate,
  {_AVG.format("retrieved_evidence_token_recall")} AS average_retrieved_evidence_token_recall, {_AVG.format("answer_token_recall")} AS average_answer_token_recall, {_AVG.format("evidence_answer_gap")} AS average_evidence_answer_gap,
  round_even(median(latency_ms) FILTER (WHERE status = 'evaluated'), 2) AS latency_ms_p50, list_sort(list(latency_ms) FILTER (WHERE status = 'evaluated')) AS l FROM t GROUP BY GROUPING SETS ((status), (category), (doc_id), ()))
SELECT CASE g WHEN 3 THEN 'status' WHEN 5 THEN 'category' WHEN 6 THEN 'doc_id' ELSE 'all' END AS grouping, CASE g WHEN 3 THEN s WHEN 5 THEN c WHEN 6 THEN f ELSE '' END AS key, g.* EXCLUDE (s, c, f, g, l), round_even(l[round_even(0.95::DOUBLE * (len(l) - 1), 0)::BIGINT + 1], 2) AS latency_ms_p95 FROM g""",
    "index_actions": """WITH r AS (SELECT user_id, CASE arg_min(event_type, event_id) WHEN 'purchase' THEN 'indexed' WHEN 'click' THEN 'no_evidence' ELSE 'failed' END AS status FROM events WHERE user_id % 4 < 2 GROUP BY user_id),
x AS (SELECT doc_id, status, doc_id % 3 > 0 AS has, coalesce((status = 'indexed' AND doc_id % 3 > 0) OR (status = 'no_evidence' AND doc_id % 3 = 0), false) AS same FROM documents LEFT JOIN r ON user_id = doc_id)
SELECT doc_id::VARCHAR AS content_hash, CASE WHEN same THEN 'reuse' ELSE 'index' END AS action, NOT same AND status IS NOT NULL AND has AS stale FROM x""",
    "suffix_names": """WITH n AS (SELECT 'n' || n_nationkey AS doc_id, lpad(n_nationkey::VARCHAR, 2, '0') || '_.pdf' AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'customer_00000000' || r_regionkey || '.pdf' FROM region),
d AS (SELECT c_custkey::VARCHAR AS h, lower('/data/' || c_mktsegment || '/' || c_name || '.PDF') AS p FROM customer), m AS (SELECT doc_id, h FROM n JOIN d ON p LIKE '%' || name),
c AS (SELECT doc_id, count(*) AS n, min(h) AS content_hash FROM m GROUP BY 1)
SELECT doc_id, coalesce(c.n, 0) AS n, content_hash, CASE WHEN c.n IS NULL THEN 'not_found' WHEN c.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM n LEFT JOIN c USING (doc_id)""",
}
