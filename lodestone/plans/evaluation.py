"""Queries over answers: recall, scores, summaries, citations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import token_recall
from lodestone.operators import evaluate
from lodestone.plans import evidence, retrieval
from lodestone.plans import inputs as I


def token_recalls(s, d):
    return I.turns(s, d).select("conv_id", "turn", token_recall(F.col("expected"), F.col("answer")).alias("recall"))


def _scored(s, d):
    extra = F.element_at(F.array(*[F.lit(a) for a in evidence.ANSWERS]), (F.col("conv_id") % len(evidence.ANSWERS) + 1).cast("int"))
    rows = I.turns(s, d).withColumn("evidence", F.col("answer")).withColumn("answer", F.concat("answer", F.lit(" "), extra)).withColumn("should_abstain", F.col("conv_id") % 3 == 0)
    return evaluate.scored(rows)


def score_answers(s, d):
    out = _scored(s, d).drop("expected", "answer", "evidence", "should_abstain")
    return out.withColumn("abstention_correct", F.col("abstention_correct").cast("string"))


def eval_summary(s, d):
    rows = _scored(s, d).withColumn("category", (F.col("turn") % 4).cast("string"))
    return evaluate.summarized(rows, ["category"])


def eval_worst(s, d):
    return evaluate.worst(_scored(s, d), ["conv_id", "turn"])


def nearest_rank_p95(s, d):
    """A12 of event values by type."""
    return evaluate.nearest_ranks(I.table(s, d, "events"), "event_type", "value", {"p95": 95, "p50": 50})


def sequence_similarity(s, d):
    return I.turns(s, d).select("conv_id", "turn", evaluate.similarity(F.lower("expected"), F.lower("answer")).alias("similarity"))


def _labelled(s, d):
    """Hits of three kinds, numbered C, T and V by rank within their kind."""
    hits = retrieval._hits(s, d).where("rank <= 12").withColumn("kind", F.when(F.col("id") % 3 == 0, "table").when(F.col("id") % 3 == 1, "visual").otherwise("text"))
    n = F.row_number().over(W.partitionBy("query_id", "kind").orderBy("rank"))
    letter = F.when(F.col("kind") == "table", "T").when(F.col("kind") == "visual", "V").otherwise("C")
    return hits.withColumn("citation", F.concat(letter, n.cast("string"))).withColumnRenamed("rank", "ord")


def citation_labels(s, d):
    return _labelled(s, d).select("query_id", F.col("id").alias("doc_id"), "citation")


def used_evidence(s, d):
    answers = I.questions(s, d).select("query_id", F.concat(F.lit("See [C1], [t2] and [V"), (F.col("query_id") % 4).cast("string"), F.lit("].")).alias("answer"))
    return evaluate.used_and_unused(_labelled(s, d), answers).select("query_id", "citation", F.col("id").alias("doc_id"), "used")


def evidence_by_document(s, d):
    return evaluate.evidence_by_document(_labelled(s, d))


def documents_used(s, d):
    """The documents of a question in order of first appearance."""
    first = _labelled(s, d).groupBy("query_id", "document").agg(F.min("ord").alias("ord"))
    return first.select("query_id", "document", F.row_number().over(W.partitionBy("query_id").orderBy("ord")).alias("position"))


QUERIES = {f.__name__: f for f in (token_recalls, score_answers, eval_summary, eval_worst, nearest_rank_p95, sequence_similarity, citation_labels, used_evidence, evidence_by_document, documents_used)}

_TURNS = "tu AS (SELECT a.conv_id, a.turn, b.text AS expected, a.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant')"
_SET = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def _recall(e, o):
    e, o = _SET.format(e), _SET.format(o)
    return f"CASE WHEN len({e}) > 0 THEN round_even(len(list_intersect({e}, {o})) / len({e})::DOUBLE, 4) ELSE 0.0::DOUBLE END"


_SCORED = f"""{_TURNS}, x AS (SELECT conv_id, turn, expected, answer AS ev, trim(answer || ' ' || {evidence._pick(evidence.ANSWERS, "conv_id")}) AS answer FROM tu),
y AS (SELECT *, {_recall("expected", "answer")} AS ar, {_recall("expected", "ev")} AS er, len({_SET.format("expected")}) > 0 AS known, ({evidence._phrases("answer", evidence.V.EVAL_CONTRACTIONS, evidence.V.EVAL_ABSTENTIONS, True)}) AS ab,
  len(list_distinct(list_transform(regexp_extract_all(answer, '(?i)\\[([CTV][0-9]+)\\]', 1), lambda q: upper(q))))::INT AS cc FROM x),
sc AS (SELECT conv_id, turn, answer <> '' AS answer_present, cc AS citation_count, cc > 0 AS citation_presence, ar AS expected_answer_token_recall, CASE WHEN known THEN ar END AS answer_token_recall, CASE WHEN known THEN er END AS retrieved_evidence_token_recall,
  CASE WHEN known THEN round_even(er - ar, 4) END AS evidence_answer_gap, ab AS abstention_detected, CASE WHEN conv_id % 3 = 0 THEN ab::VARCHAR WHEN ab THEN 'false' END AS abstention_correct FROM y)"""
_HITS = f"""{retrieval._bm25_sql()}, h AS (SELECT query_id, doc_id, source AS document, rank, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'visual' ELSE 'text' END AS kind FROM ranked JOIN documents USING (doc_id) WHERE rank <= 12),
lab AS (SELECT *, CASE kind WHEN 'table' THEN 'T' WHEN 'visual' THEN 'V' ELSE 'C' END || row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS citation FROM h)"""
_RATE = "round_even(avg({0}::INT), 4)"
_RANK = "list_sort(list(value))[greatest(0, least(count(*) - 1, round_even({0} * (count(*) - 1), 0)))::BIGINT + 1]"

SQL = {
    "token_recalls": f"WITH {_TURNS} SELECT conv_id, turn, {_recall('expected', 'answer')} AS recall FROM tu",
    "score_answers": f"WITH {_SCORED} SELECT * FROM sc",
    "eval_summary": f"""WITH {_SCORED} SELECT (turn % 4)::VARCHAR AS category, count(*) AS n, {_RATE.format("answer_present")} AS answer_present_rate, {_RATE.format("citation_presence")} AS citation_presence_rate, {_RATE.format("abstention_detected")} AS abstention_rate,
{_RATE.format("(abstention_correct = 'true')")} AS abstention_correct_rate, round_even(avg(expected_answer_token_recall), 4) AS expected_recall_avg, round_even(avg(answer_token_recall), 4) AS answer_recall_avg, round_even(avg(retrieved_evidence_token_recall), 4) AS evidence_recall_avg FROM sc GROUP BY 1""",
    "eval_worst": f"""WITH {_SCORED}, ok AS (SELECT conv_id, turn, retrieved_evidence_token_recall AS r, evidence_answer_gap AS g FROM sc WHERE conv_id % 3 <> 0 AND retrieved_evidence_token_recall IS NOT NULL),
b AS (SELECT 'lowest_evidence_recall' AS list, (row_number() OVER (ORDER BY r, conv_id, turn))::INT AS position, conv_id, turn, r AS value FROM ok UNION ALL SELECT 'largest_gap', (row_number() OVER (ORDER BY g DESC, conv_id, turn))::INT, conv_id, turn, g FROM ok) SELECT * FROM b WHERE position <= 5""",
    "nearest_rank_p95": f"SELECT event_type, {_RANK.format('0.95::DOUBLE')} AS p95, {_RANK.format('0.5::DOUBLE')} AS p50 FROM events GROUP BY 1",
    "citation_labels": f"WITH {_HITS} SELECT query_id, doc_id, citation FROM lab",
    "used_evidence": f"WITH {_HITS} SELECT query_id, citation, doc_id, citation IN ('C1', 'T2', 'V' || query_id % 4) AS used FROM lab",
    "evidence_by_document": f"WITH {_HITS} SELECT query_id, document, count(*) FILTER (WHERE kind = 'text') AS text_count, count(*) FILTER (WHERE kind = 'table') AS table_count, count(*) FILTER (WHERE kind = 'visual') AS visual_count, min(rank) AS first_ord FROM lab GROUP BY ALL",
    "documents_used": f"WITH {_HITS}, f AS (SELECT query_id, document, min(rank) AS o FROM lab GROUP BY ALL) SELECT query_id, document, (row_number() OVER (PARTITION BY query_id ORDER BY o))::INT AS position FROM f",
}
