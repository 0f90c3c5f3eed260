"""Queries from hits to prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import grounding, registry
from lodestone.plans import evaluation, retrieval
from lodestone.plans import inputs as I
from lodestone.sources import io, stored

SCOPES = ["single", "doc_ids", "all", "some"]
NODE_LABELS = ["table", "table_item", "promo", "economy"]


def visual_texts(s, d):
    """Parts as visuals."""
    some = lambda n, c: F.when(F.col("p_partkey") % n == 0, F.col(c))
    visual = F.struct(
        F.col("p_partkey").cast("string").alias("visual_id"), F.col("p_name").alias("filename"), (F.col("p_size") % 7).alias("page_start"), (F.col("p_size") % 5).alias("page_end"), F.lit("picture").alias("visual_type"),
        F.lit("good").alias("readiness"), F.col("p_type").alias("section_heading"), some(3, "p_brand").alias("figure_label"), some(2, "p_type").alias("caption"), F.repeat("p_name", 90).alias("nearby_text"),
    )
    rows = I.table(s, d, "part").select(F.col("p_size").alias("query_id"), F.lit(1).alias("rank"), "p_partkey", visual.alias("visual"))
    v = F.col("visual")
    shown = grounding.visual_inputs(rows, 1, carry=("p_partkey", "visual"))
    return shown.select("p_partkey", grounding.visual_embedding_text(v).alias("embedded"), grounding.visual_word_text(v).alias("words"), "citation_id", "metadata_text", "source")


def table_texts(s, d):
    """Parts as tables, every other one without cells."""
    cells = F.col("p_partkey") % 2 == 0
    table = F.struct(
        F.col("p_name").alias("filename"), (F.col("p_size") % 7).alias("page_start"), (F.col("p_size") % 5).alias("page_end"), F.col("p_type").alias("section_heading"), F.when(cells, "structured").otherwise("text").alias("table_type"), F.lit("good").alias("readiness"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("title"), F.lit("").alias("caption"), F.when(cells, F.array("p_name", "p_brand")).alias("headers"), F.when(cells, F.array_repeat(F.array("p_type", "p_type"), F.col("p_size") + 60)).alias("rows"), F.col("p_type").alias("raw_text"),
    )
    return I.table(s, d, "part").select("p_partkey", grounding.table_text(table).alias("text"))


def _evidence(s, d):
    """Hits of three kinds with their whole texts; questions divisible by 4 have a reasoned second table."""
    docs = I.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = evaluation._labelled(s, d).join(docs, "id").withColumn("rank", F.substring("citation", 2, 9).cast("int")).withColumn("source", F.concat(F.lit("file "), F.col("id").cast("string")))
    kind = lambda k: hits.where(F.col("kind") == k).select("query_id", "rank", "text", "source", F.col("citation").alias("citation_id"))
    reasoned = I.questions(s, d).where("query_id % 4 = 0").select("query_id", F.lit(2).alias("evidence_index"), F.lit("T2").alias("citation_id"), F.lit("Two is more than one.").alias("reasoning_text"))
    return grounding.grounding(kind("text"), kind("table"), kind("visual"), reasoned)


def grounding_prompts(s, d):
    """The prompt of each benchmark question over its hits."""
    return grounding.prompts(_evidence(s, d)).select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars"))


def answer_outcomes(s, d):
    """From questions to checked answers: hits of a score of 30 or more are the evidence, an extract of the first is the answer."""
    questions = I.questions(s, d).select("query_id", F.element_at(F.array(*[F.lit(m) for m in ("text", "table", "visual")]), (F.col("query_id") % 3 + 1).cast("int")).alias("mode"))
    hits = stored.kept(retrieval._words(s, d, 5).where("score >= 30"), "hits")
    answers = hits.where("rank = 1").select("query_id", F.concat(F.lit("See document "), F.col("id").cast("string"), F.lit(" [C1].")).alias("answer"))
    verdict = F.element_at(F.array(F.lit("unsupported"), F.lit("partially_supported"), F.lit("supported")), (F.col("query_id") % 4 + 1).cast("int"))
    verdicts = I.questions(s, d).where("query_id % 4 < 3").select("query_id", verdict.alias("verdict"), F.when(F.col("query_id") % 8 == 1, "In part [C1].").otherwise("").alias("revised_answer"))
    return grounding.outcomes(questions, answers, hits, verdicts)


def retrieval_modes(s, d):
    """The three modes, five hits a question; vectors and words are each searched once, for as many hits as the modes need."""

    def once(hits):
        found = stored.kept(hits, "hits")
        return lambda k: found.where(F.col("rank") <= k)

    dense, words = once(retrieval._cosine(s, d, 10)), once(retrieval._words(s, d, 10))
    parts = [grounding.search(m, dense, words, 5).select(F.lit(m).alias("mode"), "query_id", "rank", F.col("id").cast("long").alias("id"), "score") for m in ("dense", "bm25", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _by_length():
    def score(pairs):
        if len(pairs[0][0]) % 3 == 0:
            raise ValueError("a question that the stand-in can't score")
        return [float(len(text)) for _, text in pairs]

    return score


def rerank_fallback(s, d):
    """Hits by length of their texts; questions whose length divides by 3 fail and keep their order."""
    n = grounding.candidates(True, 20, 5)
    pairs = stored.kept(retrieval._words(s, d, n), "hits").join(I.questions(s, d), "query_id").join(I.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    out = grounding.optionally_reranked(pairs, _by_length, 5)
    return out.select("query_id", F.col("id").alias("doc_id"), "pre_rank", "rank", "rerank_score", "status")


def registered_files(s, d):
    """Files named by every hundredth document; the lines of a document are its chunks."""
    docs = I.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("content_hash"), F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), "text")
    names = docs.where("document_id % 100 = 0").select(F.col("document_id").alias("doc_id"), F.concat(F.col("document_id").cast("string"), F.lit(".txt")).alias("filename"))
    chunks = docs.select("document_id", "content_hash", F.explode(F.split("text", "\n")))
    return registry.registered(names, docs.drop("text"), chunks)


def scope_errors(s, d):
    """F1 over orders as requests."""
    scope = F.element_at(F.array(*[F.lit(x) for x in SCOPES]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    hashed = F.when(F.col("o_custkey") % 2 == 0, F.md5(F.col("o_custkey").cast("string")))
    ids = F.array_repeat(F.lit("d"), (F.col("o_custkey") % 3).cast("int"))
    return I.table(s, d, "orders").select("o_orderkey", grounding.scope_error(scope, hashed, ids, F.col("o_orderkey") % 28, F.col("o_custkey") % 12).alias("error"))


def tree_counts(s, d):
    """Pages and labelled nodes of trees built from parts; one node quotes a label in its text."""
    node = lambda label: F.struct(F.lit(label).alias("label")) if isinstance(label, str) else F.struct(label.alias("label"))
    quoted = F.struct(F.lit('"label":"table"').alias("text"), F.struct(F.array(node("TABLE"), node("chart")).alias("deep")).alias("more"))
    tree = F.to_json(F.struct(F.array_repeat(F.struct("p_size"), F.col("p_size")).alias("pages"), node(F.col("p_type")).alias("body"), node("Table Item").alias("tail"), quoted.alias("rest")))
    return I.table(s, d, "part").select("p_partkey", io.tree_pages(tree).alias("n_pages"), io.tree_labels(tree, NODE_LABELS).alias("n_labels"))


QUERIES = {f.__name__: f for f in (visual_texts, table_texts, grounding_prompts, answer_outcomes, retrieval_modes, rerank_fallback, registered_files, scope_errors, tree_counts)}

_PAGES = "CASE WHEN a = 0 THEN NULL WHEN b <> 0 AND a <> b THEN a || '-' || b ELSE a::VARCHAR END"
_PARTS = f"pp AS (SELECT *, {_PAGES} AS pg FROM (SELECT *, p_size % 7 AS a, p_size % 5 AS b FROM part))"
_SHOWN = "CASE WHEN p_partkey % 3 = 0 THEN 'Figure Label: ' || p_brand END, CASE WHEN p_partkey % 2 = 0 THEN 'Caption: ' || p_type END, 'Nearby Text: ' || left(repeat(p_name, 90), {0})"
_SCOPE = "CASE o_orderkey % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'doc_ids' WHEN 2 THEN 'all' ELSE 'some' END"

SQL = {
    "visual_texts": f"""WITH {_PARTS} SELECT p_partkey, rtrim(concat_ws(chr(10), 'Document: ' || p_name, 'Page: ' || coalesce(pg, 'unknown'), 'Visual Type: picture', 'Section: ' || p_type, {_SHOWN.format(500)})) AS embedded,
concat_ws(chr(10), CASE WHEN p_partkey % 2 = 0 THEN p_type END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, p_type, repeat(p_name, 90), p_name) AS words, 'V1' AS citation_id,
rtrim(concat_ws(chr(10), 'Document: ' || p_name, 'Page: ' || coalesce(pg, 'unknown'), 'Visual ID: ' || p_partkey, 'Visual Type: picture', 'Readiness: good', 'Section: ' || p_type, {_SHOWN.format(800)})) AS metadata_text,
'visual:' || p_partkey || ', ' || p_name || ', ' || CASE WHEN pg IS NULL THEN 'page unknown' WHEN contains(pg, '-') THEN 'pages ' || pg ELSE 'page ' || pg END AS source FROM pp""",
    "table_texts": f"""WITH {_PARTS} SELECT p_partkey, concat_ws(chr(10), 'Document: ' || p_name, 'Page: ' || coalesce(pg, 'unknown'), 'Section: ' || p_type, 'Evidence Type: ' || CASE WHEN p_partkey % 2 = 0 THEN 'structured table' ELSE 'table-like text' END, 'Readiness: good',
CASE WHEN p_size % 2 = 0 THEN 'Table Title: ' || p_brand END, CASE WHEN p_partkey % 2 = 0 THEN 'Headers: ' || p_name || ', ' || p_brand || chr(10) || 'Rows:' || repeat(chr(10) || p_type || ' | ' || p_type, least(80, p_size + 60)::BIGINT) ELSE 'Detected table-like text:' || chr(10) || p_type END) AS text FROM pp""",
    "grounding_prompts": f"""WITH {evaluation._HITS}, e AS (SELECT query_id, citation, kind, substr(citation, 2)::INT AS n, text, 'file ' || doc_id AS source FROM lab JOIN documents USING (doc_id)),
two AS (SELECT query_id FROM e WHERE citation = 'T2' AND query_id % 4 = 0),
f AS (SELECT query_id, kind, n, '[' || citation || '] Source: ' || source || chr(10) || CASE WHEN kind = 'table' AND query_id IN (SELECT * FROM two) THEN 'Two is more than one.' || chr(10) || chr(10) || 'Supporting table evidence:' || chr(10) ELSE '' END || text AS item
  FROM e WHERE kind <> 'table' OR n = 2 OR query_id NOT IN (SELECT * FROM two)),
g AS (SELECT query_id, kind, upper(left(kind, 1)) || substr(kind, 2) || ' evidence:' || chr(10) || string_agg(item, chr(10) || chr(10) ORDER BY n) AS sec FROM f GROUP BY query_id, kind),
z AS (SELECT query_id, string_agg(sec, chr(10) || chr(10) ORDER BY kind = 'visual', kind = 'table') AS prompt FROM g GROUP BY 1) SELECT query_id, md5(prompt) AS prompt_md5, length(prompt)::INT AS n_chars FROM z""",
    "answer_outcomes": f"""WITH {retrieval._bm25_sql()}, first AS (SELECT query_id, doc_id FROM ranked WHERE rank = 1 AND score >= 30),
b AS (SELECT item_id AS query_id, item_id % 4 AS v, item_id % 8 = 1 AS rev, doc_id FROM benchmark LEFT JOIN first ON item_id = query_id)
SELECT query_id, CASE WHEN doc_id IS NULL THEN CASE query_id % 3 WHEN 1 THEN '{grounding.NO_TABLES}' WHEN 2 THEN '{grounding.NO_VISUALS}' ELSE '{grounding.NO_EVIDENCE}' END WHEN v = 0 THEN '{grounding.NO_EVIDENCE}' WHEN rev THEN 'In part [C1].' ELSE 'See document ' || doc_id || ' [C1].' END AS answer,
CASE WHEN doc_id IS NULL THEN 'no_evidence' WHEN v = 0 THEN 'unsupported' WHEN v = 1 THEN 'partially_supported' WHEN v = 2 THEN 'supported' ELSE 'unchecked' END AS status FROM b""",
    "retrieval_modes": f"""SELECT 'dense' AS mode, query_id, rank, id, score FROM (WITH {retrieval._cos_sql()} SELECT query_id, rank, vec_id::BIGINT AS id, score FROM cr WHERE rank <= 5)
UNION ALL SELECT 'bm25', query_id, rank, id, score FROM (WITH {retrieval._bm25_sql()} SELECT query_id, rank, doc_id::BIGINT AS id, score FROM ranked WHERE rank <= 5)
UNION ALL SELECT 'hybrid', query_id, rank, id, hybrid_score FROM ({retrieval._hybrid_sql(0.6, 0.4, 5)})""",
    "rerank_fallback": f"""WITH {retrieval._bm25_sql()}, x AS (SELECT r.query_id, r.doc_id, r.rank AS pre_rank, length(d.text)::DOUBLE AS len, length(b.text) % 3 = 0 AS failed FROM ranked r JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE r.rank <= 20),
o AS (SELECT query_id, doc_id, pre_rank, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE -len END, pre_rank))::INT AS rank, CASE WHEN NOT failed THEN len END AS rerank_score, CASE WHEN failed THEN 'failed' ELSE 'applied' END AS status FROM x) SELECT * FROM o WHERE rank <= 5""",
    "registered_files": """WITH n AS (SELECT doc_id, doc_id || '.txt' AS filename FROM documents WHERE doc_id % 100 = 0), d AS (SELECT doc_id AS document_id, md5(text) AS content_hash, 'corpus/' || source || '/' || doc_id || '.txt' AS source_path, len(string_split(text, chr(10))) AS lines FROM documents),
f AS (SELECT n.doc_id, min(document_id) AS document_id FROM n JOIN d ON ends_with(source_path, filename) GROUP BY 1) SELECT n.doc_id, filename, document_id, content_hash, coalesce(lines, 0)::BIGINT AS indexed_chunk_count FROM n LEFT JOIN f USING (doc_id) LEFT JOIN d USING (document_id)""",
    "scope_errors": f"""SELECT o_orderkey, CASE WHEN {_SCOPE} = 'some' THEN 'Unsupported query scope: some' WHEN o_orderkey % 28 NOT BETWEEN 1 AND 25 THEN 'max_documents must be between 1 and 25.' WHEN o_custkey % 12 NOT BETWEEN 1 AND 10 THEN 'max_evidence_per_document must be between 1 and 10.'
WHEN {_SCOPE} = 'single' AND o_custkey % 2 = 0 AND o_custkey % 3 > 0 THEN 'scope=''single'' accepts content_hash or one document identifier, not both.' WHEN {_SCOPE} = 'single' AND o_custkey % 2 = 1 AND o_custkey % 3 <> 1 THEN 'scope=''single'' requires content_hash or exactly one doc_id/document_id.'
WHEN {_SCOPE} = 'doc_ids' AND o_custkey % 2 = 0 THEN 'scope=''doc_ids'' does not accept content_hash.' WHEN {_SCOPE} = 'doc_ids' AND o_custkey % 3 = 0 THEN 'scope=''doc_ids'' requires doc_ids or document_ids.' WHEN {_SCOPE} = 'all' AND (o_custkey % 2 = 0 OR o_custkey % 3 > 0) THEN 'scope=''all'' cannot be combined with document filters.' END AS error FROM orders""",
    "tree_counts": "SELECT p_partkey, p_size AS n_pages, 2 + (lower(p_type) IN ('promo', 'economy'))::INT AS n_labels FROM part",
}
