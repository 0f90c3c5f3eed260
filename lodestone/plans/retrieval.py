"""Queries over retrieval: tokens, BM25, cosine, fusion, limits, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import fusion, lexical, ranking, registry, vector, vector_index, word_index
from lodestone.plans import inputs as I
from lodestone.sources import stored

TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
SCOPE = ["src1", "src2", "src3"]
BOOST_QUESTION = "Compare the total revenue and net income of the segment with the highest assets in 2024"


def _post(s, d):
    return lexical.postings(I.table(s, d, "documents"), "doc_id", F.col("text"))


def tokenize_counts(s, d):
    t = tokens(F.col("text"))
    return I.table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def doc_frequency(s, d):
    return lexical.document_frequency(_post(s, d))


def _words(s, d, k, label=None, docs=None):
    """The k best documents of each benchmark question, by a stored inverted index of all documents, or of ``docs``."""
    index = word_index.build(I.table(s, d, "documents") if docs is None else docs, "doc_id", F.col("text"))
    hits = word_index.topk(index, I.questions(s, d), "query_id", F.col("question"), k)
    return lexical.ranked(hits.select("query_id", "id", "score"), k, label=label)


def bm25_topk(s, d):
    return _words(s, d, 10).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def bm25_appended_topk(s, d):
    """M4: an index of half of the documents, to which the other half is appended: the same hits as over all at once."""
    docs = I.table(s, d, "documents")
    index = word_index.build(docs.where("doc_id % 2 = 0"), "doc_id", F.col("text"))
    index = word_index.appended(index, docs.where("doc_id % 2 = 1"), "doc_id", F.col("text"), "1")
    hits = word_index.topk(index, I.questions(s, d), "query_id", F.col("question"), 10)
    return lexical.ranked(hits, 10).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def bm25_scoped_topk(s, d):
    docs = registry.in_scope(I.table(s, d, "documents"), "source", SCOPE)
    return _words(s, d, 10, docs=docs).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def bm25_batch_topk(s, d):
    return _words(s, d, 5, "C").select("query_id", "rank", F.col("id").alias("doc_id"), "score", "citation")


def bm25_boosted_topk(s, d):
    """Documents as tables, their first line as the heading; the boost alone can make a hit."""
    q = s.createDataFrame([(0, BOOST_QUESTION)], "query_id int, question string")
    docs = I.table(s, d, "documents")
    plain = lexical.bm25(docs, "doc_id", F.col("text"), q, "query_id", F.col("question")).select("id", F.col("score").alias("plain"))
    heading = F.substring_index("text", "\n", 1)
    boost = docs.select(F.col("doc_id").alias("id"), lexical.table_boost(F.lit(BOOST_QUESTION), F.col("text"), heading).alias("boost"))
    both = boost.join(plain, "id", "left").select(F.lit(0).alias("query_id"), "id", "boost", F.round(F.coalesce("plain", F.lit(0.0)) + F.col("boost"), 6).alias("score")).where("score > 0")
    return lexical.ranked(both, 20).select("rank", F.col("id").alias("doc_id"), "boost", "score")


def _asked(e):
    """Questions are the vectors whose id is divisible by 100, against all vectors."""
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def _cosine(s, d, k):
    e = I.table(s, d, "embeddings")
    q = _asked(e)
    return lexical.ranked(vector.cosine_topk(e, "vec_id", "embedding", q, "query_id", "qv", k), k)


def cosine_topk(s, d):
    return _cosine(s, d, 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def cosine_batch_topk(s, d):
    return _cosine(s, d, 10).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def vector_index_recall(s, d):
    """R7, approximate: an index of all vectors; of each question's ten exact hits, whether nine tenths are found."""
    e = I.table(s, d, "embeddings")
    index = vector_index.build(e, "vec_id", "embedding")
    found = lexical.ranked(vector_index.search(index, _asked(e), "query_id", "qv", e, "vec_id", "embedding", 10), 10)
    got = vector_index.recall(_cosine(s, d, 10), found)
    return got.select("hits", (F.col("recall") >= 0.9).alias("nine_tenths_found"))


def _sides(s, d, k):
    dense = _cosine(s, d, 2 * k)
    return dense, _words(s, d, 2 * k)


def minmax_normalize(s, d):
    dense = _cosine(s, d, 20)
    return dense.select("query_id", F.col("id").alias("vec_id"), F.round(fusion.min_max(F.col("score"), "query_id"), 6).alias("normalized"))


def hybrid_text(s, d):
    return fusion.hybrid(*_sides(s, d, 10), 10)


def hybrid_weighted(s, d):
    return fusion.hybrid(*_sides(s, d, 10), 10, 0.35, 0.65)


def _hits(s, d):
    """BM25 hits with the source of their document. Few hits meet all documents: written, their size is known to the join."""
    hits = stored.kept(_words(s, d, 50), "hits")
    return hits.join(I.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document")), "id")


def diversity_single_kind(s, d):
    out = ranking.diverse(_hits(s, d), 4, 2, 6)
    return out.select("query_id", "position", F.col("id").alias("doc_id"), "document", "score")


def diversity_multi_kind(s, d):
    hits = _hits(s, d).withColumn("kind", F.when(F.col("id") % 3 == 0, "table").when(F.col("id") % 3 == 1, "visual").otherwise("text"))
    return ranking.diverse_kinds(hits.select("query_id", "kind", "id", "document", "score", "rank"), {"text": 3, "table": 2, "visual": 2}, 4, 2)


def rerank_scores(s, d):
    hits = _words(s, d, 20).select("query_id", "id", "score", "rank")
    scores = hits.where("id % 2 = 0").select("query_id", "id", (F.col("id") % 17).cast("double").alias("rerank_score"))
    return ranking.reranked(hits, scores, 10).select("query_id", F.col("id").alias("doc_id"), "pre_rerank_rank", "post_rerank_rank", "rerank_score")


QUERIES = {f.__name__: f for f in (tokenize_counts, doc_frequency, bm25_topk, bm25_appended_topk, bm25_scoped_topk, bm25_batch_topk, bm25_boosted_topk, cosine_topk, cosine_batch_topk, vector_index_recall, minmax_normalize, hybrid_text, hybrid_weighted, diversity_single_kind, diversity_multi_kind, rerank_scores)}


def _bm25_sql(docs="documents", questions="benchmark"):
    return f"""
t AS (SELECT doc_id, unnest(ts) AS term, len(ts) AS dl FROM (SELECT doc_id, {TOK.format("text")} AS ts FROM {docs})),
p AS (SELECT doc_id, term, dl, count(*) AS tf FROM t GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM p)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, unnest({TOK.format("text")}) AS term FROM {questions}),
hits AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM hits WHERE score > 0)"""


def _cos_sql():
    return """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
cs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM cs)"""


def _hybrid_sql(a, b, k=10):
    return f"""WITH {_bm25_sql()}, {_cos_sql()},
dn AS (SELECT query_id, vec_id AS id, score, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n FROM cr WHERE rank <= {2 * k} WINDOW w AS (PARTITION BY query_id)),
ln AS (SELECT query_id, doc_id AS id, score, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n FROM ranked WHERE rank <= {2 * k} WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, dn.score AS dense_score, ln.score AS lexical_score, round({a}::DOUBLE * coalesce(dn.n, 0) + {b}::DOUBLE * coalesce(ln.n, 0), 6) AS hybrid_score, coalesce(dn.rank, {2 * k} + ln.rank) AS first FROM dn FULL JOIN ln USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, first, id)::INT AS rank FROM f)
SELECT query_id, rank, id, dense_score, lexical_score, hybrid_score FROM r WHERE rank <= {k}"""


def _boost_sql():
    from lodestone.functions import vocabulary as V

    q = BOOST_QUESTION.lower()
    terms = " + ".join(f"CASE WHEN contains(t, '{x}') THEN 1.5::DOUBLE ELSE 0 END" for x in V.BOOST_TERMS if x in q)
    segments = " OR ".join(f"contains(t, '{x}')" for x in V.BOOST_SEGMENTS)
    import re

    head = " + ".join(f"CASE WHEN contains(h, '{w}') THEN 0.5::DOUBLE ELSE 0 END" for w in re.findall("[a-z0-9]+", q) if len(w) >= 4)
    return f"""WITH {_bm25_sql(questions=f"(SELECT 0 AS item_id, '{BOOST_QUESTION}' AS text)")},
x AS (SELECT doc_id, lower(text) AS t, lower(split_part(text, chr(10), 1)) AS h FROM documents),
b AS (SELECT doc_id, CASE WHEN contains(t, '2024') THEN 2.0::DOUBLE ELSE 0 END + {terms} + CASE WHEN {segments} THEN 3.0::DOUBLE ELSE 0 END + {head} AS boost FROM x),
r AS (SELECT doc_id, boost, round(coalesce(score, 0) + boost, 6) AS score FROM b LEFT JOIN (SELECT doc_id, score FROM hits) USING (doc_id)),
o AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, boost, score FROM r WHERE score > 0) SELECT * FROM o WHERE rank <= 20"""


SQL = {
    "tokenize_counts": f"SELECT doc_id, len({TOK.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOK.format('text')}))::BIGINT AS n_distinct FROM documents",
    "doc_frequency": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term",
    "bm25_topk": f"WITH {_bm25_sql()} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10",
    "bm25_appended_topk": f"WITH {_bm25_sql()} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10",
    "bm25_scoped_topk": f"WITH sc AS (SELECT * FROM documents WHERE source IN ('src1', 'src2', 'src3')), {_bm25_sql('sc')} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10",
    "bm25_batch_topk": f"WITH {_bm25_sql()} SELECT query_id, rank, doc_id, score, 'C' || rank AS citation FROM ranked WHERE rank <= 5",
    "bm25_boosted_topk": _boost_sql(),
    "cosine_topk": f"WITH {_cos_sql()} SELECT query_id, rank, vec_id, score FROM cr WHERE rank <= 20",
    "cosine_batch_topk": f"WITH {_cos_sql()} SELECT query_id, rank, vec_id, score FROM cr WHERE rank <= 10",
    "vector_index_recall": f"WITH {_cos_sql()} SELECT count(*) AS hits, true AS nine_tenths_found FROM cr WHERE rank <= 10",
    "minmax_normalize": f"WITH {_cos_sql()}, k AS (SELECT * FROM cr WHERE rank <= 20) SELECT query_id, vec_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END AS normalized FROM k WINDOW w AS (PARTITION BY query_id)",
    "hybrid_text": _hybrid_sql(0.6, 0.4),
    "hybrid_weighted": _hybrid_sql(0.35, 0.65),
    "diversity_single_kind": f"""WITH {_bm25_sql()}, h AS (SELECT ranked.*, source AS document FROM ranked JOIN documents USING (doc_id) WHERE rank <= 50),
f AS (SELECT query_id, document, min(rank) AS fr FROM h GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fr) AS dr FROM f),
k AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, document ORDER BY rank) AS i FROM h JOIN g USING (query_id, document) WHERE dr <= 4),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS position FROM k WHERE i <= 2) SELECT query_id, position, doc_id, document, score FROM o WHERE position <= 6""",
    "rerank_scores": f"""WITH {_bm25_sql()}, h AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked WHERE rank <= 20),
x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 17)::DOUBLE ELSE (n - rank)::DOUBLE END AS rerank_score FROM h),
o AS (SELECT query_id, doc_id, rank AS pre_rerank_rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INT AS post_rerank_rank, rerank_score FROM x) SELECT * FROM o WHERE post_rerank_rank <= 10""",
}
