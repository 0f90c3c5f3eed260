"""Queries over the registry, scope, audits and index maintenance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import audit, registry
from lodestone.plans import inputs as I


def registry_latest(s, d):
    """Each document's newest job."""
    out = registry.latest(I.jobs(s, d), "document_id", [F.col("created_at").desc(), F.col("job_id").desc()])
    return out.select("document_id", "job_id", "status", "created_at")


def parsed_documents(s, d):
    """Customers as documents, orders as jobs; O is parsed, F is failed; an odd key has no artifact."""
    docs = I.table(s, d, "customer").select(F.col("c_custkey").alias("content_hash"), F.col("c_name").alias("filename"))
    o = I.table(s, d, "orders")
    jobs = o.select(F.col("o_custkey").alias("content_hash"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "parsed").otherwise("failed").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "x").alias("artifact"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("completed_at"))
    chunks = o.where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("content_hash"))
    return registry.parsed_documents(docs, jobs, chunks).select("content_hash", "filename", "job_id", "completed_at")


def modality_status(s, d):
    """The status of each user's kind of event as a modality."""
    e = I.jobs(s, d)
    counts = e.groupBy("document_id").agg(F.count_if(F.col("status") == "purchase").alias("count"))
    last = registry.latest(e, "document_id", [F.col("created_at").desc(), F.col("job_id").desc()]).select("document_id", F.when(F.col("job_id") % 5 == 0, "failed").when(F.col("job_id") % 5 == 1, "no_evidence").when(F.col("job_id") % 5 == 2, "indexed").alias("run"))
    both = last.join(counts, "document_id")
    return both.select("document_id", "count", registry.modality_status(F.col("run"), F.col("count") - 8).alias("status"))


def document_list_page(s, d):
    rows = I.documents(s, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"), "filename", "content_hash", "lang", F.col("doc_id").alias("n"))
    found = registry.matching(rows, "DOC_1", lang="en")
    return registry.page(found.select("n", "filename"), [F.col("filename"), F.col("n")], 10, 25)


def scope_all_semi(s, d):
    """Documents that have a label or a passage of three or more lines."""
    docs = I.documents(s, d).select(F.col("doc_id").alias("content_hash"), "filename")
    a = I.table(s, d, "labels").select(F.col("doc_id").alias("content_hash"))
    b = I.documents(s, d).where(F.size(F.split("text", "\n")) >= 3).select(F.col("doc_id").alias("content_hash"))
    return registry.scope_all(docs, a, b)


def scope_selected(s, d):
    """Hits with the nation of their supplier, where the scope has it."""
    l = I.table(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("content_hash"), "l_orderkey", "l_linenumber", F.lit("none").alias("doc_id"), F.lit("none").alias("document_id"))
    scope = I.table(s, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("content_hash"), F.col("s_name").alias("doc_id"), F.col("s_nationkey").cast("string").alias("document_id"))
    return registry.enriched(l, scope, True).groupBy("doc_id", "document_id").agg(F.count("*").alias("n"))


def doc_id_reverse_map(s, d):
    docs = I.documents(s, d).select(F.col("doc_id").alias("content_hash"), F.concat(F.lit("C:\\data\\up/Doc_"), (F.col("doc_id") % 40).cast("string"), F.lit(".PDF")).alias("source_path"))
    names = I.table(s, d, "nation").select(F.concat(F.lit("doc-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("doc_id"), F.concat(F.lit("doc_"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("filename"), F.col("n_nationkey").alias("ord"))
    return registry.reverse_ids(docs, names)


def doc_id_resolve(s, d):
    docs = I.table(s, d, "supplier").select(F.col("s_suppkey").alias("content_hash"), F.concat(F.lit("in/Doc_"), (F.col("s_suppkey") % 30).cast("string"), F.lit(".pdf")).alias("source_path"))
    names = I.table(s, d, "nation").select(F.col("n_name").alias("doc_id"), F.concat(F.lit("doc_"), (F.col("n_nationkey") * 3).cast("string"), F.lit(".pdf")).alias("filename"))
    return registry.resolve_ids(names, docs)


def rows_per_document(s, d):
    """A1."""
    return I.jobs(s, d).groupBy("document_id").agg(F.count("*").alias("n"))


def upsert_documents(s, d):
    """M1: all documents arrive, equal texts twice; those of src1 and the benchmark's passages are known already, and the latter stay as they are unless they arrive."""
    rows = I.documents(s, d).select("content_hash", F.col("doc_id").alias("ord"), "lang", F.col("doc_id").alias("first_id"))
    known = I.documents(s, d).where("source = 'src1'").select("content_hash").unionByName(I.table(s, d, "benchmark").select(F.sha2("text", 256).alias("content_hash"))).distinct()
    return registry.upserted(known.select("content_hash", F.lit("old").alias("lang"), F.lit(-1).cast("long").alias("first_id")), rows)


def index_pending(s, d):
    docs = I.documents(s, d).select(F.col("doc_id").alias("content_hash"), "lang")
    runs = I.jobs(s, d).select(F.col("document_id").alias("content_hash"), F.lit("text").alias("index_name"), F.when(F.col("status") == "click", "indexed").when(F.col("status") == "view", "no_evidence").otherwise("failed").alias("status"))
    return registry.pending(docs, runs, "text")


def cascade_delete(s, d):
    """M8: what is left of orders and their lines once two segments' customers are gone."""
    gone = I.table(s, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("o_custkey"))
    o = registry.without(I.table(s, d, "orders"), gone, "o_custkey")
    l = I.table(s, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return o.groupBy().agg(F.count("*").alias("rows")).withColumn("table", F.lit("orders")).unionByName(l.groupBy().agg(F.count("*").alias("rows")).withColumn("table", F.lit("lineitem")))


def collection_stats(s, d):
    """Rows and vectors by label."""
    e = I.table(s, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNotNull()).alias("vectors"), F.max(F.size("embedding")).alias("dim"))


def _audit_rows(s, d):
    """Documents as markdown: a page comment before every tenth line, and every fifth document's pages blank."""
    doc = I.documents(s, d)
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.when(i % 10 == 0, F.concat(F.lit("<!-- page "), (F.floor(i / 10) + 1).cast("string"), F.lit(" -->\n"))).otherwise(""), F.when((F.col("doc_id") % 5 == 0) & (i % 20 >= 10), "").otherwise(t)))
    err = F.when(F.col("doc_id") % 4 == 1, F.array(F.struct(F.lit("parser_selection").alias("type"), F.lit("auto").alias("stage")))).when(F.col("doc_id") % 4 == 2, F.array(F.struct(F.lit("x").alias("type"), F.lit("docling_primary_parser").alias("stage")))).otherwise(F.array().cast("array<struct<type:string,stage:string>>"))
    return doc.select(F.col("doc_id").alias("content_hash"), F.array_join(lines, "\n").alias("markdown"), F.ceil(F.size(F.split("text", "\n")) / 10).cast("int").alias("page_count"), (F.col("doc_id") % 3).cast("int").alias("table_count"), (F.col("doc_id") % 2).cast("int").alias("figure_count"), F.when(F.col("doc_id") % 8 == 0, "docling").otherwise("pypdfium2-text").alias("parser"), err.alias("errors"), F.length("text").alias("chunk_count"))


def fallback_detect(s, d):
    f = audit.fallback(F.col("parser"), F.col("errors"))
    return _audit_rows(s, d).select("content_hash", f["used"].alias("used"), f["reason"].alias("reason"))


def audit_summary(s, d):
    return audit.summary(_audit_rows(s, d))


def audit_verdicts(s, d):
    out = audit.verdicts(audit.summary(_audit_rows(s, d)))
    return out.select("content_hash", "text_readiness", "table_readiness", "visual_readiness", "quality_status", F.array_join("risk_flags", ",").alias("risk_flags"))


def audit_latest(s, d):
    """U8: audits keep their history; the newest of a document is the latest."""
    rows = I.jobs(s, d).where("status = 'error' OR value > 50")
    n = F.row_number().over(W.partitionBy("document_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc()))
    return rows.select("document_id", "job_id", (n == 1).alias("is_latest"))


QUERIES = {f.__name__: f for f in (registry_latest, parsed_documents, modality_status, document_list_page, scope_all_semi, scope_selected, doc_id_reverse_map, doc_id_resolve, rows_per_document, upsert_documents, index_pending, cascade_delete, collection_stats, fallback_detect, audit_summary, audit_verdicts, audit_latest)}

_LATEST = "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
_FALLBACK = "CASE doc_id % 4 WHEN 1 THEN 'size_threshold' WHEN 2 THEN 'docling_failed' ELSE 'manual_backend' END"
_SUMMARY = r"""l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT doc_id, i, CASE WHEN doc_id % 5 = 0 AND i % 20 >= 10 THEN '' ELSE t END AS t FROM l),
p AS (SELECT doc_id, i // 10 AS page, length(regexp_replace(string_agg(t, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g')) AS n, sum(CASE WHEN regexp_matches(t, '\S+(?:[ \t]{2,}|\t)\S+') THEN 1 ELSE 0 END) AS likely,
  sum(len(regexp_extract_all(t, '(?i)\b(?:figure|fig\.?|chart|diagram|exhibit)\b'))) AS refs, sum(len(regexp_extract_all(t, '(?i)\b(?:figure|fig\.?|chart|exhibit)\s*[0-9]+'))) AS caps FROM m GROUP BY ALL),
su AS (SELECT doc_id AS content_hash, count(*)::INT AS page_count, (doc_id % 3)::INT AS table_count, (sum(CASE WHEN likely >= 3 THEN 1 ELSE 0 END))::INT AS table_like_page_count, (doc_id % 2)::INT AS figure_count,
  sum(refs)::INT AS figure_candidate_count, sum(caps)::INT AS caption_candidate_count, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END)::INT AS empty_page_count, sum(n)::BIGINT AS text_chars_total,
  round_even(sum(n) / count(*) FILTER (WHERE n > 0)::DOUBLE, 1) AS avg_chars_per_page, CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS parse_error_count, doc_id % 8 <> 0 AS fallback_used FROM p GROUP BY doc_id),
summary AS (SELECT su.*, CASE WHEN table_like_page_count > 0 THEN greatest(table_like_page_count // 2, 1) ELSE 0 END::INT AS table_candidate_count, length(text)::INT AS chunk_count, CASE WHEN fallback_used THEN """ + _FALLBACK + """ END AS fallback_reason FROM su JOIN documents ON doc_id = content_hash),
v AS (SELECT *, empty_page_count / greatest(page_count, 1)::DOUBLE AS er FROM summary),
w AS (SELECT *, CASE WHEN er > 0.30 OR avg_chars_per_page < 50 THEN 'poor' WHEN er > 0.05 OR avg_chars_per_page < 200 THEN 'weak' ELSE 'good' END AS text_readiness,
  CASE WHEN NOT fallback_used THEN CASE WHEN table_count >= 1 AND table_candidate_count >= 1 THEN 'good' ELSE 'weak' END WHEN table_candidate_count > 0 OR table_like_page_count > 0 THEN 'weak' ELSE 'poor' END AS table_readiness,
  CASE WHEN fallback_used THEN 'poor' WHEN figure_count >= 1 AND caption_candidate_count >= 1 THEN 'good' WHEN figure_count >= 1 THEN 'weak' ELSE 'poor' END AS visual_readiness FROM v)"""

SQL = {
    "registry_latest": f"SELECT user_id AS document_id, event_id AS job_id, event_type AS status, ts AS created_at FROM ({_LATEST})",
    "parsed_documents": """WITH j AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS done FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0)
SELECT c_custkey AS content_hash, c_name AS filename, o_orderkey AS job_id, done AS completed_at FROM customer JOIN j ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY done DESC NULLS LAST, o_orderkey) = 1""",
    "modality_status": f"""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY 1), r AS (SELECT user_id, event_id % 5 AS m FROM ({_LATEST}))
SELECT user_id AS document_id, n AS count, CASE WHEN m = 0 THEN 'failed' WHEN n - 8 > 0 THEN 'indexed' WHEN m = 1 THEN 'not_available' WHEN m > 2 THEN 'not_indexed' ELSE 'unknown' END AS status FROM c JOIN r USING (user_id)""",
    "document_list_page": "WITH f AS (SELECT doc_id AS n, 'doc_' || doc_id || '.pdf' AS filename FROM documents WHERE lang = 'en' AND contains(lower('doc-' || doc_id || ' doc_' || doc_id || '.pdf ' || sha256(text)), 'doc_1')) SELECT n, filename, (SELECT count(*) FROM f) AS total FROM f ORDER BY filename, n LIMIT 25 OFFSET 10",
    "scope_all_semi": "SELECT doc_id AS content_hash, 'doc_' || doc_id || '.pdf' AS filename FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR len(string_split(text, chr(10))) >= 3",
    "scope_selected": "SELECT coalesce(s_name, 'none') AS doc_id, coalesce(s_nationkey::VARCHAR, 'none') AS document_id, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 10) ON s_suppkey = l_suppkey GROUP BY ALL",
    "doc_id_reverse_map": "SELECT doc_id AS content_hash, CASE WHEN doc_id % 40 < 25 THEN 'doc-' || lpad((doc_id % 40)::VARCHAR, 3, '0') END AS doc_id FROM documents",
    "doc_id_resolve": """WITH x AS (SELECT n_name, count(s_suppkey) AS n, min(s_suppkey) AS h FROM nation LEFT JOIN supplier ON s_suppkey % 30 = n_nationkey * 3 GROUP BY 1)
SELECT n_name AS doc_id, n, h AS content_hash, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM x""",
    "rows_per_document": "SELECT user_id AS document_id, count(*) AS n FROM events GROUP BY 1",
    "upsert_documents": """WITH d AS (SELECT sha256(text) AS content_hash, doc_id, lang, source FROM documents), i AS (SELECT content_hash, lang, doc_id AS first_id FROM d QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1)
SELECT * FROM i UNION ALL SELECT DISTINCT content_hash, 'old', -1 FROM (SELECT content_hash FROM d WHERE source = 'src1' UNION ALL SELECT sha256(text) FROM benchmark) WHERE content_hash NOT IN (SELECT content_hash FROM i)""",
    "index_pending": "SELECT doc_id AS content_hash, lang FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type IN ('click', 'view'))",
    "cascade_delete": """WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')))
SELECT count(*) AS rows, 'orders' AS "table" FROM o UNION ALL SELECT count(*), 'lineitem' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""",
    "collection_stats": "SELECT label, count(*) AS n, count(embedding) AS vectors, max(len(embedding))::INT AS dim FROM embeddings GROUP BY 1",
    "fallback_detect": f"SELECT doc_id AS content_hash, doc_id % 8 <> 0 AS used, CASE WHEN doc_id % 8 <> 0 THEN {_FALLBACK} END AS reason FROM documents",
    "audit_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "audit_verdicts": f"""WITH {_SUMMARY} SELECT content_hash, text_readiness, table_readiness, visual_readiness,
CASE WHEN text_readiness = 'good' AND table_readiness = 'good' AND visual_readiness = 'good' THEN 'good' WHEN text_readiness = 'poor' OR (table_readiness = 'poor' AND visual_readiness = 'poor') THEN 'poor' ELSE 'weak' END AS quality_status,
concat_ws(',', CASE WHEN fallback_used THEN 'fallback_parser_used' END, CASE WHEN table_count = 0 AND table_candidate_count = 0 THEN 'no_structured_tables' WHEN table_count = 0 THEN 'table_like_text_without_structure' END,
 CASE WHEN figure_count = 0 AND figure_candidate_count = 0 THEN 'no_figures' END, CASE WHEN er > 0.10 THEN 'high_empty_page_ratio' END, CASE WHEN parse_error_count > 0 THEN 'parse_errors_present' END,
 CASE WHEN avg_chars_per_page < 100 THEN 'low_text_density' END, CASE WHEN page_count > 200 THEN 'large_document' END, CASE WHEN chunk_count > 1000 THEN 'high_chunk_count' END) AS risk_flags FROM w""",
    "audit_latest": "SELECT user_id AS document_id, event_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM events WHERE event_type = 'error' OR value > 50",
}
