"""Queries over the whole relations of table and visual evidence, and audits with parse trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import audit, evidence_records, tables
from lodestone.plans import inputs as I
from lodestone.plans import records


def table_records(s, d):
    """A statement of each customer's orders, with a pipe table on page 1, lines of figures on page 2 and a grid by year on page 3."""
    o = I.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("doc"), "o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("long").alias("price"), F.year("o_orderdate").alias("year"))
    rows = o.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "price"))).alias("r"))
    pipe = F.transform("r", lambda x: F.concat_ws("", F.lit("| "), x["o_orderkey"].cast("string"), F.lit(" | "), x["o_orderstatus"], F.lit(" |")))
    figures = F.transform("r", lambda x: F.concat_ws(" ", x["o_orderkey"].cast("string"), x["price"].cast("string"), "doc"))
    text = F.concat_ws("\n", F.lit("<!-- page 1 -->\n## Orders\n\n| Order | Status |\n|---|---:|"), F.array_join(pipe, "\n"), F.lit("\n<!-- page 2 -->\nFigures\n"), F.array_join(figures, "\n"))
    years = o.groupBy("doc", "year").agg(F.count("*").alias("n")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("year", "n"))).alias("y"))
    grid = F.concat(F.array(F.array(F.lit("Year"), F.lit("Orders"))), F.transform("y", lambda x: F.array(x["year"].cast("string"), x["n"].cast("string"))))
    grids = years.select("doc", F.lit(0).alias("ord"), F.lit(3).alias("page"), F.when(F.size("y") > 1, "Orders by year").otherwise("").alias("caption"), F.lit("Years").alias("heading"), F.array(F.lit(True)).alias("flags"), grid.alias("grid"))
    out = evidence_records.table_records(tables.lines(rows.withColumn("text", text), "doc", F.col("text")), grids)
    return out.withColumn("risk_flags", F.array_join("risk_flags", ",")).withColumn("markdown_table", F.sha2("markdown_table", 256)).drop("source_chunk_id")


def visual_records(s, d):
    """Conversations as documents, a message a page that begins with a figure's name; every second document's pictures have pages."""
    c = I.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    page = F.transform("m", lambda x, i: F.concat(F.lit("<!-- page "), (i + 1).cast("string"), F.lit(" -->\nFigure "), (i % 3 + 1).cast("string"), F.lit(": "), x["text"]))
    pictures = F.transform("m", lambda x, i: F.struct(F.when(i % 2 == 0, F.concat(F.lit("Chart "), (i + 1).cast("string"), F.lit(": "), x["text"])).otherwise(" ").alias("caption"), F.when(F.col("conv_id") % 2 == 0, (i + 1).cast("int")).alias("page")))
    docs = c.select(F.sha2(F.col("conv_id").cast("string"), 256).alias("content_hash"), pictures.alias("pictures"), F.size("m").alias("page_count"), F.lit(1).alias("figure_count"), F.lit("artifacts").alias("artifact_dir"), F.array_join(page, "\n").alias("markdown"))
    out = evidence_records.visual_records(docs)
    return out.withColumn("caption", F.sha2("caption", 256)).withColumn("nearby_text", F.sha2("nearby_text", 256)).drop("section_heading")


def audit_with_trees(s, d):
    """U1 with A9 and A10 from parse trees: a third of the documents has none, a third a broken one, the others one table and picture a line."""
    line = F.split("text", "\n")
    tree = F.to_json(F.struct(
        F.transform(line, lambda t, i: F.struct(F.array(F.struct((i % 3).cast("int").alias("page_no"))).alias("prov"))).alias("tables"),
        F.transform(line, lambda t, i: F.struct(F.array(F.struct(F.when(i % 2 == 1, t).otherwise("").alias("text"))).alias("captions"))).alias("pictures"),
    ))
    kind = F.col("doc_id") % 3
    trees = I.documents(s, d).select(F.col("doc_id").alias("content_hash"), F.when(kind == 1, tree).when(kind == 2, "{broken").alias("tree"), (kind > 0).alias("tree_expected"))
    out = audit.verdicts(audit.summary(records._audit_rows(s, d).join(trees, "content_hash")))
    return out.select("content_hash", "table_candidate_count", "table_like_page_count", "figure_candidate_count", "caption_candidate_count", "table_readiness", "visual_readiness", F.array_contains("risk_flags", "missing_docling_json").alias("tree_missing"))


QUERIES = {f.__name__: f for f in (table_records, visual_records, audit_with_trees)}

SQL = {
    "table_records": """WITH o AS (SELECT o_custkey::VARCHAR AS doc, o_orderkey AS k, o_orderstatus AS st, floor(o_totalprice)::BIGINT AS p, year(o_orderdate) AS y FROM orders),
c AS (SELECT doc, count(*)::INT AS n, '| Order | Status |' || chr(10) || '|---|---:|' || chr(10) || string_agg('| ' || k || ' | ' || st || ' |', chr(10) ORDER BY k, st, p) AS piped, string_agg(k || ' ' || p || ' ' || doc, chr(10) ORDER BY k, st, p) AS figures FROM o GROUP BY doc),
y AS (SELECT doc, count(*)::INT AS n, 'Year | Orders' || chr(10) || string_agg(y || ' | ' || m, chr(10) ORDER BY y) AS t, '| Year | Orders |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || y || ' | ' || m || ' |', chr(10) ORDER BY y) AS md FROM (SELECT doc, y, count(*) AS m FROM o GROUP BY ALL) GROUP BY doc),
r AS (SELECT doc, 'docling_table' AS source_kind, 3 AS page, CASE WHEN n > 1 THEN 'Orders by year' END AS title, 'Years' AS section_heading, t AS raw_text, md AS markdown_table, n AS n_rows, CASE WHEN n > 1 THEN 'good' ELSE 'weak' END AS readiness, CASE WHEN n = 1 THEN 'single_row_table' ELSE '' END AS risk_flags, 0 AS kind FROM y
UNION ALL SELECT doc, 'markdown_table', 1, 'Orders', 'Orders', piped, piped, n, 'good', CASE WHEN n = 1 THEN 'single_row_table' ELSE '' END, 1 FROM c
UNION ALL SELECT doc, 'text_pattern', 2, 'Figures', 'Figures', figures, NULL, n, 'weak', 'fallback_text_span', 2 FROM c WHERE n >= 3)
SELECT doc, kind AS table_index, CASE WHEN kind = 2 THEN doc[1:12] || ':table_text:0002:00' ELSE doc[1:12] || ':table:000' || kind END AS table_id, CASE WHEN kind = 2 THEN 'table_like_text' ELSE 'structured' END AS table_type, source_kind, page, title, section_heading,
raw_text, sha256(markdown_table) AS markdown_table, n_rows, CASE WHEN kind < 2 THEN 2 END AS n_cols, kind < 2 AS has_header, CASE WHEN kind < 2 THEN 0.0::DOUBLE END AS empty_cell_ratio, readiness, risk_flags, sha256(raw_text) AS span_hash FROM r""",
    "visual_records": r"""WITH m AS (SELECT conv_id, coalesce(text, '') AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(text, '')) - 1)::INT AS i FROM conversations),
g AS (SELECT conv_id, sha256(conv_id::VARCHAR) AS h, count(*)::INT AS n, string_agg('<!-- page ' || (i + 1) || ' -->' || chr(10) || 'Figure ' || (i % 3 + 1) || ': ' || text, chr(10) ORDER BY i) AS md FROM m GROUP BY conv_id),
p AS (SELECT h, n, i, i + 1 AS page, conv_id % 2 = 0 AS placed, sha256(regexp_replace('Figure ' || (i % 3 + 1) || ': ' || text, '^\s+|\s+$', '', 'g')[1:800]) AS near, CASE WHEN i % 2 = 0 THEN sha256(trim('Chart ' || (i + 1) || ': ' || text)) END AS cap FROM m JOIN g USING (conv_id)),
f AS (SELECT h, n, md, k, instr(md, 'Figure ' || k || ':')::INT AS pos FROM g, (SELECT unnest([1, 2, 3]) AS k) WHERE conv_id % 2 <> 0 AND k <= n)
SELECT h AS content_hash, i AS visual_index, h[1:12] || ':picture:' || lpad(i::VARCHAR, 4, '0') AS visual_id, 'docling_picture' AS source_kind, CASE WHEN placed THEN page END AS page, CASE WHEN placed THEN 'artifacts/visuals/pages/page_' || lpad(page::VARCHAR, 4, '0') || '.jpg' END AS artifact_path,
 cap AS caption, CASE WHEN i % 2 = 0 THEN 'Chart ' || (i + 1) END AS figure_label, CASE WHEN placed THEN near END AS nearby_text, CASE WHEN i % 2 = 0 THEN 'good' ELSE 'weak' END AS readiness, sha256(h || ':picture:' || i) AS span_hash FROM p
UNION ALL SELECT h, i, h[1:12] || ':page:' || lpad(page::VARCHAR, 4, '0'), 'page_render', page, 'artifacts/visuals/pages/page_' || lpad(page::VARCHAR, 4, '0') || '.jpg', NULL, NULL, near, 'weak', NULL FROM p
UNION ALL SELECT h, (2 * n + k - 1)::INT, h[1:12] || ':figcand:' || lpad((2 * n + k - 1)::VARCHAR, 4, '0'), 'text_reference', k, 'artifacts/visuals/pages/page_000' || k || '.jpg', NULL, 'Figure ' || k,
 sha256(regexp_replace(md[greatest(1, pos - 150):pos + 149], '^\s+|\s+$', '', 'g')), 'poor', sha256(h || ':figcand:Figure ' || k) FROM f""",
    "audit_with_trees": f"""WITH {records._SUMMARY}, x AS (SELECT doc_id, doc_id % 3 AS kind, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT doc_id, kind, len(l)::INT AS n, len(list_distinct(list_filter(list_transform(range(len(l)), lambda i: i % 3), lambda p: p > 0)))::INT AS pages, len(list_filter(range(len(l)), lambda i: i % 2 = 1 AND l[i + 1] <> ''))::INT AS caps FROM x),
u AS (SELECT w.content_hash, table_count, figure_count, fallback_used, kind, CASE WHEN kind = 1 THEN n ELSE table_candidate_count END AS table_candidate_count, CASE WHEN kind = 1 THEN pages ELSE table_like_page_count END AS table_like_page_count,
 CASE WHEN kind = 1 THEN n ELSE figure_candidate_count END AS figure_candidate_count, CASE WHEN kind = 1 THEN caps ELSE caption_candidate_count END AS caption_candidate_count FROM w JOIN t ON t.doc_id = w.content_hash)
SELECT content_hash, table_candidate_count, table_like_page_count, figure_candidate_count, caption_candidate_count,
CASE WHEN NOT fallback_used THEN CASE WHEN table_count >= 1 AND table_candidate_count >= 1 THEN 'good' ELSE 'weak' END WHEN table_candidate_count > 0 OR table_like_page_count > 0 THEN 'weak' ELSE 'poor' END AS table_readiness,
CASE WHEN fallback_used THEN 'poor' WHEN figure_count >= 1 AND caption_candidate_count >= 1 THEN 'good' WHEN figure_count >= 1 THEN 'weak' ELSE 'poor' END AS visual_readiness, kind = 2 AS tree_missing FROM u""",
}
