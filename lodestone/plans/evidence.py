"""Queries over chunks, tables, visuals, intents and table answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vocabulary as V
from lodestone.operators import chunking, reasoning, tables, visuals
from lodestone.plans import inputs as I

MOST, OVERLAP = 1200, 200


def text_blocks(s, d):
    return chunking.text_blocks(I.blocks(s, d)).select(F.col("content_hash").cast("long").alias("doc_id"), "ord", "label", "page", "text")


def long_block_split(s, d):
    b = chunking.text_blocks(I.blocks(s, d))
    out = b.select(F.col("content_hash").cast("long").alias("doc_id"), "ord", F.posexplode(chunking.split_long(F.col("text"), 300)).alias("piece", "text"))
    return out


def _chunks(s, d, most=MOST, overlap=OVERLAP):
    return chunking.document_chunks(I.blocks(s, d), most, overlap)


def chunk_pack(s, d):
    return _chunks(s, d, MOST, 0).select(F.col("content_hash").cast("long").alias("doc_id"), "chunk_index", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "page_start", "page_end")


def chunk_pack_overlap(s, d):
    """With the overlap carry of 200 characters; tested against a plain loop."""
    return _chunks(s, d).select(F.col("content_hash").cast("long").alias("doc_id"), "chunk_id", "chunk_index", "text", "page_start", "page_end")


def _lines(s, d):
    return tables.lines(I.report(s, d), "doc", F.col("markdown"))


def page_split(s, d):
    return tables.pages(_lines(s, d)).select("doc", "ord", "page", "line")


def pipe_tables(s, d):
    return tables.pipe_tables(_lines(s, d)).select("doc", "start", F.array_join("headers", "|").alias("headers"), F.array_join(F.flatten("rows"), "|").alias("cells"), "n_rows", "n_cols", "readiness")


def table_line_score(s, d):
    return _lines(s, d).select("doc", "ord", tables.line_score(F.col("line")).alias("score"))


def table_like_spans(s, d):
    return tables.spans(_lines(s, d))


def table_span_records(s, d):
    """X9."""
    return tables.span_records(_lines(s, d)).select("doc", "table_id", "page", "title", "raw_text", "n_rows", F.array_join("risk_flags", ",").alias("risk_flags"), "span_hash")


def table_evidence(s, d):
    """X14."""
    return tables.evidence(_lines(s, d))


def span_context(s, d):
    """X7 and X8 for every line."""
    return tables.look_behind(_lines(s, d))


def grid_tables(s, d):
    out = tables.grid_tables(I.nation_grids(s, d))
    return out.select("id", "has_header", F.array_join("headers", "|").alias("headers"), "n_rows", "n_cols", "readiness", "empty_cell_ratio", F.array_join("risk_flags", ",").alias("risk_flags"))


def dense_grids(s, d):
    """X1 from cell lists: nations of a region as cells, one row each, key and name as columns."""
    n = I.table(s, d, "nation")
    r = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    base = n.withColumn("r", r)
    one = lambda c, t: base.select(F.col("n_regionkey").alias("id"), F.col("r"), F.lit(c).alias("c"), (F.col("r") + 1).alias("r_end"), F.lit(c + 1).alias("c_end"), t.alias("text"))
    cells = one(0, F.col("n_nationkey").cast("string")).unionByName(one(1, F.col("n_name")))
    return tables.dense_grid(cells).select("id", F.size("grid").alias("n_rows"), F.array_join(F.flatten("grid"), "|").alias("cells"))


def _headings(s, d):
    """Section headers and short lines."""
    b = chunking.text_blocks(I.blocks(s, d))
    return b.where("label = 'section_header' OR length(text) <= 40").select(F.col("content_hash").alias("doc"), "ord", "page", "text")


def _items(s, d):
    return chunking.text_blocks(I.blocks(s, d)).select(F.col("content_hash").alias("doc"), F.col("ord").alias("id"), "page")


def nearest_heading_asof(s, d):
    return tables.heading_as_of(_items(s, d), _headings(s, d)).select(F.col("doc").cast("long").alias("doc"), "id", "page", "heading")


def nearest_chunk_interval(s, d):
    items = _items(s, d).select("doc", "id", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    out = tables.nearest_chunk(items, _chunks(s, d, MOST, 0))
    return out.select(F.col("doc").cast("long").alias("doc"), "id", "distance", "chunk_index")


def caption_refs(s, d):
    """Each conversation's messages as texts; an item refers to its first, a missing and its third message."""
    c = I.table(s, d, "conversations")
    texts = c.select(F.col("conv_id").alias("doc"), F.concat(F.lit("#/texts/"), F.col("turn").cast("string")).alias("self_ref"), F.col("turn").alias("ord"), "text")
    items = c.select(F.col("conv_id").alias("doc")).distinct().select("doc", F.lit(0).alias("id"), F.array(F.lit("#/texts/0"), F.lit("#/texts/99"), F.lit("#/texts/2")).alias("refs"))
    return tables.captions(items, texts)


TAILS = ["Which segment had the highest 2025 net income?", "What does the chart of revenue show?", "Is there a table of columns?", "See fig. 3 or fig.3 as shown in the graph", "plain words only", "total assets of 5 billion"]


def _intents(s, d):
    """Every benchmark passage, whole, with a question after it, so that every kind occurs."""
    pick = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("query_id") % len(TAILS) + 1).cast("int"))
    return I.questions(s, d).select("query_id", F.concat_ws(" ", "question", pick).alias("question"))


def table_intent(s, d):
    i = T.table_intent(F.col("question"))
    return _intents(s, d).select("query_id", i["detected"].alias("detected"), i["score"].alias("score"), F.array_join(i["matches"], ",").alias("matches"))


def visual_intent(s, d):
    i = T.visual_intent(F.col("question"))
    return _intents(s, d).select("query_id", i["detected"].alias("detected"), i["score"].alias("score"), F.array_join(i["matches"], ",").alias("matches"))


def evidence_router(s, d):
    p = I.table(s, d, "part")
    return p.select("p_partkey", T.evidence_mode(F.col("p_name"), F.when(F.col("p_size") % 5 == 0, "Paragraph").when(F.col("p_size") % 5 == 1, "Table lookup").when(F.col("p_size") % 5 == 2, "Mixed").when(F.col("p_size") % 5 == 3, "Chart")).alias("mode"))


ANSWERS = ["I don't have enough evidence.", "We can't determine this from [C1].", "The answer is 5 [c2] and [T1]; see [C2].", "I can’t answer that.", "It won't be provided: unable to determine."]


def _answers(s, d):
    c = I.table(s, d, "conversations")
    extra = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (F.col("conv_id") % len(ANSWERS) + 1).cast("int"))
    return c.select("conv_id", "turn", F.when(F.col("role") == "assistant", F.concat("text", F.lit(" "), extra)).otherwise(F.col("text")).alias("answer"))


def abstention_query(s, d):
    return _answers(s, d).select("conv_id", "turn", T.abstains_in_query(F.col("answer")).alias("abstains"))


def abstention_eval(s, d):
    return _answers(s, d).select("conv_id", "turn", T.abstains_in_evaluation(F.col("answer")).alias("abstains"))


def citation_ids(s, d):
    return _answers(s, d).select("conv_id", "turn", F.array_join(T.citation_ids(F.col("answer")), ",").alias("citations"))


CELLS = ["$27,761", "(425)", "32%", "-", "NM", "", "1e5", "abc", "(1,204", "12.50", "—", "$ 1,000.5"]


def numeric_parse(s, d):
    """Each part's key, size and names as cells of several forms, and one fixed cell."""
    fixed = F.element_at(F.array(*[F.lit(c) for c in CELLS]), (F.col("p_partkey") % len(CELLS) + 1).cast("int"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    cells = F.array(F.concat(F.lit("$ "), key, F.lit(","), F.lpad(size, 3, "0")), F.concat(F.lit("("), key, F.lit(")")), F.concat(size, F.lit(" %")), F.concat(key, F.lit("."), size), F.col("p_name"), F.col("p_brand"), fixed)
    return I.table(s, d, "part").select("p_partkey", F.posexplode(cells).alias("form", "cell")).select("p_partkey", "form", T.numeric(F.col("cell")).alias("value"))


def page_labels(s, d):
    l = I.table(s, d, "lineitem")
    a, b = F.col("l_linenumber") - 1, F.col("l_linenumber") + (F.col("l_orderkey") % 3).cast("int") - 1
    return l.select("l_orderkey", "l_linenumber", T.page_label(a, b).alias("pages")).distinct()


def evidence_texts(s, d):
    """Labelled lines of non-empty parts."""
    p = I.table(s, d, "part")
    part = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return p.select("p_partkey", T.joined("\n", F.concat(F.lit("Title: "), "p_name"), part, F.col("p_brand")).alias("text"))


def _questions(s, d):
    return s.createDataFrame([(0, "Which segment had the highest 2000 revenue?"), (1, "What was the lowest total net revenue in 2001?"), (2, "What was net income in 2000?"), (3, "Who wrote this?"), (4, "Total assets in 2000?")], "query_id int, question string")


def _retrieved(s, d):
    """All reports and one table of all segments as evidence of every question."""
    rep = I.report(s, d).withColumn("evidence_index", F.row_number().over(W.orderBy("doc")))
    text = rep.select(F.col("doc").alias("table_id"), "evidence_index", F.lit(None).cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"), F.lit("").alias("context"), F.col("markdown").alias("raw_text"))
    rev = I.revenue(s, d).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("year", "revenue"))).alias("y"))
    one = rev.groupBy().agg(F.array_sort(F.collect_list(F.struct("segment", "y"))).alias("a")).where("size(a) > 0")
    grid = one.select(F.lit("grid").alias("table_id"), F.lit(9).alias("evidence_index"), F.concat(F.array(F.lit("Segment")), F.transform(F.col("a")[0]["y"], lambda x: F.concat(F.lit("FY "), x["year"].cast("string")))).alias("headers"), F.transform("a", lambda x: F.concat(F.array(x["segment"]), F.transform(x["y"], lambda z: F.concat(F.lit("$"), F.format_number(z["revenue"], 0))))).alias("rows"), F.lit("Revenue by segment").alias("context"), F.lit("").alias("raw_text"))
    return _questions(s, d).select("query_id").join(text.unionByName(grid))


def structured_observations(s, d):
    return reasoning.structured(reasoning.asked(_questions(s, d), _retrieved(s, d)))


def simple_row_observations(s, d):
    return reasoning.distinct_observations(reasoning.simple_rows(reasoning.asked(_questions(s, d), _retrieved(s, d))))


MATRIX = "\n".join(
    [
        "Consumer & Community Banking Commercial & Investment Bank Asset & Wealth Management", "2025 2024 2025 2024 2025 2024", "Total net revenue 76,029 71,507 78,454 70,114 24,073 21,578",
        "Net income $ 18,245 $ 17,603 $ 27,761 $ 24,846 $ 6,522 $ 5,421", "Return on equity 32 % 32 % 18 % 18 % 40 % 34 %",
    ]
)


def matrix_observations(s, d):
    """A fixed report page with three segments by two years, asked for two metrics, once for each region."""
    r = I.table(s, d, "region").select(F.col("r_name").alias("table_id"), F.col("r_regionkey").alias("evidence_index"))
    q = s.createDataFrame([(0, "Which segment had the highest 2025 net income?"), (1, "Compare total net revenue in 2024")], "query_id int, question string")
    rows = q.select("query_id").join(r).withColumn("raw_text", F.lit(MATRIX))
    return reasoning.matrix(reasoning.asked(q, rows))


def select_extremum(s, d):
    q, t = _questions(s, d), _retrieved(s, d)
    return reasoning.selected(reasoning.structured(reasoning.asked(q, t)), q)


def table_answers(s, d):
    return reasoning.answers(_questions(s, d), _retrieved(s, d))


def page_renders(s, d):
    docs = I.blocks(s, d).select(F.sha2("content_hash", 256).alias("content_hash"), F.lit("artifacts").alias("artifact_dir"), F.coalesce(F.array_max("blocks.page"), F.lit(0)).alias("page_count"))
    return visuals.page_renders(docs)


def picture_records(s, d):
    """Conversations as documents, their messages as pictures captioned by every other text's first 60 characters."""
    c = I.table(s, d, "conversations")
    p = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Figure "), F.col("turn").cast("string"), F.lit(": "), F.substring("text", 1, 60))).otherwise("").alias("caption"), (F.col("turn") + 1).cast("int").alias("page")))).alias("pictures"))
    return visuals.pictures(p.select(F.sha2(F.col("conv_id").cast("string"), 256).alias("content_hash"), "pictures")).select("visual_id", "page", "figure_label", F.length("caption").alias("caption_chars"), "readiness")


def figure_candidates(s, d):
    docs = I.report(s, d).select(F.col("doc").alias("content_hash"), "markdown", F.lit(1).alias("figure_count"), F.lit(0).alias("pictures_with_page"))
    return visuals.figure_candidates(docs).select("content_hash", "label", "page")


QUERIES = {f.__name__: f for f in (text_blocks, long_block_split, chunk_pack, chunk_pack_overlap, page_split, pipe_tables, table_line_score, table_like_spans, table_span_records, table_evidence, span_context, grid_tables, dense_grids, nearest_heading_asof, nearest_chunk_interval, caption_refs, table_intent, visual_intent, evidence_router, abstention_query, abstention_eval, citation_ids, numeric_parse, page_labels, evidence_texts, structured_observations, simple_row_observations, matrix_observations, select_extremum, table_answers, page_renders, picture_records, figure_candidates)}

_BLOCKS = r"""b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
blk AS (SELECT doc_id, ord::INT AS ord, CASE WHEN ord = 0 THEN 'section_header' ELSE 'text' END AS label, (ord // 10 + 1)::INT AS page, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM b),
blocks AS (SELECT * FROM blk WHERE text <> '')"""
_PACKED = """packed AS (SELECT doc_id, list_reduce(list({{'l': length(text), 'n': 0, 'id': 0, 'ids': []::INT[], 'i': ord}} ORDER BY ord), lambda a, x: {{'l': x.l, 'n': CASE WHEN a.n > 0 AND a.n + x.l + 2 > {most} THEN x.l + 2 ELSE a.n + x.l + 2 END,
  'id': CASE WHEN a.n > 0 AND a.n + x.l + 2 > {most} THEN a.id + 1 ELSE a.id END, 'ids': list_append(a.ids, CASE WHEN a.n > 0 AND a.n + x.l + 2 > {most} THEN a.id + 1 ELSE a.id END), 'i': x.i}}, {{'l': 0, 'n': 0, 'id': 0, 'ids': []::INT[], 'i': 0}}) AS st, list(ord ORDER BY ord) AS ords FROM {blocks} GROUP BY doc_id)"""
# pieces of long blocks, numbered within their document
_SPLIT = """sp AS (SELECT doc_id, ord, label, page, text, CASE WHEN length(text) <= {most} THEN [text] ELSE list_transform(range(0, 0), lambda i: '') END AS whole, string_split(text, ' ') AS w FROM blocks),
fold AS (SELECT doc_id, ord, label, page, whole, CASE WHEN len(whole) > 0 THEN NULL ELSE list_reduce(list_transform(w, lambda x: {{'x': x, 'cur': '', 'out': []::VARCHAR[]}}), lambda a, b: {{'x': b.x, 'cur': CASE WHEN a.cur = '' OR length(a.cur) + length(b.x) + 1 > {most} THEN b.x ELSE a.cur || ' ' || b.x END,
  'out': CASE WHEN a.cur <> '' AND length(a.cur) + length(b.x) + 1 > {most} THEN list_append(a.out, a.cur) ELSE a.out END}}, {{'x': '', 'cur': '', 'out': []::VARCHAR[]}}) END AS st FROM sp),
pcs AS (SELECT doc_id, ord, label, page, CASE WHEN len(whole) > 0 THEN whole WHEN st.cur <> '' THEN list_append(st.out, st.cur) ELSE st.out END AS ps FROM fold),
pieces AS (SELECT doc_id, ord, label, page, generate_subscripts(ps, 1) - 1 AS piece, unnest(ps) AS text FROM pcs)"""
_FIN = " OR ".join(f"contains(lower(line), '{t}')" for t in V.FINANCIAL_TERMS)
_SCORE = rf"""(CASE WHEN len(regexp_extract_all(line, '{V.LINE_NUMBER}')) >= 3 THEN 3 WHEN len(regexp_extract_all(line, '{V.LINE_NUMBER}')) >= 1 THEN 1 ELSE 0 END
 + CASE WHEN len(regexp_extract_all(line, '{V.YEAR}')) >= 2 THEN 2 ELSE 0 END + CASE WHEN contains(line, '$') OR contains(line, '%') OR contains(lower(line), 'billion') OR contains(lower(line), 'million') THEN 1 ELSE 0 END
 + CASE WHEN {_FIN} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(line, '[0-9]\s{{2,}}[0-9]') THEN 1 ELSE 0 END)::INT"""
_PAGES = r"""pg AS (SELECT *, try_cast(nullif(regexp_extract(line, '(?i)^\s*(?:<!--\s*page\s+([0-9]+)\s*-->|#\s*Page\s+([0-9]+))\s*$', 1), '') AS INT) AS marker FROM lines),
pages AS (SELECT doc, ord, line, marker, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord) AS page FROM pg)"""


def _pick(values, key):
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values)) + " END"


def _intent_sql(parts, detected):
    return f"""WITH q AS (SELECT item_id AS query_id, lower(concat_ws(' ', text, {_pick(TAILS, "item_id")})) AS q FROM benchmark), p AS (SELECT query_id, q, {parts} FROM q)
SELECT query_id, {detected} AS detected, len(m)::INT AS score, array_to_string(m, ',') AS matches FROM p"""


def _phrases(col, contractions, phrases, curly):
    x = f"lower(translate({col}, '’‘', ''''''))" if curly else f"lower({col})"
    for a, b in contractions:
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return " OR ".join(f"contains({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases)


_RECORDS = rf"""{I.REPORT_SQL}, {_PAGES},
sec AS (SELECT * FROM (SELECT *, count(marker) OVER (PARTITION BY doc ORDER BY ord) AS section FROM pages) WHERE marker IS NULL),
sc AS (SELECT *, {_SCORE} AS score, trim(lag(line) OVER (PARTITION BY doc, section ORDER BY ord)) = '' AS bb FROM sec),
hi AS (SELECT *, ord - lag(ord) OVER (PARTITION BY doc, section ORDER BY ord) AS gap FROM sc WHERE score >= 3),
il AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 OR (gap = 2 AND bb) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, section ORDER BY ord) AS island FROM hi),
sp AS (SELECT doc, section, min(ord) AS f, max(ord) AS l FROM il GROUP BY doc, section, island HAVING count(*) >= 2 AND max(ord) - min(ord) + 1 >= 3),
st AS (SELECT sp.doc, sp.section, f, l, greatest(f - 7, min(b.ord), coalesce(max(b.ord) FILTER (WHERE b.ord < f AND b.ord >= f - 7 AND (trim(b.line) = '' OR (length(trim(b.line)) > 140 AND NOT ({_FIN.replace("line", "b.line")})))) + 1, 0)) AS s FROM sp JOIN sec b ON b.doc = sp.doc AND b.section = sp.section GROUP BY sp.doc, sp.section, f, l),
tx AS (SELECT st.doc, st.section, s, f, any_value(b.page) AS page, trim(string_agg(b.line, chr(10) ORDER BY b.ord) FILTER (WHERE b.ord BETWEEN s AND l), ' ' || chr(9) || chr(10) || chr(13)) AS raw_text,
  arg_max(trim(regexp_replace(trim(b.line), '^#+|#+$', '', 'g')), b.ord) FILTER (WHERE b.ord < s AND b.ord >= s - 9 AND trim(b.line, ' #') <> '' AND length(trim(b.line, ' #')) <= 120 AND NOT regexp_matches(b.line, '[0-9]')) AS title FROM st JOIN sec b ON b.doc = st.doc AND b.section = st.section GROUP BY st.doc, st.section, s, f, l),
ra AS (SELECT *, len(string_split(raw_text, chr(10)))::INT AS n_rows, sha256(raw_text) AS span_hash FROM tx WHERE length(raw_text) <= 10000),
un AS (SELECT * FROM ra WHERE n_rows >= 3 QUALIFY row_number() OVER (PARTITION BY doc, span_hash ORDER BY f) = 1)"""
_ANSWERS = f"a AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text || ' ' || {_pick(ANSWERS, 'conv_id')} ELSE text END AS answer FROM conversations)"
_BARE = r"trim(regexp_replace(trim(c), '[$,%()]', '', 'g'))"

SQL = {
    "text_blocks": f"WITH {_BLOCKS} SELECT doc_id, ord, label, page, text FROM blocks",
    "long_block_split": f"WITH {_BLOCKS}, {_SPLIT.format(most=300)} SELECT doc_id, ord, piece::INT AS piece, text FROM pieces",
    "chunk_pack": f"""WITH {_BLOCKS}, {_SPLIT.format(most=MOST)}, num AS (SELECT doc_id, label, page, text, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, piece))::INT AS ord FROM pieces),
{_PACKED.format(most=MOST, blocks="num")}, placed AS (SELECT doc_id, unnest(ords) AS ord, unnest(st.ids) AS chunk_index FROM packed),
c AS (SELECT n.doc_id, chunk_index, string_agg(CASE WHEN label = 'section_header' THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY n.ord) AS text, min(page) AS page_start, max(page) AS page_end FROM num n JOIN placed ON n.doc_id = placed.doc_id AND n.ord = placed.ord GROUP BY ALL)
SELECT doc_id, chunk_index, length(text)::INT AS n_chars, sha256(text) AS text_sha256, page_start, page_end FROM c""",
    "page_split": f"WITH {I.REPORT_SQL}, {_PAGES} SELECT doc, ord::INT AS ord, page, line FROM pages WHERE marker IS NULL",
    "pipe_tables": f"""WITH {I.REPORT_SQL} SELECT segment AS doc, 6 AS start, 'Metric|' || array_to_string(ys, '|') AS headers, 'Revenue|' || array_to_string(vs, '|') AS cells, 1 AS n_rows, (len(ys) + 1)::INT AS n_cols, 'good' AS readiness FROM reps""".replace("6 AS start", "5 AS start"),
    "table_line_score": f"WITH {I.REPORT_SQL} SELECT doc, ord::INT AS ord, {_SCORE} AS score FROM lines",
    "table_like_spans": f"""WITH {I.REPORT_SQL}, sc AS (SELECT *, {_SCORE} AS score, trim(lag(line) OVER (PARTITION BY doc ORDER BY ord)) = '' AS bb FROM lines),
h AS (SELECT *, ord - lag(ord) OVER (PARTITION BY doc ORDER BY ord) AS gap FROM sc WHERE score >= 3),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 OR (gap = 2 AND bb) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS island FROM h)
SELECT doc, min(ord)::INT AS first, max(ord)::INT AS last, count(*) AS highs FROM i GROUP BY doc, island HAVING count(*) >= 2 AND max(ord) - min(ord) + 1 >= 3""",
    "table_span_records": f"""WITH {_RECORDS} SELECT doc, doc[1:12] || ':table_text:' || lpad(coalesce(page, 0)::VARCHAR, 4, '0') || ':' || lpad((row_number() OVER (PARTITION BY doc, coalesce(page, 0) ORDER BY f) - 1)::VARCHAR, 2, '0') AS table_id, page, title, raw_text, n_rows,
'fallback_text_span' || CASE WHEN (SELECT count(marker) FROM pages p WHERE p.doc = un.doc) = 0 THEN ',missing_page_markers' ELSE '' END AS risk_flags, span_hash FROM un""",
    "table_evidence": f"""WITH {_RECORDS}, al AS (SELECT segment AS doc, 'markdown' AS source_kind, 5 AS start, 1 AS n_rows, 'good' AS readiness FROM reps UNION ALL SELECT doc, 'text_pattern', s::INT, n_rows, 'weak' FROM un)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY source_kind, start) - 1)::INT AS table_index, source_kind, start, n_rows, readiness FROM al""",
    "span_context": rf"""WITH {I.REPORT_SQL}, f AS (SELECT a.doc, a.ord, max(b.ord) AS stop FROM lines a LEFT JOIN lines b ON a.doc = b.doc AND b.ord < a.ord AND b.ord >= a.ord - 7 AND (trim(b.line) = '' OR (length(trim(b.line)) > 140 AND NOT ({_FIN.replace("line", "b.line")}))) GROUP BY ALL),
n AS (SELECT doc, ord, trim(regexp_replace(trim(line), '^#+|#+$', '', 'g')) AS line FROM lines),
h AS (SELECT a.doc, a.ord, arg_max(b.line, b.ord) AS heading FROM lines a JOIN n b ON a.doc = b.doc AND b.ord < a.ord AND b.ord >= a.ord - 9 AND b.line <> '' AND length(b.line) <= 120 AND NOT regexp_matches(b.line, '[0-9]') GROUP BY ALL)
SELECT f.doc, f.ord::INT AS ord, greatest(0, f.ord - 7, coalesce(f.stop + 1, 0))::INT AS span_start, heading FROM f LEFT JOIN h ON f.doc = h.doc AND f.ord = h.ord""",
    "grid_tables": """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
g AS (SELECT r_name AS id, count(*)::INT AS n_rows, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END + CASE WHEN s.n IS NULL THEN 1 ELSE 0 END) AS blank FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey GROUP BY 1)
SELECT id, true AS has_header, 'Nation|Customers|Suppliers' AS headers, n_rows, 3 AS n_cols, CASE WHEN n_rows >= 2 THEN 'good' ELSE 'weak' END AS readiness, round(blank / (3 * (n_rows + 1))::DOUBLE, 6) AS empty_cell_ratio,
CASE WHEN blank / (3 * (n_rows + 1))::DOUBLE > 0.35 THEN 'many_empty_cells' || CASE WHEN n_rows <= 1 THEN ',single_row_table' ELSE '' END WHEN n_rows <= 1 THEN 'single_row_table' ELSE '' END AS risk_flags FROM g""",
    "dense_grids": "SELECT n_regionkey AS id, count(*)::INT AS n_rows, string_agg(n_nationkey || '|' || n_name, '|' ORDER BY n_nationkey) AS cells FROM nation GROUP BY 1",
    "nearest_heading_asof": f"""WITH {_BLOCKS}, h AS (SELECT doc_id, ord, page, text FROM blocks WHERE label = 'section_header' OR length(text) <= 40), i AS (SELECT * FROM blocks)
SELECT i.doc_id AS doc, i.ord AS id, i.page, arg_max(h.text, h.ord) AS heading FROM i LEFT JOIN h ON h.doc_id = i.doc_id AND h.page <= i.page GROUP BY ALL""",
    "nearest_chunk_interval": f"""WITH {_BLOCKS}, {_SPLIT.format(most=MOST)}, num AS (SELECT doc_id, label, page, text, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, piece))::INT AS ord FROM pieces),
{_PACKED.format(most=MOST, blocks="num")}, placed AS (SELECT doc_id, unnest(ords) AS ord, unnest(st.ids) AS chunk_index FROM packed),
c AS (SELECT n.doc_id, chunk_index, min(page) AS ps, max(page) AS pe FROM num n JOIN placed ON n.doc_id = placed.doc_id AND n.ord = placed.ord GROUP BY ALL),
i AS (SELECT doc_id, ord, page FROM blocks), x AS (SELECT i.doc_id AS doc, i.ord AS id, greatest(0, page - pe, ps - page) AS distance, chunk_index FROM i JOIN c ON i.doc_id = c.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY distance, chunk_index) AS n FROM x) SELECT doc, id, distance::INT AS distance, chunk_index FROM r WHERE n = 1""",
    "caption_refs": "SELECT conv_id AS doc, 0 AS id, concat_ws(' ', max(text) FILTER (WHERE turn = 0), max(text) FILTER (WHERE turn = 2)) AS caption FROM conversations GROUP BY 1",
    "table_intent": _intent_sql(rf"list_filter({V.TABLE_WORDS}, lambda t: regexp_matches(q, '\b' || t || 's?\b')) AS e, list_sort(list_distinct(regexp_extract_all(q, '\b20[0-9][0-9]\b|\$|%|\bbillion\b|\bmillion\b'))) AS n, list_filter({V.TABLE_FINANCIAL}, lambda t: contains(q, t)) AS f, list_concat(list_concat(e, n), f) AS m", "(len(e) > 0 OR (len(n) > 0 AND len(f) > 0))"),
    "visual_intent": _intent_sql(rf"list_filter({V.VISUAL_TERMS}, lambda t: regexp_matches(q, '\b' || replace(t, '.', '\.') || 's?\b')) AS m", f"(list_has_any(m, {V.VISUAL_EXPLICIT}) OR (list_contains(m, 'shown') AND (contains(q, 'chart') OR contains(q, 'figure') OR contains(q, 'graph'))))"),
    "evidence_router": """WITH x AS (SELECT p_partkey, lower(concat_ws(' ', p_name, CASE p_size % 5 WHEN 0 THEN 'Paragraph' WHEN 1 THEN 'Table lookup' WHEN 2 THEN 'Mixed' WHEN 3 THEN 'Chart' END)) AS t FROM part)
SELECT p_partkey, CASE WHEN contains(t, 'mixed') THEN 'auto' WHEN contains(t, 'chart') OR contains(t, 'visual') OR contains(t, 'figure') OR contains(t, 'image') OR contains(t, 'graph') THEN 'visual' WHEN contains(t, 'table') THEN 'table' ELSE 'text' END AS mode FROM x""",
    "abstention_query": f"WITH {_ANSWERS} SELECT conv_id, turn, ({_phrases('answer', V.QUERY_CONTRACTIONS, V.QUERY_ABSTENTIONS, False)}) AS abstains FROM a",
    "abstention_eval": f"WITH {_ANSWERS} SELECT conv_id, turn, ({_phrases('answer', V.EVAL_CONTRACTIONS, V.EVAL_ABSTENTIONS, True)}) AS abstains FROM a",
    "citation_ids": f"WITH {_ANSWERS} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '(?i)\\[([CTV][0-9]+)\\]', 1), lambda x: upper(x)))), ',') AS citations FROM a",
    "numeric_parse": rf"""WITH y AS (SELECT p_partkey, ['$ ' || p_partkey || ',' || lpad(p_size::VARCHAR, 3, '0'), '(' || p_partkey || ')', p_size || ' %', p_partkey || '.' || p_size, p_name, p_brand, {_pick(CELLS, "p_partkey")}] AS cs FROM part),
x AS (SELECT p_partkey, (generate_subscripts(cs, 1) - 1)::INT AS form, unnest(cs) AS c FROM y)
SELECT p_partkey, form, CASE WHEN upper(trim(c)) IN ('', '-', '—', 'NA', 'NM') THEN NULL WHEN NOT regexp_matches({_BARE}, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN NULL
 WHEN starts_with(trim(c), '(') AND ends_with(trim(c), ')') THEN -try_cast({_BARE} AS DOUBLE) ELSE try_cast({_BARE} AS DOUBLE) END AS value FROM x""",
    "page_labels": """WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, nullif(l_linenumber - 1, 0) AS a, nullif(l_linenumber + l_orderkey % 3 - 1, 0) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a <> b THEN a || '-' || b ELSE coalesce(coalesce(a, b)::VARCHAR, 'unknown') END AS pages FROM x""",
    "evidence_texts": "SELECT p_partkey, concat_ws(chr(10), 'Title: ' || p_name, CASE WHEN p_size % 2 = 0 THEN nullif(p_type, '') END, nullif(p_brand, '')) AS text FROM part",
    "structured_observations": f"""WITH {I.REVENUE_SQL}, q(query_id, y, metric) AS (VALUES (0, 2000, 'revenue'), (1, 2001, 'total net revenue'), (2, 2000, 'net income'), (4, 2000, 'assets'))
SELECT query_id, 'grid' AS table_id, 9 AS evidence_index, segment AS label, metric, y::INT AS year, revenue::DOUBLE AS value, '$' || format('{{:,}}', revenue) AS display_value, NULL::VARCHAR AS unit FROM q JOIN rev ON year = y AND contains('revenue by segment', metric)""",
    "simple_row_observations": f"""WITH {I.REVENUE_SQL}, d AS (SELECT segment, (row_number() OVER (ORDER BY segment))::INT AS i FROM (SELECT DISTINCT segment FROM rev)),
q(query_id, y, metric) AS (VALUES (0, 2000, 'revenue'), (1, 2001, 'total net revenue'), (2, 2000, 'net income')), l(metric, label, m) AS (VALUES ('revenue', 'Revenue', 0), ('revenue', 'Total net revenue', 0), ('total net revenue', 'Total net revenue', 0), ('net income', 'Net income', 1000)),
x AS (SELECT query_id, segment AS table_id, i AS evidence_index, label, metric, y, CASE WHEN m > 0 THEN revenue % m ELSE revenue END AS v FROM q JOIN l USING (metric) JOIN (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY year) AS nth FROM rev) ON nth = y - 1999 JOIN d USING (segment))
SELECT query_id, table_id, evidence_index, label, metric, y::INT AS year, v::DOUBLE AS value, '$' || format('{{:,}}', v) || ' million' AS display_value, 'million' AS unit FROM x""",
    "matrix_observations": """WITH q(query_id, metric, y, a, b, c) AS (VALUES (0, 'net income', 2025, 18245, 27761, 6522), (1, 'total net revenue', 2024, 71507, 70114, 21578)),
v AS (SELECT query_id, metric, y, unnest(['Consumer & Community Banking', 'Commercial & Investment Bank', 'Asset & Wealth Management']) AS label, unnest([a, b, c]) AS n FROM q)
SELECT query_id, r_name AS table_id, r_regionkey AS evidence_index, label, metric, y::INT AS year, n::DOUBLE AS value, '$' || format('{:,}', n) AS display_value, NULL::VARCHAR AS unit FROM v, region""",
    "select_extremum": f"""WITH {I.REVENUE_SQL} SELECT 0 AS query_id, segment AS label, revenue::DOUBLE AS value, '$' || format('{{:,}}', revenue) AS display_value, 'grid' AS table_id, 9 AS evidence_index FROM rev WHERE year = 2000 QUALIFY row_number() OVER (ORDER BY revenue DESC, segment) = 1""",
    "page_renders": """WITH p AS (SELECT sha256(doc_id::VARCHAR) AS content_hash, unnest(range(1, (len(string_split(text, chr(10))) - 1) // 10 + 2)) AS page FROM documents)
SELECT content_hash, content_hash[1:12] || ':page:' || lpad(page::VARCHAR, 4, '0') AS visual_id, page::INT AS page, 'artifacts/visuals/pages/page_' || lpad(page::VARCHAR, 4, '0') || '.jpg' AS image_path, 'weak' AS readiness FROM p""",
    "picture_records": """SELECT sha256(conv_id::VARCHAR)[1:12] || ':picture:' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR, 4, '0') AS visual_id, (turn + 1)::INT AS page, CASE WHEN turn % 2 = 0 THEN 'Figure ' || turn END AS figure_label,
CASE WHEN turn % 2 = 0 THEN length(trim('Figure ' || turn || ': ' || text[1:60]))::INT END AS caption_chars, CASE WHEN turn % 2 = 0 THEN 'good' ELSE 'weak' END AS readiness FROM conversations""",
    "figure_candidates": f"WITH {I.REVENUE_SQL} SELECT DISTINCT segment AS content_hash, unnest(['Figure 1', 'Chart 2']) AS label, 2 AS page FROM rev",
}
