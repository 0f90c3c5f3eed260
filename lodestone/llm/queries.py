"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import codebooks, exact_dedup, html_text, mixing, ngram_join, pieces, pii, quality, reply_trees, runs, suffix_index, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    convs = reply_trees.conversations(reply_trees.chained(rows.unionByName(extra)))
    return reply_trees.digests(convs)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.systematic_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and a digest of the text that they decode to."""
    ids = pieces.encode(table(spark, sf_dir, "documents"), carry=["doc_id"])
    text = pieces.decode(ids, carry=["doc_id", "n_chunks", "ids"])
    return text.select("doc_id", "n_chunks", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).drop("class_size")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_index.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = codebooks.trained_codes(table(spark, sf_dir, "embeddings"))
    rows = codebooks.label_errors(codes)
    return rows.select(F.col("id").alias("vec_id"), codebooks.code(F.col("entry")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.word_runs(runs.with_periods(table(spark, sf_dir, "documents")))
    best = runs.strongest(F.col("runs"))
    rows = rows.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), runs.listed(F.col("runs")).alias("listed"), "collapsed")
    milli = F.expr("(1000 * best.length) div best.period")
    return rows.select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP2_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.place, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.place <> c.place),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, place ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM o
"""

OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before,
             (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS w_all FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before)::DOUBLE / (w_all - w_before) AS lv, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM c),
m AS (SELECT *, arg_min(lv, place) FILTER (WHERE lv <= cap / w) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM t),
n AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1)::DOUBLE AS i FROM d)
SELECT n.doc_id, n.size, r.source_size, r.target,
       ((floor((i + 1) * rate + u) - floor(i * rate + u)) * n.size)::BIGINT AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g)::BIGINT AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n_shingles + b.n_shingles - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS at FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.at)
SELECT n.doc_id, n.n_shingles, min(r.at) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, p, md5(b[p + 1 : p + 200]) AS h FROM (SELECT r, b, unnest(range(octet_length(b) - 199)) AS p FROM d WHERE octet_length(b) >= 200)),
a AS (SELECT r, p FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
m AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM a),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM m),
s AS (SELECT r, k, min(p) AS x, max(p) + 200 AS y FROM n GROUP BY ALL),
g AS (SELECT r, coalesce(lag(y) OVER (PARTITION BY r ORDER BY x), 0) AS x, x AS y FROM s UNION ALL SELECT r, max(y), NULL FROM s GROUP BY r),
k AS (SELECT r, string_agg(hex(b[g.x + 1 : coalesce(g.y, octet_length(b))]), '' ORDER BY g.x) AS kept FROM g JOIN d USING (r) GROUP BY r),
t AS (SELECT r, sum(y - x)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN k USING (r)
"""


def _op12_sql(rounds: int = 4) -> str:
    """The rounds written out one after the other; distances and sums are whole numbers throughout."""
    near = """a{k} AS (SELECT p.place, p.part, arg_min(c.j, struct_pack(d := list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x), j := c.j)) AS j,
  min(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x))::BIGINT AS d FROM p JOIN c{k} c USING (part) GROUP BY ALL)"""
    move = """s{k} AS (SELECT part, j, pos, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, j, unnest(x)::BIGINT AS y, unnest(range(len(x))) AS pos FROM p JOIN a{k} USING (place, part)) GROUP BY ALL),
c{n} AS (SELECT c.part, c.j, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN
  (SELECT part, j, list((CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::DOUBLE ORDER BY pos) AS x FROM s{k} GROUP BY ALL) m USING (part, j))"""
    steps = ",\n".join(x for k in range(rounds) for x in (near.format(k=k), move.format(k=k, n=k + 1)))
    return f"""
WITH v AS (SELECT vec_id, label, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT place, vec_id, part, e[1 + part * (len(e) // 4) : (part + 1) * (len(e) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, x) - 1 AS j, x FROM p QUALIFY j < 256),
{steps},
{near.format(k=rounds)},
r AS (SELECT place, string_agg(lower(printf('%02x', j)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY place),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, j)) AS h FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (place), b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op2_exact_topk": op2_exact_topk, "op3_quality": op3_quality, "op4_html_text": op4_html_text, "op5_warc": op5_warc, "op6_reply_trees": op6_reply_trees, "op7_exact_dedup": op7_exact_dedup, "op8_sentencepiece": op8_sentencepiece, "op9_source_mixing": op9_source_mixing, "op10_ngram_jaccard": op10_ngram_jaccard, "op11_suffix_dedup": op11_suffix_dedup, "op12_vector_codes": op12_vector_codes, "op13_periodic_runs": op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op5_warc": OP5_SQL, "op6_reply_trees": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op9_source_mixing": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_suffix_dedup": OP11_SQL, "op12_vector_codes": _op12_sql()}
