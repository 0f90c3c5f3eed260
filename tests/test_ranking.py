import random

from pyspark.sql import functions as F

from lodestone.operators import evaluate, fusion, lexical, ranking, registry


def test_bm25_counts_repeated_words_and_drops_empty_texts(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, ""), (4, None)], "id int, text string")
    q = spark.createDataFrame([(0, "b"), (1, "b b"), (2, "zz")], "query_id int, q string")
    got = {(r["query_id"], r["id"]): r["score"] for r in lexical.bm25(d, "id", F.col("text"), q, "query_id", F.col("q")).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert abs(got[1, 1] - 2 * got[0, 1]) < 2e-6


def test_min_max_of_equal_scores_is_one_and_fusion_keeps_nulls(spark):
    d = spark.createDataFrame([(0, "a", 0.5, 1), (0, "b", 0.5, 2)], "query_id int, id string, score double, rank int")
    x = spark.createDataFrame([(0, "b", 9.0, 1), (0, "c", 1.0, 2)], "query_id int, id string, score double, rank int")
    got = [(r["id"], r["dense_score"], r["lexical_score"], r["hybrid_score"]) for r in fusion.hybrid(d, x, 5).orderBy("rank").collect()]
    assert got == [("b", 0.5, 9.0, 1.0), ("a", 0.5, None, 0.6), ("c", None, 1.0, 0.0)]


def test_single_kind_limit_is_the_greedy_one(spark):
    draw = random.Random(2)
    rows = [(q, f"i{n}", draw.choice("abcdef"), float(100 - n), n + 1) for q in range(30) for n in range(draw.randint(1, 20))]
    hits = spark.createDataFrame(rows, "query_id int, id string, document string, score double, rank int")
    got = {(r["query_id"], r["id"]) for r in ranking.diverse(hits, 3, 2, 5).collect()}
    want = set()
    for q in range(30):
        docs, n = {}, 0
        for _, i, doc, _, _ in [r for r in rows if r[0] == q]:
            if n < 5 and docs.get(doc, 0) < 2 and (doc in docs or len(docs) < 3):
                docs[doc] = docs.get(doc, 0) + 1
                n += 1
                want.add((q, i))
    assert got == want
    kinds = ranking.diverse_kinds(hits.withColumn("kind", F.lit("text")), {"text": 5}, 3, 2)
    assert {(r["query_id"], r["id"]) for r in kinds.collect()} == want


def test_rerank_and_pools(spark):
    h = spark.createDataFrame([(0, "a", 3.0, 1), (0, "b", 2.0, 2), (0, "c", 1.0, 3)], "query_id int, id string, score double, rank int")
    s = spark.createDataFrame([(0, "c", 9.0)], "query_id int, id string, rerank_score double")
    assert [r["id"] for r in ranking.reranked(h, s, 2).orderBy("post_rerank_rank").collect()] == ["c", "a"]
    assert ranking.pool_size(True, 5) == 50 and ranking.pool_size(False, 5, documents=10, per_document=3) == 30 and ranking.retry_size(12) == 8
    pairs = h.withColumn("question", F.lit("q")).withColumn("text", F.col("id"))
    got = {r["id"]: r["rerank_score"] for r in ranking.rerank_with(pairs, lambda: lambda p: [float(len(b)) for _, b in p], 2).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_registry(spark):
    cur = spark.createDataFrame([("h1", "old")], "content_hash string, v string")
    new = spark.createDataFrame([("h1", "n1", 2), ("h1", "n0", 1), ("h2", "n2", 3)], "content_hash string, v string, ord int")
    assert {tuple(r) for r in registry.upserted(cur, new).collect()} == {("h1", "n0"), ("h2", "n2")}
    assert registry.in_scope(cur, "content_hash", []).count() == 0 and registry.in_scope(cur, "content_hash", None).count() == 1


def test_nearest_rank(spark):
    d = spark.createDataFrame([([float(x) for x in range(1, 12)],), ([],)], "v array<double>")
    assert [r[0] for r in d.select(evaluate.nearest_rank(F.col("v"), 95)).collect()] == [11.0, None]


def test_nearest_ranks_equal_those_of_sorted_arrays(spark):
    groups = {"a": [float(i % 37) for i in range(500)], "b": [3.0], "c": [1.0, float("inf"), float("-inf"), 2.0], None: [5.0, 7.0, 7.0], "d": [1e300, -1e300, 0.0]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("e", None)]
    for bins in (1, 7, 4096):
        out = evaluate.nearest_ranks(spark.createDataFrame(rows, "k string, x double"), "k", "x", {"p95": 95, "p50": 50}, bins).collect()
        assert {r.k: (r.p95, r.p50) for r in out} == {"e": (None, None)} | {g: tuple(sorted(vs)[round(p * (len(vs) - 1))] for p in (0.95, 0.5)) for g, vs in groups.items()}
    assert evaluate.nearest_ranks(spark.createDataFrame([], "k string, x double"), "k", "x", {"p95": 95}).count() == 0


def test_cosine_blocks_give_what_one_block_gives(spark):
    from lodestone.operators import lexical, vector

    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    q = e.where("id < 9")
    get = lambda **k: sorted(map(tuple, lexical.ranked(vector.cosine_topk(e, "id", "v", q, "id", "v", 7, **k), 7).collect()))
    assert get() == get(item_rows=5, question_rows=2) and len(get()) == 63
    assert vector.cosine_topk(e.where("id < 0"), "id", "v", q, "id", "v", 7).count() == 0
