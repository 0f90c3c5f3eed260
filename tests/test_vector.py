"""Exact and approximate vector search."""

import math
import random

import numpy as np

from lodestone.operators import lexical, vector, vector_index

INF, NAN = float("inf"), float("nan")


def brute(items, questions, k):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.sqrt((v * v).sum())

    out = []
    for q, qv in questions:
        u = unit(qv)
        if q is None or u is None:
            continue
        scores = [(-float(vector.rounded(np.array([unit(v) @ u]))[0]), i) for i, v in items if i is not None and unit(v) is not None and len(v) == len(qv)]
        out += [(q, i, -s) for s, i in sorted(scores)[:k]]
    return sorted(out)


def both(spark, items, questions, k, **options):
    frames = [spark.createDataFrame(rows, "id long, v array<double>, query_id long") for rows in ([(i, v, 1) for i, v in items], [(i, v, 2) for i, v in questions])]
    got = lexical.ranked(vector.cosine_topk(frames[0], "id", "v", frames[1], "id", "v", k, **options), k).collect()
    assert sorted((r["query_id"], r["id"], r["score"]) for r in got) == brute(items, questions, k)


def test_vectors_that_take_no_part(spark):
    items = [(1, [NAN, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [INF, 0.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1e-200, 0.0]), (11, [1e300, 1e300]), (12, [1.0])]
    questions = [(1, [1.0, 0.0]), (2, [NAN, 1.0]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 2.0, 0.0]), (5, [0.0])]
    both(spark, items, questions, 2)
    both(spark, items, questions, 20)
    both(spark, [], questions, 2)
    both(spark, items, [], 2)


def test_blocks_ties_and_repeats(spark):
    draw = random.Random(1)
    items = [(draw.randint(0, 40), [draw.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for _ in range(80)]
    questions = [(i, [draw.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(11)]
    both(spark, items, questions, 5, item_rows=7, question_rows=3)


def clustered(n, size=12, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, size))
    return [(i, [float(x) for x in centres[i % 9] + draw.normal(size=size) * 0.3]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def hits(spark, index, items, questions, k):
    return lexical.ranked(vector_index.search(index, frame(spark, questions), "id", "v", frame(spark, items), "id", "v", k), k)


def test_index_finds_nine_tenths(spark, tmp_path):
    items = clustered(1500)
    table, questions = frame(spark, items), items[::40]
    exact = lexical.ranked(vector.cosine_topk(table, "id", "v", frame(spark, questions), "id", "v", 10), 10)
    index = vector_index.build(table, "id", "v", block_rows=50)
    assert index.probes < len(index.centroids) and index.blocks.count() >= 1500 / 50
    assert sum(len(r["ids"]) for r in index.blocks.collect()) == 1500
    row = vector_index.recall(exact, hits(spark, index, items, questions, 10)).first()
    assert row["hits"] == 10 * len(questions) and row["recall"] >= 0.9
    index.probes = len(index.centroids)  # all lists: what is lost is lost to rounding
    assert vector_index.recall(exact, hits(spark, index, items, questions, 10)).first()["recall"] >= 0.99
    vector_index.saved(index, f"{tmp_path}/index")
    again = vector_index.loaded(spark, f"{tmp_path}/index")
    assert sorted(hits(spark, again, items, questions, 3).collect()) == sorted(hits(spark, index, items, questions, 3).collect())


def test_index_grows_and_its_edges(spark):
    items = [(i, v) for i, v in clustered(300)] + [(900, None), (None, [1.0] * 12), (901, [NAN] * 12), (902, [1.0]), (5, [2.0] * 12), (5, [2.0] * 12)]
    index = vector_index.build(frame(spark, items), "id", "v", lists=6, probes=6)
    more = [(1000 + i, v) for i, v in clustered(200, seed=5)]
    grown = vector_index.appended(index, frame(spark, more), "id", "v")
    every = items + more
    assert sum(len(r["ids"]) for r in grown.blocks.collect()) == 502
    questions = [(1, items[1][1]), (2, more[3][1]), (3, None), (4, [1.0])]
    got = hits(spark, grown, every, questions, 4).collect()
    assert {r["query_id"] for r in got} == {1, 2} and [r["id"] for r in got if r["rank"] == 1] == [1, 1003]
    empty = vector_index.build(frame(spark, []), "id", "v")
    assert hits(spark, empty, [], questions, 3).count() == 0
