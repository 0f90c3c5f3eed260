"""What grows with the tables: plans without joins by value, bounded batches, compact postings."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import vector, vector_index, word_index
from lodestone.plans import answering, evidence_records
from lodestone.sources import stored

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_visual_texts_are_made_in_one_pass(spark):
    """Joined by id, the long texts were broadcast: Spark takes them for as small as the table that they are made from."""
    made = plan(answering.visual_texts(spark, DIR))
    assert "Join" not in made and "Exchange" not in made


def test_postings_are_small_and_stay_in_their_task(spark, monkeypatch):
    """Each posting had its document's id, number and length, and was shuffled, nearly a row each, to one of many shards."""
    monkeypatch.setattr(word_index, "RANGE", 4)
    docs = spark.range(300).select(F.col("id"), F.concat(F.lit("Ab, x"), F.col("id").cast("string"), F.lit(" \u0130stanbul\u212a ab")).alias("text"))
    index = word_index.build(docs, "id", F.col("text"))
    assert index.postings.columns == ["tag", "shard", "term", "places", "tfs"]
    assert "Exchange" not in plan(index.postings) and index.postings.groupBy("shard", "term").count().where("count > 1").count() == 0
    sizes = index.sizes.collect()
    assert max(r["n"] for r in sizes) <= 4 * word_index.STRETCH and sum(r["n"] for r in sizes) == 300 and index.documents.select(F.explode("ids")).distinct().count() == 300
    want = docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").count()
    got = index.postings.join(index.documents, ["tag", "shard"]).select("term", "ids", F.explode(F.arrays_zip("places", "tfs")).alias("p")).select(F.expr("ids[p.places]").alias("id"), "term", F.col("p.tfs").cast("long").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert int(spark.conf.get(stored.BATCHES)) <= stored.BATCH_BYTES


def peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scores_of_blocks_are_held_in_parts():
    """All scores of a block of questions with a block of items, and of all rows with all centroids, were held several times over."""
    draw = np.random.default_rng(1)
    q, items, ids = draw.normal(size=(500, 8)), draw.normal(size=(10_000, 8)), np.arange(10_000)
    (who, at, scores), mb = peak_mb(lambda: vector.best_pairs(q, items, ids, 5))
    assert mb < 60
    whole = vector.rounded(q @ items.T)
    assert all(list(at[who == n]) == list(vector.best_rows(ids, whole[n], 5)) for n in range(500)) and np.array_equal(scores, whole[who, at])
    near, mb = peak_mb(lambda: vector_index.nearest(items, q))
    far = (q * q).sum(axis=1)[None, :] - 2 * (items @ q.T)
    assert mb < 60 and np.array_equal(near[:, 0], far.argmin(axis=1))
    assert np.array_equal(vector_index.nearest(items, q, 3), np.argsort(far, axis=1, kind="stable")[:, :3])


def test_table_records_read_their_lines_once_written(spark):
    """Statements were made from orders, split by page and read for pipe tables several times over."""
    made = plan(evidence_records.table_records(spark, DIR))
    assert "orders.parquet" not in made and "Generate posexplode" not in made
