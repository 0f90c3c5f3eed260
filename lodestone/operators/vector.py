"""Exact cosine search (R7): unit vectors in blocks; each block of items meets the blocks of questions as products of matrices.

Defined results: vectors that are null or empty, hold a null or a non-finite component, or have no direction take no part, and
neither do rows with a null id. Questions meet the items that have as many components as they do, and no others. Rows that repeat
an item's id are items of their own; rows that repeat a question's id ask once more, and ``lexical.ranked`` ranks all of an id's
hits together. Of equal scores the smaller id comes first. Without questions or items there are no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.stored import small_batches

PLACES = 6
CELLS = 1 << 20  #: scores that a worker holds at once, about


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """A vector of length 1 and the same direction; null where there is none. Components are brought near 1 first, so that neither
    very large nor very small ones lose it."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.when(finite, v)
    v = _over(v, F.array_max(F.transform(v, lambda x: F.abs(x))))
    return _over(v, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)))


def _over(v: Column, by: Column) -> Column:
    """Each component over one number, which is found once; null where that isn't positive."""
    return F.when(by > 0, F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, b: x / b))


def rounded(scores: np.ndarray) -> np.ndarray:
    """To ``PLACES``, halves away from zero, as SQL rounds."""
    scores = scores * 10**PLACES
    return np.trunc(scores + np.copysign(0.5, scores)) / 10**PLACES


def in_blocks(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """(id, v) to a row a block: name, size of its vectors, ids, and their components one after the other."""
    each = rows.withColumn(name, block).withColumn("size", F.size("v")).groupBy(name, "size").agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return each.select(name, "size", F.col("r.id").alias(f"{name}_ids"), F.flatten("r.v").alias(f"{name}_data"))


def matrix(cell: pa.ListScalar, size: int) -> np.ndarray:
    return np.asarray(cell.values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def best_rows(ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of a row of scores, ties to the smaller id."""
    near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
    return near[np.lexsort((ids[near], -row[near]))][:k]


def slices(rows: int, width: int) -> Iterator[slice]:
    """Stretches of rows whose products with ``width`` others have about ``CELLS`` cells."""
    step = max(1, CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def best_pairs(questions: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of questions, of their ``k`` best items, and the scores; some questions at a time."""
    who, at, best = [], [], []
    for part in slices(len(questions), len(items)):
        scores = rounded(questions[part] @ items.T)
        near = [best_rows(ids, row, k) for row in scores]
        own = np.repeat(np.arange(len(near)), [len(n) for n in near])
        who.append(own + part.start)
        at.append(np.concatenate(near))
        best.append(scores[own, at[-1]])
    return np.concatenate(who), np.concatenate(at), np.concatenate(best)


def cosine_topk(items: DataFrame, id_col: str, vector_col: str, questions: DataFrame, query_id: str, query_vector: str, k: int, item_rows: int = 10_000, question_rows: int = 500) -> DataFrame:
    """(query_id, id, score): for each block of items, the k best of each question by (score, id); ``lexical.ranked`` picks among blocks.

    Items move once, to their block; only blocks of questions, a stated set, are sent to every block of items. A pair of blocks is
    a product of about ``question_rows`` by ``item_rows``, of which a worker holds ``CELLS`` scores at once, and pairs go to Python in
    small batches, so a task's memory is bounded. Scores have 6 places.
    """
    small_batches(items.sparkSession)
    asked = questions.select(F.col(query_id).alias("id"), unit(F.col(query_vector)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = items.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    nq, ni = (max(1, -(-d.count() // n)) for d, n in ((questions, question_rows), (items, item_rows)))
    asked = in_blocks(asked, F.pmod(F.xxhash64("id"), F.lit(nq)), "q")
    rows = in_blocks(rows, F.pmod(F.xxhash64("id", "v"), F.lit(ni)), "i")
    sent = asked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ni - 1).cast("long"))))
    query_type, id_type = (d.schema[c].dataType.elementType.simpleString() for d, c in ((asked, "q_ids"), (rows, "i_ids")))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                size = batch.column("size")[r].as_py()
                asks, ids = batch.column("q_ids")[r].values, batch.column("i_ids")[r].values
                who, at, scores = best_pairs(matrix(batch.column("q_data")[r], size), matrix(batch.column("i_data")[r], size), ids.to_numpy(zero_copy_only=False), k)
                yield pa.RecordBatch.from_arrays([asks.take(pa.array(who)), ids.take(pa.array(at)), pa.array(scores)], ["query_id", "id", "score"])

    pairs = sent.join(rows, ["i", "size"]).select("size", "q_ids", "q_data", "i_ids", "i_data")
    return pairs.mapInArrow(best, f"query_id {query_type}, id {id_type}, score double")
