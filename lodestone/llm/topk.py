"""Exact top-k inner-product search by distributed histogram selection.

Vectors become integers, floor(scale * x), and are put into blocks: a block of queries and a block of candidates are each one
row with a matrix, of the narrowest whole numbers that hold its table's. Every block of queries meets every block of candidates
once a pass, as a product of two matrices; tasks take pairs of parts of both tables, and neither is broadcast or shuffled:

1. a pass counts each query's scores in bins over the range that scores can have; counts are summed over all candidates and
   the bin in which the kth largest score lies is found;
2. further passes count within that bin alone, until a bin is one integer: the kth value itself;
3. a last pass keeps the scores above the kth value and, of those equal to it, the smallest ids; ranks follow from these.

A block of candidates reports only its upper bins, down to the one that holds its own kth score: the overall kth score can't be
lower. Of ties it reports its k smallest ids, of which the overall smallest are a part.

Defined results: vectors that are null or hold a null or a non-finite component, and rows with a null id, take no part; shorter
vectors count as filled up with zeros; a query never returns its own row; other rows with its id are candidates, and rows that
repeat an id are queries and candidates of their own. Products are exact at any size; components beyond 64 bits after scaling,
and scores beyond them, count as the nearest number of 64 bits (the least one aside).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import written

BINS = 256
NONE = np.iinfo(np.int64).min  #: the score of a query with its own row
MOST = np.iinfo(np.int64).max


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    x = F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    usable = vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))) & ~F.isnan(v.cast("double")))
    return F.when(F.coalesce(usable, F.lit(False)), x)


def narrow(largest: int) -> str:
    """The narrowest type of whole numbers up to ``largest``, of either sign."""
    return next((t for t, most in (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)) if largest < most), "bigint")


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(id, v, at) to one row per block: name, ids, data. A block has about ``rows`` rows, by the count."""
    n = max(1, -(-vectors.count() // rows))
    parts = min(n, 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    spread = vectors.withColumn(name, F.pmod(F.xxhash64("at"), F.lit(n))).repartition(parts, name)
    rows = F.collect_list(F.struct("id", "at", "v"))
    return spread.groupBy(name).agg(rows.alias("r")).select(name, F.col("r.id").alias(f"{name}_ids"), F.col("r.at").alias(f"{name}_at"), F.flatten("r.v").alias(f"{name}_data"))


def scores(ids, data) -> np.ndarray:
    """A block's matrix, rows by id."""
    return data.values.to_numpy().reshape(len(ids), -1).astype(np.int64)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = _largest(q) * _largest(c) * q.shape[1]
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    # rows whose products float64 holds go that way; only the few that need them take larger numbers
    most = math.isqrt(2**53 // q.shape[1]) - 1
    nq, nc = ((x.max(axis=1) <= most) & (x.min(axis=1) >= -most) for x in (q, c))
    out = np.empty((len(q), len(c)), np.int64)
    if nq.any() and nc.any():
        out[np.ix_(nq, nc)] = _product(q[nq], c[nc])
    out[~nq] = _wide(q[~nq], c)
    out[np.ix_(nq, ~nc)] = _wide(q[nq], c[~nc])
    return out


def _wide(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of whole numbers of any size, cut at 64 bits."""
    if _largest(q) * _largest(c) * q.shape[1] <= MOST:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -MOST, MOST).astype(np.int64)


def met(q: DataFrame, c: DataFrame) -> DataFrame:
    """Every block of queries with every block of candidates. Spark would broadcast one side by the size of its file, which says
    little of its size in memory, so it is told not to."""
    return c.hint("shuffle_replicate_nl").crossJoin(q)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, query_rows: int = 512, candidate_rows: int = 4096) -> DataFrame:
    """query_id, rank, id, score: each query's ``k`` best candidates (all, if fewer)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), is_query.alias("is_query"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, "topk-vectors")
    dim = rows.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    width, largest = max(1, dim[0] or 0), max(1, abs(dim[1] or 0), abs(dim[2] or 0))
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).cast(f"array<{narrow(largest)}>"))
    q = written(blocks(rows.where("is_query"), query_rows, "q"), "topk-queries")
    c = written(blocks(rows, candidate_rows, "c"), "topk-candidates")

    low0 = -min(largest * largest * width, MOST)
    span = 1 - 2 * low0
    step = 1
    while step * BINS < span:
        step *= BINS
    # where the kth value of each query lies: (query, low, need): the kth is the need-th largest among scores in [low, low + step * BINS)
    asked, first = q, True
    while True:
        # the bounds of a block's queries, in its order: a row a block, as large as the block
        kth = written(_located(met(asked, c), step, low0, k, first), "topk-bounds")
        state = kth.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "need"))).alias("bounds"))
        asked, first = written(q.join(state, "q", "left"), "topk-asked"), False
        if step == 1:
            break
        step //= BINS
    best = _kept(met(asked, c), k)
    order = W.partitionBy("query_id", "query_at").orderBy(F.col("score").desc(), F.col("id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _blocks(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and their scores; a query's own row scores ``NONE``."""
    qi, ci = batch.column("q_ids")[r].values.to_numpy(), batch.column("c_ids")[r].values.to_numpy()
    s = _product(scores(qi, batch.column("q_data")[r]), scores(ci, batch.column("c_data")[r]))
    _, i, j = np.intersect1d(batch.column("q_at")[r].values.to_numpy(), batch.column("c_at")[r].values.to_numpy(), assume_unique=True, return_indices=True)
    s[i, j] = NONE
    return qi, ci, s


def _beyond(s: np.ndarray, low: np.ndarray) -> np.ndarray:
    """s - low for s >= low, as numbers of 64 bits without a sign: the range of scores may be as wide as that."""
    return s.view(np.uint64) - np.ascontiguousarray(low, np.int64).view(np.uint64)[:, None]


def _bounds(batch: pa.RecordBatch, r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """low and need of each query of a block; queries with no more than k candidates at all have none: every score counts."""
    low, need = np.full(n, NONE + 1), np.zeros(n, np.int64)
    b = batch.column("bounds")[r].values
    if b is not None and len(b):
        pos = b.field("pos").to_numpy()
        low[pos], need[pos] = b.field("low").to_numpy(), b.field("need").to_numpy()
    return low, need


def _located(pairs: DataFrame, step: int, low0: int, k: int, first: bool) -> DataFrame:
    """(q, pos, low, need): the bin of width ``step`` that holds the kth score, and how many of its scores are wanted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, _, s = _blocks(batch, r)
                own = s == NONE
                if first:
                    low, need, bins = np.full(len(qi), low0), np.full(len(qi), k), int((-2 * low0) // step) + 1
                else:
                    (low, need), bins = _bounds(batch, r, len(qi)), BINS
                b = _beyond(s, low) // np.uint64(step)
                out = own | (s < low[:, None]) | (b >= bins)
                b = b.astype(np.int64)
                b[out] = -1
                flat = (b + 1) + (np.arange(len(qi)) * (bins + 1))[:, None]
                h = np.bincount(flat.ravel(), minlength=len(qi) * (bins + 1)).reshape(len(qi), bins + 1)[:, 1:]
                above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h  # in higher bins
                pos, at = np.nonzero((h > 0) & (above < need[:, None]))
                n = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("q")[r].as_py())), pa.array(pos.astype(np.int32)), pa.array(low[pos] + at * step), pa.array(need[pos]), pa.array(h[pos, at])], ["q", "pos", "low", "need", "n"])

    bins = pairs.mapInArrow(count, "q long, pos int, low long, need long, n long")
    bins = bins.groupBy("q", "pos", "low", "need").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("q", "pos").orderBy(F.col("low").desc()).rowsBetween(W.unboundedPreceding, -1))
    bins = bins.withColumn("above", F.coalesce(upto, F.lit(0)))
    return bins.where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))).select("q", "pos", "low", (F.col("need") - F.col("above")).alias("need"))


def _kept(pairs: DataFrame, k: int) -> DataFrame:
    """Scores above the kth value, and a block's smallest ids at it; all scores of queries with fewer than k candidates."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, ci, s = _blocks(batch, r)
                low, need = _bounds(batch, r, len(qi))
                own = s == NONE
                i, j = np.nonzero((s > low[:, None]) & ~own)
                ti, tj = np.nonzero((s == low[:, None]) & ~own)
                if len(ti):
                    order = np.lexsort((ci[tj], ti))
                    ti, tj = ti[order], tj[order]
                    place = np.arange(len(ti)) - np.searchsorted(ti, ti)
                    near = place < need[ti]
                    i, j = np.r_[i, ti[near]], np.r_[j, tj[near]]
                at = batch.column("q_at")[r].values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(at[i]), pa.array(ci[j]), pa.array(s[i, j])], ["query_id", "query_at", "id", "score"])

    return pairs.mapInArrow(keep, "query_id long, query_at long, id long, score long")
