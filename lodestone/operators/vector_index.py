"""An approximate vector index (R7, M9): lists around centroids, residuals in eight bits, exact scores for what is left.

* *Fit.* Centroids come from a sample: the ``sample`` rows whose ids have the smallest hashes, so that every run takes the same.
  Rounds of Lloyd on unit vectors: tasks add up their vectors by nearest centroid, Spark adds up the tasks' sums.
* *Build.* Every row goes to the list of its nearest centroid, as the residual in whole numbers of eight bits and one scale. A list
  is stored in blocks of at most about ``block_rows`` rows, so that a list of any size is many rows of the table, in files ordered
  by list: a search for some lists skips the others' row groups. Rows can be added later (``appended``) by the same centroids.
* *Tune.* How many lists a question looks into is measured: ``TUNED`` rows of the sample ask for their exact neighbours among all
  rows, and ``probes`` is the least number of lists that holds the share ``target`` of them.
* *Search.* A question looks into the lists of its ``probes`` nearest centroids. Questions of a list meet its blocks as matrices; a
  block gives the best ``k * refine`` of each question by the scores of the residuals. Of these, the best of all blocks get exact
  scores from the vectors themselves.

The centroids (``lists`` vectors) pass through the driver and to each task; nothing else of the corpus does.

Defined results: as ``vector.cosine_topk``; vectors of another size than the index has take no part, nor do rows with a null id. An
empty table gives an index without lists, and that no hits. ``recall`` measures against the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.lexical import ranked
from lodestone.operators.vector import best_rows, cosine_topk, dot, matrix, slices, unit
from lodestone.sources.stored import kept, small_batches

TUNED, TUNED_HITS = 64, 10
FINE = 127  #: the largest whole number of a residual


@dataclass
class VectorIndex:
    centroids: np.ndarray  #: float64, a row a list
    blocks: DataFrame  #: list, ids, scales, codes
    probes: int


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = table.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL")


def _array(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def nearest(v: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` lists of each vector, nearest first."""
    out = np.empty((len(v), n), np.int64)
    norm = (centroids * centroids).sum(axis=1)[None, :]
    for part in slices(len(v), len(centroids)):
        far = norm - 2 * (v[part] @ centroids.T)
        out[part] = far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def fitted(rows: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a written table (id, v) of unit vectors of one size."""
    seeds = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(lists).collect()]
    centroids = np.array(seeds, np.float64)
    for _ in range(rounds if len(seeds) else 0):
        now = centroids

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = _array(batch.column(0), batch.num_rows)
                    near = nearest(v, now)[:, 0]
                    np.add.at(total, near, v)
                    count += np.bincount(near, minlength=len(now))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], ["list", "n", "s"])

        parts = rows.select("v").mapInArrow(add, "list int, n long, s array<double>").select("list", "n", F.posexplode("s").alias("at", "x"))
        sums = parts.groupBy("list", "at").agg((F.sum("x") / F.sum("n")).alias("mean"))
        centroids = now.copy()
        for r in sums.toLocalIterator():
            centroids[r["list"], r["at"]] = r["mean"]
    return centroids


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, v) to (list, id, scale, code)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _array(batch.column("v"), batch.num_rows)
            near = nearest(v, centroids)[:, 0]
            rest = v - centroids[near]
            scale = np.maximum(np.abs(rest).max(axis=1) / FINE, 1e-300)
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("id"), pa.array(scale), pa.array([c.tobytes() for c in code], pa.binary())], ["list", "id", "scale", "code"])

    return rows.mapInArrow(assign, f"list int, id {id_type}, scale double, code binary")


def _blocks(assigned: DataFrame, block_rows: int) -> DataFrame:
    """Rows to blocks of a list, as many as the list's count asks for."""
    # one row a list, and there are at most as many as centroids
    many = F.broadcast(assigned.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("n")))
    dealt = assigned.join(many, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    rows = dealt.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct("id", "scale", "code"))).alias("r"))
    out = rows.select("list", F.col("r.id").alias("ids"), F.col("r.scale").alias("scales"), F.col("r.code").alias("codes"))
    return out.repartitionByRange("list").sortWithinPartitions("list")


def build(items: DataFrame, id_col: str, vector_col: str, lists: int | None = None, probes: int | None = None, target: float = 0.95, sample: int = 65_536, rounds: int = 8, block_rows: int = 4_096) -> VectorIndex:
    """An index of all rows of ``items``. ``lists`` is the root of their number (4,096 at most) where it is not given, ``probes`` what
    ``target`` asks for. The size of the vectors is the most frequent one, of several the smallest."""
    small_batches(items.sparkSession)
    rows = kept(_vectors(items, id_col, vector_col), "index-vectors")
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "size").limit(1).collect()
    size, n = (sizes[0]["size"], sizes[0]["n"]) if sizes else (0, 0)
    rows = rows.where(F.size("v") == size)
    lists = min(lists or max(1, min(4096, math.isqrt(n))), n)
    some = rows if n <= sample else kept(rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample), "index-sample")
    centroids = fitted(some, lists, rounds).reshape(lists, size)
    assigned = kept(_assigned(rows, centroids), "index-assigned")
    blocks = kept(_blocks(assigned, block_rows), "index-blocks")
    return VectorIndex(centroids, blocks, probes or _probes(rows, some, assigned, centroids, target))


def _probes(rows: DataFrame, some: DataFrame, assigned: DataFrame, centroids: np.ndarray, target: float) -> int:
    """The least number of lists that holds the share ``target`` of the neighbours of ``TUNED`` sampled rows."""
    asked = some.orderBy(F.xxhash64("id", F.lit(1)), "id", "v").limit(TUNED).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    asked = asked.dropDuplicates(["query_id"])
    hits = ranked(cosine_topk(rows, "id", "v", asked, "query_id", "qv", TUNED_HITS + 1), TUNED_HITS + 1).where("id <> query_id")
    where = {r["query_id"]: (r["qv"], []) for r in asked.collect()}
    for r in hits.select("query_id", "id").join(assigned.select("id", "list"), "id").collect():  # TUNED * TUNED_HITS rows, about
        where[r["query_id"]][1].append(r["list"])
    depth = [int(np.flatnonzero(order == own)[0]) + 1 for q, found in where.values() if found for order in [nearest(np.array([q]), centroids, len(centroids))[0]] for own in found]
    return int(np.quantile(depth, target, method="inverted_cdf")) if depth else max(1, len(centroids))


def appended(index: VectorIndex, items: DataFrame, id_col: str, vector_col: str, block_rows: int = 4_096) -> VectorIndex:
    """The index with more rows: they get blocks of their own, those there are stay as they are."""
    rows = _vectors(items, id_col, vector_col).where(F.size("v") == index.centroids.shape[1])
    more = kept(_blocks(kept(_assigned(rows, index.centroids), "index-assigned"), block_rows), "index-blocks")
    return VectorIndex(index.centroids, index.blocks.unionByName(more), index.probes)


def saved(index: VectorIndex, path: str) -> None:
    """Blocks and centroids as tables below ``path``; the centroids come last, so that what can be loaded is whole."""
    spark = index.blocks.sparkSession
    kept(index.blocks, "", f"{path}/blocks")
    rows = [(i, [float(x) for x in c], index.probes) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")


def loaded(spark, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    centroids = np.array([r["centroid"] for r in rows], np.float64)
    return VectorIndex(centroids, spark.read.parquet(f"{path}/blocks"), rows[0]["probes"] if rows else 1)


def search(index: VectorIndex, questions: DataFrame, query_id: str, query_vector: str, items: DataFrame, id_col: str, vector_col: str, k: int, refine: int = 4, question_rows: int = 500) -> DataFrame:
    """(query_id, id, score): at least the ``k`` best that the index finds of each question, with exact scores of 6 places."""
    small_batches(items.sparkSession)
    c, probes, keep = index.centroids, min(index.probes, len(index.centroids)), k * refine
    asked = _vectors(questions, query_id, query_vector).where(F.size("v") == (c.shape[1] if len(c) else -1))
    query_type, id_type = asked.schema["id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and probes:
                near = nearest(_array(batch.column("v"), batch.num_rows), c, probes)
                # a question's vector goes to every list: some questions at a time
                for part in slices(batch.num_rows, near.shape[1] * c.shape[1]):
                    some = batch.slice(part.start, part.stop - part.start)
                    who = pa.array(np.repeat(np.arange(some.num_rows), probes))
                    yield pa.RecordBatch.from_arrays([pa.array(near[part].ravel().astype(np.int32)), some.column("id").take(who), some.column("v").take(who)], ["list", "id", "v"])

    sent = asked.mapInArrow(probe, f"list int, id {query_type}, v array<double>")
    # a list that many questions look into gets them in several rows
    per = max(1, -(-questions.count() // question_rows))
    sent = sent.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(per)).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    sent = sent.select("list", F.col("r.id").alias("asks"), F.flatten("r.v").alias("data"))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = c[batch.column("list")[r].as_py()]
                q, ids = matrix(batch.column("data")[r], len(own)), batch.column("ids")[r].values
                codes = np.frombuffer(b"".join(batch.column("codes")[r].as_py()), np.int8).reshape(-1, len(own)).astype(np.float64)
                scales, plain = batch.column("scales")[r].values.to_numpy()[None, :], ids.to_numpy(zero_copy_only=False)
                for part in slices(len(q), len(codes)):
                    some, asks = q[part], batch.column("asks")[r].values[part]
                    scores = (some @ own)[:, None] + (some @ codes.T) * scales
                    near = [best_rows(plain, row, keep) for row in scores]
                    who, at = np.repeat(np.arange(len(near)), [len(n) for n in near]), np.concatenate(near)
                    yield pa.RecordBatch.from_arrays([asks.take(pa.array(who)), ids.take(pa.array(at)), pa.array(scores[who, at])], ["query_id", "id", "near"])

    found = sent.join(index.blocks, "list").mapInArrow(approximate, f"query_id {query_type}, id {id_type}, near double")
    order = W.partitionBy("query_id").orderBy(F.col("near").desc(), "id")
    best = kept(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).select("query_id", "id").distinct(), "index-candidates")
    q = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = best.join(_vectors(items, id_col, vector_col), "id").join(q, "query_id").where(F.size("v") == F.size("q"))
    return exact.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: hits of the exact search (query_id, id), how many of them were found, and their share."""
    hit = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    both = exact.select("query_id", "id").distinct().join(hit, ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("hits"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
