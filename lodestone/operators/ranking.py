"""Limits, reranking and pool sizes after retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diverse(hits: DataFrame, max_documents: int, per_document: int, top_k: int) -> DataFrame:
    """R16 for one kind: documents in order of their first hit, so many of them, so many hits each, so many in all."""
    order = W.partitionBy("query_id").orderBy("rank")
    first = hits.groupBy("query_id", "document").agg(F.min("rank").alias("first_rank"))
    first = first.withColumn("document_rank", F.row_number().over(W.partitionBy("query_id").orderBy("first_rank")))
    kept = hits.join(first.where(F.col("document_rank") <= max_documents), ["query_id", "document"])
    kept = kept.withColumn("in_document", F.row_number().over(W.partitionBy("query_id", "document").orderBy("rank"))).where(F.col("in_document") <= per_document)
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)


def diverse_kinds(hits: DataFrame, limits: dict[str, int], max_documents: int, per_document: int, pool: int = 50) -> DataFrame:
    """R16 for several kinds: (query_id, kind, id, document, score, rank) to the accepted rows.

    A greedy choice by score, kinds in the order of ``limits`` where scores tie. Each question's pool is at most ``pool`` hits a
    kind, which bounds a group.
    """
    order = {k: i for i, k in enumerate(limits)}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_k=pdf.kind.map(order)).sort_values(["score", "_k", "rank"], ascending=[False, True, True], kind="stable")
        kinds, docs, keep = dict.fromkeys(limits, 0), {}, []
        for kind, doc in zip(pdf.kind, pdf.document, strict=True):
            fits = kinds[kind] < limits[kind] and (docs.get(doc, 0) < per_document) and (doc in docs or len(docs) < max_documents)
            if fits:
                kinds[kind] += 1
                docs[doc] = docs.get(doc, 0) + 1
            keep.append(fits)
        return pdf[keep].drop(columns="_k").sort_values(["kind", "rank"])

    pooled = hits.where(F.col("rank") <= pool)
    return pooled.groupBy("query_id").applyInPandas(choose, pooled.schema)


def pool_size(all_scope: bool, top_k: int, table_k: int = 0, visual_k: int = 0, documents: int = 0, per_document: int = 0) -> int:
    """R17."""
    return min(50, max(50 if all_scope else 20, top_k, table_k, visual_k, documents * per_document))


def retry_size(top_k: int) -> int:
    """The window of a second search."""
    return min(2 * top_k, 8)


def reranked(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Scores (query_id, id, rerank_score) replace those of ``hits``; hits without one get n less their rank."""
    n = F.count("*").over(W.partitionBy("query_id"))
    both = hits.join(scores, ["query_id", "id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", (n - F.col("rank")).cast("double")))
    out = both.withColumnRenamed("rank", "pre_rerank_rank").withColumn("post_rerank_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("pre_rerank_rank"))))
    return out.where(F.col("post_rerank_rank") <= k)


def rerank_with(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8) -> DataFrame:
    """(query_id, id, question, text) scored by a model that each worker loads once: (query_id, id, rerank_score)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            scores: list[float] = []
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                scores += model(list(zip(part.question, part.text, strict=True)))
            yield f[["query_id", "id"]].assign(rerank_score=scores)

    q, i = (pairs.schema[c].dataType.simpleString() for c in ("query_id", "id"))
    return pairs.select("query_id", "id", "question", "text").mapInPandas(run, f"query_id {q}, id {i}, rerank_score double")
