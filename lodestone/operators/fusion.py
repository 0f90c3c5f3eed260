"""Min-max normalisation and weighted fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def min_max(score: Column, by: str) -> Column:
    """All 1 where the scores of a question are equal; the worst hit becomes 0."""
    low, high = F.min(score).over(W.partitionBy(by)), F.max(score).over(W.partitionBy(by))
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, dense_weight: float = 0.6, lexical_weight: float = 0.4) -> DataFrame:
    """The k best by weighted sum. A side that lacks an item adds 0 and leaves its score null; ties go to dense hits first."""
    d = dense.select("query_id", "id", F.col("score").alias("dense_score"), min_max(F.col("score"), "query_id").alias("dn"), F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "id", F.col("score").alias("lexical_score"), min_max(F.col("score"), "query_id").alias("ln"), F.col("rank").alias("lexical_rank"))
    both = d.join(x, ["query_id", "id"], "full_outer")
    both = both.withColumn("hybrid_score", F.round(dense_weight * F.coalesce("dn", F.lit(0.0)) + lexical_weight * F.coalesce("ln", F.lit(0.0)), 6))
    first = F.coalesce(F.col("dense_rank"), F.lit(2 * k) + F.col("lexical_rank"))
    order = W.partitionBy("query_id").orderBy(F.col("hybrid_score").desc(), first, F.col("id"))
    out = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "id", "dense_score", "lexical_score", "hybrid_score")
