"""Connected components by alternating large-star and small-star steps; edges never meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import emptied, written


FILE_ROWS = 200_000  #: edges of a file of a step's table, about


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) between long node ids to (node, component): each node that has an edge with the least id it can reach.

    Least neighbours are found by combining aggregates, and rows join with one row a node, which Spark can split where a node
    has very many neighbours. Each step is a written table; the loop ends when a step changes nothing.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = written(stars, "edges")
    before, rows = None, stars.count()
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        last, stars = stars, written(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(1 + rows // FILE_ROWS), "edges")
        emptied(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
