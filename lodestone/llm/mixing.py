"""Mixing sources to target weights by systematic sampling.

A source's target share of words is its weight's share of all words; a target stops at ``max_repeats`` times what its source
has, and the excess is shared again by weight among the others (water-filling, solved in closed form). Every document of a
source then expects target / source size copies. Documents are ordered by size within their source, expected copies are
summed up along that order, one offset a source (from a hash of the seed and the source) is added, and a document is
emitted once for each integer that its stretch of the sum crosses. Ordering by size makes the sample a stratified one.

Positions within a source come from one range-partitioned sort: each partition numbers its rows, and the rows before it are
added from counts per (partition, source), so a source with a third of all rows is spread over as many tasks as its rows.

Defined results: null text has size 0; the null source is a source, ordered last; rows with equal ids are rows of their own;
an empty table gives no rows; a source without words has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import emptied, written

SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, target, rate. The windows without a partition run over one row per source."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    each = each.withColumn("w", F.element_at(cycle, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")).cast("long"))
    each = each.withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    every = W.partitionBy(F.lit(1))
    tightest = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    each = each.withColumn("total", F.sum("source_size").over(every)).withColumn("w_all", F.sum("w").over(every))
    before = tightest.rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    # words per unit of weight if exactly the tighter sources are capped; the first level (from the tightest on) that its source's own cap admits holds
    each = each.withColumn("place", F.row_number().over(tightest))
    each = each.withColumn("level", (F.col("total") - F.col("cap_before")).cast("double") / (F.col("w_all") - F.col("w_before")))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("place", "level"))
    each = each.withColumn("level", F.min(fits).over(every)["level"])
    each = each.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    return each.select("source", "source_size", "target", rate.alias("rate"))


def offset(source: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) a source, the same in each run."""
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(hexes, 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def systematic_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = SEED, tables: list[DataFrame] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies. ``tables`` gets the written tables that the
    result depends on, for ``emptied``."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = written(sizes, "mix-sizes")
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last(), "size", "id").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "id")
    # partition number in the upper bits, row in the partition in the lower 33
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "mix-order")
    if tables is not None:
        tables += [sizes, ordered]
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(sizes, weights, max_repeats)
    plan = counts.join(targets.withColumnRenamed("source", "source_t"), F.col("source").eqNullSafe(F.col("source_t"))).drop("source_t", "n")
    plan = plan.withColumnRenamed("source", "source_p").withColumnRenamed("part", "part_p")
    out = ordered.join(plan, (F.col("part") == F.col("part_p")) & F.col("source").eqNullSafe(F.col("source_p")))
    i, u = (F.col("at") - F.col("first") + F.col("before")).cast("double"), offset(F.col("source"), seed)
    copies = F.floor((i + 1) * F.col("rate") + u) - F.floor(i * F.col("rate") + u)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as many times as the mix takes it. Rows that agree in id, source and size share out their copies."""
    tables: list[DataFrame] = []
    plan = systematic_mix(docs, id_col, text_col, source_col, tables=tables).groupBy(id_col, source_col, "size").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    plan = plan.where("__copies > 0").select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__size"), "__copies", "__rows")
    plan = written(plan, "mix-plan").hint("merge")  # a row a document
    emptied(*tables)
    rows = docs.withColumn("__n", word_count(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__size"))
    out = rows.join(plan, same)
    if not plan.where("__rows > 1").isEmpty():
        # the kth of c such rows gets its part of their copies: together exactly what the plan gives them
        k = F.row_number().over(W.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64(text_col)))
        part = F.floor(F.col("__copies") * k / F.col("__rows")) - F.floor(F.col("__copies") * (k - 1) / F.col("__rows"))
        several = rows.join(plan.where("__rows > 1"), same).withColumn("__copies", part.cast("long")).where("__copies > 0")
        out = rows.join(plan.where("__rows = 1"), same).unionByName(several)
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
