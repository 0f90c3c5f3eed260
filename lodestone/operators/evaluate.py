"""Scoring of answers and roll-ups of a run (A11-A13, score_answer)."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions.text import abstains_in_evaluation, citation_ids, stripped, token_recall, tokens


def scored(results: DataFrame) -> DataFrame:
    """(expected, answer, evidence, should_abstain) with the metrics of an answer. Recalls and gap are null where nothing is expected."""
    answer = stripped(F.coalesce("answer", F.lit("")))
    some = F.size(tokens(F.col("expected"))) > 0
    out = results.withColumn("answer_recall", token_recall(F.col("expected"), answer)).withColumn("evidence_recall", token_recall(F.col("expected"), F.coalesce("evidence", F.lit(""))))
    declined = abstains_in_evaluation(answer)
    correct = F.when(F.col("should_abstain"), declined).when(declined, F.lit(False))
    cites = F.size(citation_ids(answer))
    return (
        out.withColumn("answer_present", answer != "").withColumn("citation_count", cites).withColumn("citation_presence", cites > 0)
        .withColumn("expected_answer_token_recall", F.col("answer_recall")).withColumn("answer_token_recall", F.when(some, F.col("answer_recall")))
        .withColumn("retrieved_evidence_token_recall", F.when(some, F.col("evidence_recall")))
        .withColumn("evidence_answer_gap", F.when(some, F.bround(F.col("evidence_recall") - F.col("answer_recall"), 4)))
        .withColumn("abstention_detected", declined).withColumn("abstention_correct", correct).drop("answer_recall", "evidence_recall")
    )


def rate(value: Column) -> Column:
    """A mean to 4 places; null on nothing."""
    return F.bround(F.avg(value.cast("double")), 4)


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at the half-even rounded rank percent/100 * (n - 1) of a sorted array."""
    at = F.bround(F.lit(percent / 100) * (F.size(values) - 1), 0).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(F.lit(0), F.least(at, F.size(values) - 1)) + 1))


def nearest_ranks(rows: DataFrame, by: str, value: str, percents: dict[str, float | Callable[[Column], Column]], bins: int = 4096) -> DataFrame:
    """A12 for groups of any size: (by, one column a name in ``percents``); null values don't count, a group of them has nulls.

    Equal values are counted first. Counts in ``bins`` equal ranges between a group's finite extremes say in which range a rank
    lies, and only the values of those ranges are sorted, so no group is gathered in one task. A percent may be a function from
    the number of values to a rank from 0.
    """
    v = F.col("v")
    counts = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).groupBy("g", "v").agg(F.count("v").alias("n"))
    finite = F.when((v > float("-inf")) & (v < float("inf")), v)
    span = counts.groupBy("g").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.sum("n").alias("total"))
    span = span.select(F.col("g").alias("sg"), "lo", "hi", *[(p(F.col("total")) if callable(p) else F.bround(F.lit(p / 100) * (F.col("total") - 1), 0)).cast("long").alias(f"at_{c}") for c, p in percents.items()])
    inner = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    place = F.when(v == float("-inf"), -1).when(v >= float("inf"), bins).otherwise(inner).cast("int")
    placed = counts.where("v IS NOT NULL").join(span, F.col("g").eqNullSafe(F.col("sg"))).withColumn("bin", place).drop("sg", "lo", "hi")
    ats = [f"at_{c}" for c in percents]
    sizes = placed.groupBy("g", "bin", *ats).agg(F.sum("n").alias("held")).withColumn("upto", F.sum("held").over(W.partitionBy("g").orderBy("bin")))
    hit = F.lit(False)
    for a in ats:
        hit = hit | ((F.col(a) < F.col("upto")) & (F.col(a) >= F.col("upto") - F.col("held")))
    wanted = sizes.where(hit).select(F.col("g").alias("wg"), F.col("bin").alias("wb"), (F.col("upto") - F.col("held")).alias("before"))
    near = placed.join(wanted, F.col("g").eqNullSafe(F.col("wg")) & (F.col("bin") == F.col("wb")))
    near = near.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("g", "bin").orderBy("v")))
    out = near.groupBy("g").agg(*[F.max(F.when((F.col(f"at_{c}") < F.col("upto")) & (F.col(f"at_{c}") >= F.col("upto") - F.col("n")), v)).alias(c) for c in percents])
    return span.select("sg").join(out, F.col("sg").eqNullSafe(F.col("g")), "left").select(F.col("sg").alias(by), *percents)


def summarized(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, rates and recalls of scored rows."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), rate(F.col("answer_present")).alias("answer_present_rate"), rate(F.col("citation_presence")).alias("citation_presence_rate"),
        rate(F.col("abstention_detected")).alias("abstention_rate"), rate(F.col("abstention_correct")).alias("abstention_correct_rate"),
        rate(F.col("expected_answer_token_recall")).alias("expected_recall_avg"), rate(F.col("answer_token_recall")).alias("answer_recall_avg"),
        rate(F.col("retrieved_evidence_token_recall")).alias("evidence_recall_avg"),
    )


def worst(rows: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """(list, position, keys, value): the k lowest evidence recalls and the k largest gaps of questions that ought to be answered; ties by key."""
    able = rows.where(~F.coalesce("should_abstain", F.lit(False)) & F.col("retrieved_evidence_token_recall").isNotNull())

    def best(name: str, column: str, order: Column) -> DataFrame:
        top = able.select(*keys, F.col(column).alias("value")).orderBy(order, *keys).limit(k)  # at most k rows from here on
        return top.select(F.lit(name).alias("list"), F.row_number().over(W.orderBy(order, *keys)).alias("position"), *keys, "value")

    return best("lowest_evidence_recall", "retrieved_evidence_token_recall", F.col("value")).unionByName(best("largest_gap", "evidence_answer_gap", F.col("value").desc()))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, as the standard library computes it, to 4 places."""
    return pd.Series([round(difflib.SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in zip(a, b, strict=True)])


def evidence_by_document(hits: DataFrame) -> DataFrame:
    """A5: (query_id, document) with counts by kind and the place of the first hit."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return hits.groupBy("query_id", "document").agg(n("text").alias("text_count"), n("table").alias("table_count"), n("visual").alias("visual_count"), F.min("ord").alias("first_ord"))


def used_and_unused(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Hits (query_id, citation, ...) and whether the answer (query_id, answer) cites them."""
    cited = answers.select("query_id", F.explode(citation_ids(F.col("answer"))).alias("citation")).withColumn("used", F.lit(True))
    return hits.join(cited, ["query_id", "citation"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
