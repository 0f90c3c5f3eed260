"""A run over golden questions: who is evaluated, and what the report says (A11, A12, L6, S14; six statuses).

Questions have an order. One outside the filter is skipped; once ``limit`` questions are evaluated, all later ones are skipped,
indexed or not; one whose document is not indexed is skipped; the others are tried, and end as evaluated, provider_failed or failed.
Only evaluated ones count, so who is skipped depends on how earlier ones ended.

Running counts come from range partitions: each counts within itself, and one row a partition says how many came before.

Defined results: null filters take all questions; a limit of null is none, one of 0 skips all; questions with equal order keys follow
their ids; null categories and documents are groups of their own; rates and percentiles of nothing are null. A run of no questions
has an empty report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import evaluate
from lodestone.sources.stored import kept

EVALUATED, FILTERED, LIMITED, NOT_INDEXED = "evaluated", "skipped_by_filter", "skipped_by_limit", "skipped_not_indexed"


def counted_before(rows: DataFrame, order: list[str], flag: Column, name: str = "before") -> DataFrame:
    """``rows`` with how many rows that ``flag`` holds for come before each in ``order``, which tells all rows apart."""
    ranged = kept(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("long")), "ranges")
    parts = ranged.groupBy("__part").agg(F.sum("__flag").alias("__n"))  # one row a partition
    parts = parts.withColumn("__sum", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).select("__part", "__sum")
    own = F.sum("__flag").over(W.partitionBy("__part").orderBy(*order)) - F.col("__flag")
    return ranged.withColumn("__own", own).join(F.broadcast(parts), "__part").withColumn(name, F.col("__sum") + F.col("__own")).drop("__part", "__flag", "__own", "__sum")


def admitted(questions: DataFrame, order: list[str], doc_ids: list[str] | None, limit: int | None, indexed: DataFrame, attempt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``questions`` (doc_id and the ``order`` columns) with status and skip_reason, and what ``attempt`` adds to those it tried.

    ``attempt`` takes questions and returns the ``order`` columns, a status and more. With a limit it first gets as many questions
    as may be evaluated; while some of them fail, the next ones go, so that hardly more are tried than a loop would try."""
    rows = questions.withColumn("__in", F.coalesce(F.col("doc_id").isin(doc_ids), F.lit(False)) if doc_ids else F.lit(True))
    rows = rows.join(indexed.select("doc_id").distinct().withColumn("__indexed", F.lit(True)), "doc_id", "left")
    rows = kept(counted_before(rows.withColumn("__can", F.col("__in") & F.coalesce("__indexed", F.lit(False))), order, F.col("__can"), "__place"), "questions")
    can = rows.where("__can")
    if limit is None:
        tried = kept(attempt(can.select(questions.columns)), "tried")
    else:
        total, upto, done = can.count(), 0, 0
        tried = kept(attempt(can.where(F.lit(False)).select(questions.columns)), "tried")
        while done < limit and upto < total:
            more = min(limit - done, total - upto)
            part = can.where((F.col("__place") >= upto) & (F.col("__place") < upto + more)).select(questions.columns)
            part = kept(attempt(part), "tried")
            done, upto = done + part.where(F.col("status") == EVALUATED).count(), upto + more
            tried = tried.unionByName(part)
    both = rows.join(tried, order, "left")
    both = counted_before(both, order, F.col("status") == EVALUATED, "__done")
    full = (F.col("__done") >= limit) if limit is not None else F.lit(False)
    status = F.when(~F.col("__in"), FILTERED).when(full, LIMITED).when(~F.coalesce("__indexed", F.lit(False)), NOT_INDEXED).otherwise(F.col("status"))
    why = F.when(status == FILTERED, "doc_id filter").when(status == LIMITED, "evaluation limit reached")
    why = why.when(status == NOT_INDEXED, F.concat(F.lit("No indexed text chunks found for "), F.coalesce(F.col("doc_id"), F.lit("None"))))
    return both.withColumn("skip_reason", why).withColumn("status", status).drop("__in", "__indexed", "__can", "__place", "__done")


SETS = ("status", "category", "doc_id")


def report(results: DataFrame) -> DataFrame:
    """(grouping, key, n, evaluated, skipped, failed, rates, averages, latency_ms_p50, latency_ms_p95) over all results and by
    status, category and document: one pass by grouping sets. Rates and latencies are of evaluated rows; p50 is the median, p95 the
    nearest rank, both to two places."""
    done = F.col("status") == EVALUATED
    flat = results.select(*[F.col(c).cast("string").alias(c) for c in SETS], *[c for c in results.columns if c not in SETS])
    mean = lambda c: F.bround(F.avg(F.when(done, F.col(c).cast("double"))), 4)
    sets = flat.groupingSets([[F.col(c)] for c in SETS] + [[]], *[F.col(c) for c in SETS])
    out = sets.agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(done).alias("evaluated"), F.count_if(F.col("status").startswith("skipped")).alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        mean("answer_present").alias("answer_present_rate"), mean("citation_presence").alias("citation_presence_rate"), mean("expected_answer_token_recall").alias("average_expected_answer_token_recall"),
        mean("abstention_correct").alias("abstention_correct_rate"),
        F.bround(F.avg(F.when(done & F.col("should_abstain"), F.col("abstention_correct").cast("double"))), 4).alias("true_abstention_accuracy"),
        F.bround(F.avg(F.when(done & ~F.col("should_abstain"), F.coalesce("abstention_detected", F.lit(False)).cast("double"))), 4).alias("false_abstention_rate"),
        mean("retrieved_evidence_token_recall").alias("average_retrieved_evidence_token_recall"), mean("answer_token_recall").alias("average_answer_token_recall"), mean("evidence_answer_gap").alias("average_evidence_answer_gap"),
    )
    # grouping_id has a bit for each column that a set leaves out, the first one highest
    which = {3: "status", 5: "category", 6: "doc_id", 7: "all"}
    grouping, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bits, name in which.items():
        grouping = F.when(F.col("g") == bits, name).otherwise(grouping)
        key = F.when(F.col("g") == bits, F.col(name) if name in SETS else F.lit("")).otherwise(key)
    out = out.withColumn("grouping", grouping).withColumn("key", F.coalesce(key, F.lit("None"))).drop("g", *SETS)
    keys = F.array(*[F.struct(F.lit(c).alias("grouping"), F.coalesce(c, F.lit("None")).alias("key")) for c in SETS], F.struct(F.lit("all").alias("grouping"), F.lit("").alias("key")))
    each = flat.where(done).select(F.explode(keys).alias("k"), F.col("latency_ms").cast("double").alias("latency_ms")).select(F.to_json("k").alias("k"), "latency_ms")
    ranks = evaluate.nearest_ranks(each, "k", "latency_ms", {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p95": 95})
    ranks = ranks.select("k", F.bround((F.col("low") + F.col("high")) / 2, 2).alias("latency_ms_p50"), F.bround("p95", 2).alias("latency_ms_p95"))
    out = out.withColumn("k", F.to_json(F.struct("grouping", "key"))).join(ranks, "k", "left").drop("k")
    return out.select("grouping", "key", *[c for c in out.columns if c not in ("grouping", "key")])


def report_lines(summary: DataFrame, run_name: str, results: DataFrame, worst: DataFrame) -> DataFrame:
    """(section, ord, line): the report as Markdown. ``worst`` is ``evaluate.worst`` with qa_id and doc_id as keys."""
    total = summary.where("grouping = 'all'")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    facts = [("Questions seen", "n"), ("Evaluated", "evaluated"), ("Skipped", "skipped"), ("Failed", "failed"), ("Citation presence rate", "citation_presence_rate"), ("Average expected-answer token recall", "average_expected_answer_token_recall"), ("P50 latency ms", "latency_ms_p50"), ("P95 latency ms", "latency_ms_p95")]
    head = total.select(F.posexplode(F.array(F.lit(f"# Report - {run_name}"), F.lit(""), F.lit("## Summary"), F.lit(""), *[F.concat(F.lit(f"- {k}: "), shown(c)) for k, c in facts])).alias("ord", "line"))
    parts = [head.select(F.lit(0).alias("section"), F.lpad(F.col("ord").cast("string"), 4, "0").alias("ord"), "line")]
    title = lambda n, text: total.select(F.posexplode(F.array(F.lit(""), F.lit(text), F.lit(""))).alias("ord", "line")).select(F.lit(n).alias("section"), F.concat(F.lit(" "), F.col("ord").cast("string")).alias("ord"), "line")
    for n, (name, text) in enumerate((("status", "## Status Counts"), ("category", "## Category Counts")), 1):
        rows = summary.where(F.col("grouping") == name)
        parts += [title(n, text), rows.select(F.lit(n).alias("section"), F.concat(F.lit("a"), F.col("key")).alias("ord"), F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("n")).alias("line"))]
    for n, (name, text) in enumerate((("lowest_evidence_recall", "### Worst Evidence Recall Questions (retrieval problem)"), ("largest_gap", "### Largest Evidence-Answer Gap Questions (synthesis problem)")), 3):
        rows = worst.where(F.col("list") == name)
        label = "evidence_recall=" if n == 3 else "gap="
        line = F.concat(F.lit("- "), F.col("qa_id").cast("string"), F.lit(" ("), F.col("doc_id").cast("string"), F.lit("): " + label), F.col("value").cast("string"))
        parts += [title(n, text), rows.select(F.lit(n).alias("section"), F.concat(F.lit("a"), F.lpad(F.col("position").cast("string"), 4, "0")).alias("ord"), line.alias("line"))]
    skipped = results.where(F.col("status").startswith("skipped")).orderBy("qa_id").limit(10)
    line = F.concat(F.lit("- "), F.col("qa_id").cast("string"), F.lit(" ("), F.col("doc_id").cast("string"), F.lit("): "), F.col("status"), F.lit(" - "), F.col("skip_reason"))
    parts += [title(5, "## Skipped Examples"), skipped.select(F.lit(5).alias("section"), F.concat(F.lit("a"), F.lpad(F.col("qa_id").cast("string"), 20, "0")).alias("ord"), line.alias("line"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_run(results: DataFrame, run_name: str, path: str, keys: tuple[str, ...] = ("qa_id", "doc_id")) -> None:
    """Results and summary as JSON lines, report.md as text in order, and the rows for an outside scorer."""
    results = kept(results, "results")
    results.write.mode("overwrite").json(f"{path}/results.jsonl")
    summary = kept(report(results), "summary")
    summary.write.mode("overwrite").json(f"{path}/summary.json")
    worst = evaluate.worst(results.where(F.col("status") == EVALUATED), list(keys))
    lines = report_lines(summary, run_name, results, worst)
    lines.repartitionByRange("section", "ord").sortWithinPartitions("section", "ord").select("line").write.mode("overwrite").text(f"{path}/report.md")
