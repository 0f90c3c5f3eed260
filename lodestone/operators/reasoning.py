"""Deterministic answers from tables (Q1-Q8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import contained, contains_any, display_value, line_numbers, numeric, unit


def intent(question: Column) -> Column:
    """Q1: struct(metric, year, operation, hint); words match by substring, the first metric in list order wins."""
    q = F.lower(question)
    metric = F.try_element_at(contained(q, V.METRICS), F.lit(1))
    year = F.regexp_extract(q, r"\b(20[0-9][0-9])\b", 1).try_cast("int")
    operation = F.when(contains_any(q, V.OPERATION_WORDS["max"]), "max").when(contains_any(q, V.OPERATION_WORDS["min"]), "min").when(q.contains("compare"), "compare").otherwise("lookup")
    hint = F.when(q.contains("segment"), "segment").when(q.contains("country"), "country")
    return F.struct(metric.alias("metric"), year.alias("year"), operation.alias("operation"), hint.alias("hint"))


def asked(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """Questions (query_id, question) with the tables (query_id, table_id, evidence_index, ...) that were retrieved for them."""
    q = questions.select("query_id", intent(F.col("question")).alias("intent")).where("intent.metric IS NOT NULL AND intent.year IS NOT NULL")
    return tables.join(q, "query_id")


OUT = ["query_id", "table_id", "evidence_index", "label", "metric", "year", "value", "display_value", "unit"]


# What a result's text says of an operation.
OPERATION_NAMES = {"max": "highest", "min": "lowest"}


def _out(rows: DataFrame, token: Column, line: Column, context: Column, kind: int, *place: str) -> DataFrame:
    """OUT and the place of an observation in its table: by kind, then line or row, then column."""
    at = [F.coalesce(F.col(p).cast("int"), F.lit(0)) for p in place] + [F.lit(0)] * (2 - len(place))
    rows = rows.withColumn("place", F.struct(F.lit(kind).alias("kind"), at[0].alias("row"), at[1].alias("col")))
    rows = rows.withColumn("value", numeric(token)).where("value IS NOT NULL").withColumn("unit", unit(line, context))
    return rows.select("query_id", "table_id", "evidence_index", "label", F.col("intent.metric").alias("metric"), F.col("intent.year").alias("year"), "value", display_value(F.col("value"), token, F.col("unit")).alias("display_value"), "unit", "place")


def _structured(rows: DataFrame) -> DataFrame:
    """Q2: tables with headers, rows and context; the first header with the year, rows where the context or the row names the metric."""
    y = F.col("intent.year").cast("string")
    at = rows.withColumn("col", F.array_position(F.transform("headers", lambda h: F.contains(h, y)), True)).where("col > 0")
    each = at.select("*", F.posexplode("rows").alias("nth", "row"))
    whole = F.array_join("row", " ")
    each = each.where(F.lower(F.coalesce("context", F.lit(""))).contains(F.col("intent.metric")) | F.lower(whole).contains(F.col("intent.metric")))
    each = each.withColumn("label", F.element_at("row", 1)).withColumn("token", F.try_element_at("row", F.col("col").cast("int")))
    return _out(each.where("token IS NOT NULL"), F.col("token"), whole, F.col("context"), 0, "nth")


def _text_lines(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "table_id", "evidence_index", "intent", "raw_text", F.posexplode(F.split("raw_text", "\n")).alias("ord", "line"))


KEY = ["query_id", "table_id", "evidence_index"]


def _matrix(rows: DataFrame) -> DataFrame:
    """Q3: a line with two or more known labels, the next line with years within 5, the next line of the metric within 10; values by label and year."""
    all_lines = _text_lines(rows)
    years = F.regexp_extract_all("line", F.lit(r"\b20[0-9][0-9]\b"), F.lit(0))
    labels = F.transform(F.array_sort(F.filter(F.array(*[F.struct(F.instr(F.col("line"), e).alias("at"), F.lit(e).alias("e")) for e in V.ENTITIES]), lambda s: s["at"] > 0)), lambda s: s["e"])
    # the entities of a line in order of their place
    marked = all_lines.withColumn("labels", labels).withColumn("years", years).withColumn("metric_here", F.lower(F.col("line")).contains(F.col("intent.metric")))
    order = W.partitionBy(*KEY).orderBy("ord")
    ahead = lambda cond, col, n: F.filter(F.collect_list(F.struct("ord", F.col(col).alias("v"), cond.alias("c"))).over(order.rowsBetween(1, n)), lambda s: s["c"])
    marked = marked.withColumn("year_line", F.try_element_at(ahead(F.size("years") > 0, "years", 5), F.lit(1)))
    marked = marked.withColumn("metric_line", F.try_element_at(ahead(F.col("metric_here"), "line", 10), F.lit(1)))
    heads = marked.where("size(labels) >= 2 AND year_line IS NOT NULL AND size(year_line.v) >= size(labels)").select(*KEY, "ord", "intent", "raw_text", "labels", "year_line")
    metrics = marked.select(*[F.col(k).alias(f"y_{k}") for k in KEY], F.col("ord").alias("y_ord"), "metric_line")
    same = [F.col(k) == F.col(f"y_{k}") for k in KEY]
    found = heads.join(metrics, [*same, F.col("year_line.ord") == F.col("y_ord")]).where("metric_line IS NOT NULL")
    found = found.withColumn("values", line_numbers(F.col("metric_line.v"))).where("size(values) >= size(year_line.v)")
    width = F.greatest(F.lit(1), F.floor(F.size("year_line.v") / F.size("labels")).cast("int"))
    each = found.withColumn("width", width).select("*", F.posexplode("labels").alias("n", "label"))
    group = F.slice("year_line.v", F.col("n") * F.col("width") + 1, F.col("width"))
    each = each.where(F.col("n") * F.col("width") < F.size("year_line.v")).withColumn("offset", F.array_position(group, F.col("intent.year").cast("string"))).where("offset > 0")
    each = each.withColumn("token", F.try_element_at("values", (F.col("n") * F.col("width") + F.col("offset")).cast("int"))).where("token IS NOT NULL")
    return _out(each, F.col("token"), F.col("metric_line.v"), F.col("raw_text"), 1, "ord", "n")


def _simple_rows(rows: DataFrame) -> DataFrame:
    """Q4: a line of the metric and the nearest line with years up to 5 before it; values by position."""
    all_lines = _text_lines(rows)
    years = F.regexp_extract_all("line", F.lit(r"\b20[0-9][0-9]\b"), F.lit(0))
    marked = all_lines.withColumn("years", years)
    order = W.partitionBy(*KEY).orderBy("ord")
    behind = F.filter(F.collect_list(F.col("years")).over(order.rowsBetween(-5, -1)), lambda y: F.size(y) > 0)
    marked = marked.withColumn("head", F.try_element_at(F.reverse(behind), F.lit(1))).where(F.lower(F.col("line")).contains(F.col("intent.metric")) & F.col("head").isNotNull())
    label = F.expr("trim(BOTH ' :-|' FROM regexp_extract(line, '^[^0-9$(]*', 0))")
    marked = marked.withColumn("label", F.coalesce(F.nullif(label, F.lit("")), F.col("intent.metric"))).withColumn("values", line_numbers(F.col("line")))
    each = marked.select("*", F.posexplode("head").alias("n", "y")).where(F.col("y") == F.col("intent.year").cast("string"))
    each = each.withColumn("token", F.try_element_at("values", F.col("n") + 1)).where("token IS NOT NULL")
    return _out(each, F.col("token"), F.col("line"), F.col("raw_text"), 2, "ord", "n")


def structured(rows: DataFrame) -> DataFrame:
    """Q2 without places."""
    return _structured(rows).select(*OUT)


def matrix(rows: DataFrame) -> DataFrame:
    """Q3 without places."""
    return _matrix(rows).select(*OUT)


def simple_rows(rows: DataFrame) -> DataFrame:
    """Q4 without places."""
    return _simple_rows(rows).select(*OUT)


def distinct_observations(rows: DataFrame) -> DataFrame:
    """Q5: one of each (label, metric, year, value) of a table."""
    return rows.dropDuplicates(["query_id", "table_id", "label", "metric", "year", "value"])


def selected(observations: DataFrame, questions: DataFrame) -> DataFrame:
    """The extremum by (value, evidence index, label); a segment question prefers known segments to totals."""
    q = questions.select("query_id", intent(F.col("question")).alias("i"))
    rows = observations.join(q, "query_id")
    segment = F.col("label").isin(V.ENTITIES) & ~F.col("label").isin(V.NOT_SEGMENTS)
    rows = rows.withColumn("seg", (F.col("i.hint") == "segment") & segment)
    rows = rows.withColumn("any_seg", F.max(F.coalesce("seg", F.lit(False))).over(W.partitionBy("query_id"))).where("NOT any_seg OR seg")
    key = F.when(F.col("i.operation") == "min", F.col("value")).when(F.col("i.operation") == "max", -F.col("value")).otherwise(F.lit(0.0))
    best = rows.groupBy("query_id").agg(F.min_by(F.struct("label", "value", "display_value", "table_id", "evidence_index"), F.struct(key.alias("k"), "evidence_index", "label", "value")).alias("b"))
    return best.select("query_id", "b.*")


def answers(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """Q7, Q8: (query_id, status, label, value, display_value, citation, reasoning). tables: query_id, table_id, evidence_index, headers, rows, context, raw_text.

    Defined results: a question without metric or year is unsupported, one without figures has no observation, both without
    reasoning. The text names up to eight figures of the chosen table, first ones first; of equal figures read from text, the first
    counts. Questions with a null id have no tables.
    """
    rows = asked(questions, tables)
    same = ["query_id", "table_id", "evidence_index", "label", "metric", "year", "value"]
    text = _matrix(rows).unionByName(_simple_rows(rows)).groupBy(*same).agg(F.min(F.struct("place", "display_value", "unit")).alias("o"))
    seen = _structured(rows).unionByName(text.select(*same, "o.display_value", "o.unit", "o.place"))
    best = selected(seen.drop("place"), questions)
    chosen = best.select(F.col("query_id").alias("bq"), F.col("table_id").alias("bt"), F.col("evidence_index").alias("bi"))
    # a chosen table's first eight: numbered, so that a long table is no array
    near = seen.join(chosen, (F.col("query_id") == F.col("bq")) & (F.col("evidence_index") == F.col("bi")))
    near = near.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("place", "label", "value"))).where("nth <= 8")
    near = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(": ", "label", "display_value").alias("t")))).alias("near"))
    base = questions.select("query_id", intent(F.col("question")).alias("i"))
    out = base.join(best, "query_id", "left").join(near, "query_id", "left").withColumn("citation", F.concat(F.lit("T"), F.col("evidence_index").cast("string")))
    status = F.when(F.col("i.metric").isNull() | F.col("i.year").isNull(), "unsupported_intent").when(F.col("label").isNull(), "no_observation").otherwise("supported")
    named = F.lit("selected")
    for operation, name in OPERATION_NAMES.items():
        named = F.when(F.col("i.operation") == operation, name).otherwise(named)
    # fixed values: the wording of a computed result
    text_ = F.format_string(
        "Computed table observation:\nMetric: %s\nYear: %d\nOperation: %s\nCandidates from %s: %s\nResult: %s has the %s value at %s. Cite %s for this result.",
        "i.metric", "i.year", "i.operation", "citation", F.array_join("near.t", "; "), "label", named, "display_value", "citation",
    )
    return out.select("query_id", status.alias("status"), "label", "value", "display_value", "citation", F.when(F.col("label").isNotNull(), text_).alias("reasoning"))
