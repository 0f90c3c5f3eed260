"""From hits to what a model reads, and from its answer to what is returned.

Every relation has a ``query_id``: a batch of questions is one job. The evidence of a question is bounded by its search (50 hits
a kind at most), so that the groups that are joined to one prompt are small whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import filled, joined, stripped
from lodestone.operators import fusion

# Answers without evidence, headings of a prompt, limits of texts.
NO_TABLES = "I could not find table evidence in the indexed documents to answer this question."
NO_VISUALS = "I could not find visual evidence in the indexed documents to answer this question."
NO_EVIDENCE = "I do not have enough evidence from the indexed document to answer."
SECTIONS = {"C": "Text evidence:", "T": "Table evidence:", "V": "Visual evidence:", "": "Other evidence:"}
TABLE_ROWS, NEARBY_EMBEDDED, NEARBY_READ = 80, 500, 800


def page_range(first: Column, last: Column) -> Column:
    """a-b, a, or null without a first page; 0 and null count as missing."""
    a, b = F.nullif(first, F.lit(0)), F.nullif(last, F.lit(0))
    return F.when(a != b, F.concat_ws("-", a, b)).otherwise(a.cast("string"))


def source(kind: str, id_: Column, filename: Column, first: Column, last: Column) -> Column:
    """Where evidence comes from: texts name their chunk last, tables and visuals themselves first."""
    pages = page_range(first, last)
    label = F.when(pages.isNull(), "page unknown").when(F.contains(pages, F.lit("-")), F.concat(F.lit("pages "), pages)).otherwise(F.concat(F.lit("page "), pages))
    parts = [filename, label, F.concat(F.lit("chunk "), id_)] if kind == "text" else [F.concat(F.lit(f"{kind}:"), id_), filename, label]
    return F.concat_ws(", ", *parts)


def _line(label: str, value: Column) -> Column:
    """Null, and so left out, where the value is null."""
    return F.concat(F.lit(f"{label}: "), value)


def _head(*always: tuple[str, Column]) -> list[Column]:
    return [_line(k, F.coalesce(v, F.lit(""))) for k, v in always]


def table_text(t: Column) -> Column:
    """A struct (filename, page_start, page_end, section_heading, table_type, readiness, title, caption, headers, rows, raw_text)
    as labelled lines. Tables without cells give their raw text, others at most ``TABLE_ROWS`` rows."""
    kind = F.when(t["table_type"] == "structured", "structured table").otherwise("table-like text")
    lines = _head(("Document", t["filename"]), ("Page", F.coalesce(page_range(t["page_start"], t["page_end"]), F.lit("unknown"))), ("Section", t["section_heading"]), ("Evidence Type", kind), ("Readiness", t["readiness"]))
    lines += [_line("Table Title", filled(t["title"])), _line("Caption", filled(t["caption"]))]
    rows = F.transform(F.slice(t["rows"], 1, TABLE_ROWS), lambda r: F.array_join(r, " | ", ""))
    cells = [F.when(F.size(t["headers"]) > 0, _line("Headers", F.array_join(t["headers"], ", ", ""))), F.when(F.size(t["rows"]) > 0, F.concat(F.lit("Rows:\n"), F.array_join(rows, "\n")))]
    structured = t["headers"].isNotNull() | t["rows"].isNotNull()
    body = [F.when(structured, c) for c in cells] + [F.when(~structured, F.concat(F.lit("Detected table-like text:\n"), F.coalesce(t["raw_text"], F.lit(""))))]
    return stripped(F.concat_ws("\n", *lines, *body))


def _visual_lines(v: Column, nearby: int, *more: tuple[str, Column]) -> Column:
    page = F.coalesce(page_range(v["page_start"], v["page_end"]), F.lit("unknown"))
    lines = _head(("Document", v["filename"]), ("Page", page), *more, ("Section", v["section_heading"]))
    lines += [_line("Figure Label", filled(v["figure_label"])), _line("Caption", filled(v["caption"])), _line("Nearby Text", F.substring(filled(v["nearby_text"]), 1, nearby))]
    return stripped(F.concat_ws("\n", *lines))


def visual_embedding_text(v: Column) -> Column:
    """A struct (visual_id, filename, page_start, page_end, visual_type, readiness, section_heading, figure_label, caption,
    nearby_text) as labelled lines."""
    return _visual_lines(v, NEARBY_EMBEDDED, ("Visual Type", v["visual_type"]))


def visual_reading_text(v: Column) -> Column:
    """As P7, with id and readiness and more of the text near it."""
    return _visual_lines(v, NEARBY_READ, ("Visual ID", v["visual_id"]), ("Visual Type", v["visual_type"]), ("Readiness", v["readiness"]))


def visual_word_text(v: Column) -> Column:
    """What words are searched in."""
    return joined("\n", v["caption"], v["figure_label"], v["section_heading"], v["nearby_text"], v["filename"])


def observation_text(o: Column) -> Column:
    """A struct of what a model saw in a visual, as labelled lines; empty lists and texts are left out."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, "; "))
    lines = _head(("Status", F.when(o["supported"], "supported").otherwise("not supported")), ("Observation Type", o["observation_type"]), ("Question Answered", o["question_answered"]), ("Confidence", o["confidence"]))
    lists = [("Facts", "extracted_facts"), ("Visible Entities", "visible_entities"), ("Numeric Values", "numeric_values"), ("Limitations", "limitations")]
    lines += [_line(k, listed(o[c])) for k, c in lists]
    return F.concat_ws("\n", *lines, _line("Abstain Reason", filled(o["abstain_reason"])), _line("Reasoning", filled(o["reasoning"])))


def visual_inputs(hits: DataFrame, limit: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hits (query_id, rank, visual struct) that are shown to a model: the first ``limit`` of each question, as V1, V2, ...
    Columns of ``hits`` that are named in ``carry`` come along, so that no join is needed to find them again."""
    v = F.col("visual")
    shown = hits.where(F.col("rank") <= limit)
    return shown.select("query_id", "rank", F.concat(F.lit("V"), F.col("rank")).alias("citation_id"), v["visual_id"].alias("visual_id"), visual_reading_text(v).alias("metadata_text"), source("visual", v["visual_id"], v["filename"], v["page_start"], v["page_end"]).alias("source"), *carry)


def grounding(texts: DataFrame, tables: DataFrame, observations: DataFrame, reasoned: DataFrame | None = None) -> DataFrame:
    """(query_id, citation_id, part, ord, text, source): texts as C1, C2, ..., tables as T1, T2, ..., then observations.

    ``texts`` and ``tables`` are (query_id, rank, text, source), ``observations`` (query_id, rank, citation_id, text, source). A
    question with a supported result in ``reasoned`` (query_id, evidence_index, citation_id, reasoning_text) has just the table at
    that place, after the result; an index without a table says nothing.
    """
    numbered = lambda df, letter, part: df.select("query_id", F.concat(F.lit(letter), F.col("rank")).alias("citation_id"), F.lit(part).alias("part"), F.col("rank").alias("ord"), "text", "source")
    out = numbered(texts, "C", 1)
    if reasoned is None:
        out = out.unionByName(numbered(tables, "T", 2))
    else:
        chosen = tables.select("query_id", "rank", "text", "source").join(reasoned.where("reasoning_text <> ''").withColumnRenamed("evidence_index", "rank"), ["query_id", "rank"])
        whole = F.concat(F.col("reasoning_text"), F.lit("\n\nSupporting table evidence:\n"), F.col("text"))
        out = out.unionByName(chosen.select("query_id", "citation_id", F.lit(2).alias("part"), F.col("rank").alias("ord"), whole.alias("text"), "source"))
        out = out.unionByName(numbered(tables.join(chosen.select("query_id"), "query_id", "left_anti"), "T", 2))
    return out.unionByName(observations.select("query_id", "citation_id", F.lit(3).alias("part"), F.col("rank").alias("ord"), "text", "source"))


def prompts(evidence: DataFrame) -> DataFrame:
    """Grounding to (query_id, prompt): a section a kind of citation, in the order of ``SECTIONS``."""
    item = F.concat(F.lit("["), F.col("citation_id"), F.lit("] Source: "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    letter = F.upper(F.substring("citation_id", 1, 1))
    rows = evidence.select("query_id", F.struct("part", "ord", "citation_id", F.when(letter.isin("C", "T", "V"), letter).otherwise("").alias("kind"), item.alias("item")).alias("r"))
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))

    def section(kind: str) -> Column:
        own = F.filter("rows", lambda r: r["kind"] == kind)
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{SECTIONS[kind]}\n"), F.array_join(own["item"], "\n\n")))

    return rows.select("query_id", F.concat_ws("\n\n", *[section(k) for k in SECTIONS]).alias("prompt"))


def indexed_only(records: DataFrame, point: str = "point_id") -> DataFrame:
    """Records of tables or visuals that have a vector."""
    return records.where(F.col(point).isNotNull())


def records_of(hits: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Hits (query_id, rank, score, key) with their records; hits without one go, ranks keep the order."""
    both = hits.join(records, key)
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """a table of the catalog, or no rows where it has not been made yet."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def search(mode: str, dense: Callable[[int], DataFrame], lexical: Callable[[int], DataFrame], k: int) -> DataFrame:
    """(query_id, rank, id, score) by vectors, by words, or by both with twice as many hits each. The searches take how many
    hits they give; only those that the mode needs are planned."""
    if mode == "hybrid":
        return fusion.hybrid(dense(2 * k), lexical(2 * k), k).withColumnRenamed("hybrid_score", "score").select("query_id", "rank", "id", "score")
    if mode not in ("dense", "bm25"):
        raise ValueError(f"unsupported retrieval mode: {mode}")
    return (dense if mode == "dense" else lexical)(k).select("query_id", "rank", "id", "score")


def candidates(rerank: bool, top_n: int, k: int) -> int:
    """How many hits a search gives."""
    return max(top_n, k) if rerank else k


def optionally_reranked(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]] | None, k: int) -> DataFrame:
    """Pairs (query_id, id, rank, question, text) to (query_id, id, pre_rank, rank, rerank_score, status), k a question.

    Without a model, the order stays and the status is disabled. A model that can't be loaded (unavailable), or that fails on a
    question or gives it another number of scores than it has pairs (failed), leaves that question's order as it was, without scores; other questions are applied. Failures are rows, not
    exceptions, so that a task that is tried again says the same.
    """
    q, i = (pairs.schema[c].dataType.simpleString() for c in ("query_id", "id"))
    if load is None:
        scored = pairs.select("query_id", "id", F.lit(None).cast("double").alias("rerank_score"), F.lit("disabled").alias("status"), "rank")
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            try:
                model, why = load(), None
            except Exception:  # noqa: BLE001 - a missing model is a status
                model, why = None, "unavailable"
            for f in frames:
                for _, part in f.groupby("query_id", sort=False, dropna=False):
                    scores, status = None, why or "applied"
                    if model is not None:
                        try:
                            found = [float(x) for x in model(list(zip(part.question, part.text, strict=True)))]
                            if len(found) != len(part):
                                raise ValueError("a score a pair is needed")
                            scores = found
                        except Exception:  # noqa: BLE001 - so is a question that it can't score
                            status = "failed"
                    yield part[["query_id", "id", "rank"]].assign(rerank_score=pd.Series(scores, part.index, "float64"), status=status)[["query_id", "id", "rerank_score", "status", "rank"]]

        scored = pairs.select("query_id", "id", "rank", "question", "text").mapInPandas(run, f"query_id {q}, id {i}, rerank_score double, status string, rank int")
    own = W.partitionBy("query_id")
    # a question may come in several batches: it is applied only if all of them were
    worst = F.max(F.when(F.col("status") != "applied", F.col("status"))).over(own)
    out = scored.withColumn("status", F.coalesce(worst, F.lit("applied"))).withColumn("rerank_score", F.when(F.col("status") == "applied", F.col("rerank_score")))
    out = out.withColumnRenamed("rank", "pre_rank").withColumn("rank", F.row_number().over(own.orderBy(F.col("rerank_score").desc_nulls_last(), "pre_rank")))
    return out.where(F.col("rank") <= k).select("query_id", "id", "pre_rank", "rank", "rerank_score", "status")


def empty_answer(mode: Column) -> Column:
    """The answer to a question without any evidence."""
    return F.when(mode == "table", NO_TABLES).when(mode == "visual", NO_VISUALS).otherwise(NO_EVIDENCE)


def outcomes(questions: DataFrame, answers: DataFrame, evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """questions (query_id, mode) to (query_id, answer, status): what a question's answer is after the check of its citations.

    Without evidence, the answer says so, whatever a model said. ``verdicts`` (query_id, verdict, revised_answer) replace an answer
    that is not supported, and one that is in part where they give another. Questions without an answer have an empty one.
    """
    seen = evidence.select("query_id").distinct().withColumn("__seen", F.lit(True))
    both = questions.select("query_id", "mode").join(answers.select("query_id", "answer"), "query_id", "left").join(seen, "query_id", "left").join(verdicts.select("query_id", "verdict", filled(F.col("revised_answer")).alias("__new")), "query_id", "left")
    status = F.when(F.col("__seen").isNull(), "no_evidence").otherwise(F.coalesce("verdict", F.lit("unchecked")))
    answer = F.when(F.col("__seen").isNull(), empty_answer(F.col("mode"))).when(F.col("verdict") == "unsupported", F.coalesce("__new", F.lit(NO_EVIDENCE)))
    answer = answer.when(F.col("verdict") == "partially_supported", F.coalesce("__new", "answer")).otherwise(F.col("answer"))
    return both.select("query_id", F.coalesce(answer, F.lit("")).alias("answer"), status.alias("status"))


def scope_error(scope: Column, content_hash: Column, ids: Column, max_documents: Column, per_document: Column) -> Column:
    """why a question's scope can't be searched, null if it can. Null and empty hashes and lists count as missing."""
    hashed, n = filled(content_hash).isNotNull(), F.coalesce(F.size(ids), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return (
        F.when(~F.coalesce(scope, F.lit("")).isin("single", "doc_ids", "all"), F.concat(F.lit("Unsupported query scope: "), F.coalesce(scope, F.lit("None"))))
        .when(~max_documents.between(1, 25), "max_documents must be between 1 and 25.")
        .when(~per_document.between(1, 10), "max_evidence_per_document must be between 1 and 10.")
        .when((scope == "single") & hashed & (n > 0), "scope='single' accepts content_hash or one document identifier, not both.")
        .when((scope == "single") & ~hashed & (n != 1), "scope='single' requires content_hash or exactly one doc_id/document_id.")
        .when((scope == "doc_ids") & hashed, "scope='doc_ids' does not accept content_hash.")
        .when((scope == "doc_ids") & (n == 0), "scope='doc_ids' requires doc_ids or document_ids.")
        .when((scope == "all") & (hashed | (n > 0)), "scope='all' cannot be combined with document filters.")
    )
