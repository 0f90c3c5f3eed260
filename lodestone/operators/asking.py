"""From questions to cited answers as one job (query service; R18, R19; answers, citations, debug record).

A batch of questions is searched and read; the questions whose answer declines, though there was evidence, are searched once more
with more hits and read again. Only those go again: answers that stand are written, and neither searched nor read twice.

Defined results: a question without hits gets the fixed answer of its mode and no second search; a question that a reader gives no
answer has an empty one; citations that name no evidence are left out; rows with a null query_id are left out; of rows that repeat
a query_id one is asked. No questions give no answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import abstains_in_query as abstains
from lodestone.functions.text import citation_ids
from lodestone.operators import grounding, ranking
from lodestone.sources.stored import kept

Search = Callable[[DataFrame, int], DataFrame]  #: questions and k to (query_id, rank, id, text, source)
Read = Callable[[DataFrame], DataFrame]  #: (query_id, question, prompt) to (query_id, answer)


def _prompts(hits: DataFrame) -> DataFrame:
    texts = hits.select("query_id", "rank", "text", "source")
    none = texts.where(F.lit(False))
    return grounding.prompts(grounding.grounding(texts, none, none.select("query_id", "rank", F.lit("").alias("citation_id"), "text", "source")))


def _read(questions: DataFrame, hits: DataFrame, read: Read, tag: str) -> DataFrame:
    """(query_id, answer) of the questions with hits, read once."""
    asked = questions.join(_prompts(hits), "query_id").select("query_id", "question", "prompt")
    answers = read(asked).select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))
    return kept(answers, f"answers-{tag}")


def answered(questions: DataFrame, search: Search, read: Read, top_k: int = 4, verify: Read | None = None) -> DataFrame:
    """questions (query_id, question, mode) to one row each: answer, status, the citations that it uses (of the evidence it was read
    from), and the debug record: how many hits, whether a second search was made, with how many hits, and how each answer was.

    ``verify`` gives verdicts (query_id, verdict, revised_answer) on (query_id, question, prompt with the answer)."""
    asked = kept(questions.where("query_id IS NOT NULL").dropDuplicates(["query_id"]).select("query_id", "question", "mode"), "asked")
    first = kept(search(asked, top_k), "hits-first")
    answers = _read(asked, first, read, "first")
    again = answers.where(abstains(F.col("answer"))).join(asked.where("mode IN ('text', 'auto')").select("query_id"), "query_id", "left_semi").select("query_id")
    retry_k = ranking.retry_size(top_k)
    retried = asked.join(again, "query_id", "left_semi")
    more = kept(search(retried, retry_k), "hits-again")
    second = _read(retried, more, read, "again")

    hits = first.join(again, "query_id", "left_anti").unionByName(more)
    last = answers.join(again, "query_id", "left_anti").unionByName(second)
    declined = lambda df, name: df.select("query_id", abstains(F.col("answer")).alias(name))
    if verify is None:
        verdicts = last.select("query_id", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("revised_answer")).where(F.lit(False))
    else:
        shown = asked.join(_prompts(hits), "query_id").join(last, "query_id")
        verdicts = kept(verify(shown.select("query_id", "question", F.concat("prompt", F.lit("\n\nAnswer:\n"), "answer").alias("prompt"))), "verdicts")
    out = grounding.outcomes(asked, last, hits, verdicts)
    # citations in order of the evidence, once each
    named = out.select("query_id", F.explode(citation_ids(F.col("answer"))).alias("citation_id"))
    cited = hits.select("query_id", "rank", "id", F.concat(F.lit("C"), F.col("rank")).alias("citation_id")).join(named, ["query_id", "citation_id"])
    cited = cited.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("rank", "citation_id", "id"))).alias("c"))
    counts = hits.groupBy("query_id").agg(F.count("*").alias("retrieved_count"))
    debug = out.join(cited, "query_id", "left").join(counts, "query_id", "left").join(declined(answers, "initial_answer_was_abstention"), "query_id", "left")
    debug = debug.join(again.withColumn("abstention_retry_triggered", F.lit(True)), "query_id", "left").join(declined(second, "retry_answer_was_abstention"), "query_id", "left")
    no = F.lit(False)
    triggered = F.coalesce("abstention_retry_triggered", no)
    citations = F.coalesce(F.col("c.citation_id"), F.array().cast("array<string>"))
    return debug.select(
        "query_id", "answer", "status", citations.alias("citations"), F.coalesce("retrieved_count", F.lit(0).cast("long")).alias("retrieved_count"), F.size(citations).alias("answer_citation_count"),
        triggered.alias("abstention_retry_triggered"), F.lit(top_k).alias("initial_top_k"), F.when(triggered, F.lit(retry_k)).alias("retry_top_k"),
        F.coalesce("initial_answer_was_abstention", no).alias("initial_answer_was_abstention"), "retry_answer_was_abstention",
    )
