"""BM25 over any relation of texts, for one question or a batch.

Statistics hold within the scope that the caller has filtered. Postings are (id, term, tf); only those of terms that some
question uses are joined, and texts are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import contains_any, tokens

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, dl): one row for each distinct term of a document, combined before it is shuffled."""
    words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("ts")).withColumn("dl", F.size("ts")).where("dl > 0")
    return words.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """R2."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, id_col: str, text: Column, questions: DataFrame, query_id: str, question: Column) -> DataFrame:
    """(query_id, id, score) with a positive score. A word that a question repeats counts each time."""
    asked = questions.select(F.col(query_id).alias("query_id"), F.explode(tokens(question)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("ts")).withColumn("dl", F.size("ts")).where("dl > 0")
    stats = words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    used = asked.select("term").distinct()
    post = words.select("id", "dl", F.explode("ts").alias("term")).join(used, "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weighed = df.join(F.broadcast(stats)).withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return asked.join(weighed, "term").join(post, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def table_boost(question: Column, text: Column, heading: Column) -> Column:
    """Points for shared years, shared terms, named segments and question words in the heading."""
    q, t, h = F.lower(question), F.lower(text), F.lower(F.coalesce(heading, F.lit("")))
    years = F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b20[0-9][0-9]\b"), F.lit(0)))
    points = F.size(F.filter(years, lambda y: F.contains(t, y))) * 2.0
    shared = F.filter(F.array(*[F.lit(x) for x in V.BOOST_TERMS]), lambda x: F.contains(q, x) & F.contains(t, x))
    points = points + F.size(shared) * 1.5
    points = points + F.when(q.contains("segment") & contains_any(t, V.BOOST_SEGMENTS), 3.0).otherwise(0.0)
    return points + F.size(F.filter(tokens(q), lambda w: (F.length(w) >= 4) & F.contains(h, w))) * 0.5


def ranked(hits: DataFrame, k: int, by: str = "query_id", label: str | None = None) -> DataFrame:
    """The k best of each question by (score, id); ``label`` numbers them as citations."""
    order = W.partitionBy(by).orderBy(F.col("score").desc(), F.col("id"))
    out = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.withColumn("citation", F.concat(F.lit(label), F.col("rank").cast("string"))) if label else out
