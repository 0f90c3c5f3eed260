"""Relations of the engine, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their content hash and a file name."""
    d = table(spark, sf_dir, "documents")
    return d.withColumn("content_hash", F.sha2("text", 256)).withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document id: the lines of its text as blocks, ten a page; the first is a heading."""
    d = documents(spark, sf_dir)
    line = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.when(i == 0, "section_header").otherwise("text").alias("label"), (F.floor(i / 10) + 1).cast("int").alias("page"), t.alias("text")))
    return d.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("content_hash"), line.alias("blocks"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the history of jobs: a user is a document, an event type a status."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"), "value")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as an answer to the turn before it: (conv_id, turn, expected, answer)."""
    c = table(spark, sf_dir, "conversations")
    before = c.select(F.col("conv_id").alias("pc"), (F.col("turn") + 1).alias("pt"), F.col("text").alias("expected"))
    return c.where("role = 'assistant'").join(before, (F.col("conv_id") == F.col("pc")) & (F.col("turn") == F.col("pt"))).select("conv_id", "turn", "expected", F.col("text").alias("answer"))


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment and year of order: (segment, year, revenue), whole units."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), "year").agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(20,4)"))).cast("long").alias("revenue"))


def nation_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each region: a header row, then nations with counts of customers and suppliers; cells without any are blank."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("nc"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("ns"))
    each = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    row = F.struct("n_name", F.coalesce(F.col("nc").cast("string"), F.lit("")).alias("nc"), F.coalesce(F.col("ns").cast("string"), F.lit("")).alias("ns"))
    rows = each.groupBy(F.col("r_name").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    grid = F.concat(F.array(F.array(F.lit("Nation"), F.lit("Customers"), F.lit("Suppliers"))), F.transform("rows", lambda x: F.array(x["n_name"], x["nc"], x["ns"])))
    return rows.select("id", F.array(F.lit(False)).alias("flags"), grid.alias("grid"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown report a market segment, with page markers, a pipe table and lines of figures: (doc, markdown)."""
    rows = revenue(spark, sf_dir)
    each = rows.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("year", "revenue"))).alias("y"))
    text = F.concat_ws(
        "\n", F.lit("Annual report"), F.lit("<!-- page 1 -->"), F.concat(F.lit("Results of "), F.col("segment")), F.lit("(in millions, except ratios)"), F.lit(""),
        F.concat(F.lit("| Metric | "), F.array_join(F.transform("y", lambda x: x["year"].cast("string")), " | "), F.lit(" |")),
        F.concat(F.lit("|---|"), F.array_join(F.transform("y", lambda x: F.lit("---:")), "|"), F.lit("|")),
        F.concat(F.lit("| Revenue | "), F.array_join(F.transform("y", lambda x: x["revenue"].cast("string")), " | "), F.lit(" |")), F.lit(""),
        F.lit("<!-- page 2 -->"), F.lit("Figure 1: growth by year"), F.lit("Segment and corporate results"), F.lit("As of the year end"),
        F.concat(F.lit("years "), F.array_join(F.transform("y", lambda x: x["year"].cast("string")), " ")), F.lit("Notes follow here"),
        F.concat(F.lit("Total net revenue "), F.array_join(F.transform("y", lambda x: x["revenue"].cast("string")), " ")),
        F.concat(F.lit("Net income "), F.array_join(F.transform("y", lambda x: (x["revenue"] % 1000).cast("string")), " ")), F.lit(""), F.lit("See Chart 2 and figure 1."),
    )
    return each.select(F.col("segment").alias("doc"), text.alias("markdown"))


REVENUE_SQL = """rev AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS year, floor(sum(o_totalprice::DECIMAL(20,4)))::BIGINT AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

REPORT_SQL = REVENUE_SQL + """, reps AS (SELECT segment, list(year ORDER BY year) AS ys, list(revenue ORDER BY year) AS vs FROM rev GROUP BY segment),
report AS (SELECT segment AS doc, concat_ws(chr(10), 'Annual report', '<!-- page 1 -->', 'Results of ' || segment, '(in millions, except ratios)', '',
  '| Metric | ' || array_to_string(ys, ' | ') || ' |', '|---|' || array_to_string(list_transform(ys, lambda y: '---:'), '|') || '|',
  '| Revenue | ' || array_to_string(vs, ' | ') || ' |', '', '<!-- page 2 -->', 'Figure 1: growth by year', 'Segment and corporate results', 'As of the year end',
  'years ' || array_to_string(ys, ' '), 'Notes follow here', 'Total net revenue ' || array_to_string(vs, ' '),
  'Net income ' || array_to_string(list_transform(vs, lambda v: v % 1000), ' '), '', 'See Chart 2 and figure 1.') AS markdown FROM reps),
lines AS (SELECT doc, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS line FROM (SELECT doc, string_split(markdown, chr(10)) AS l FROM report))"""  # fmt: skip
