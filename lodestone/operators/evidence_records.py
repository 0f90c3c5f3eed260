"""Every kind of table, and every kind of picture, as one relation of evidence (X4, X14 and their numbering).

Defined results: documents without tables or pictures give no rows; null texts, grids, pages and captions count as absent; a text
that a document holds twice is one record, the first in the order of kinds (grids, pipe tables, table-like text) and places;
the document's id is the key and must not be null: joins by it lose table-like text and named figures of rows without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import collapsed, stripped
from lodestone.operators import tables, visuals
from lodestone.sources.stored import kept

PART = ("doc", "section")
TABLE = ["doc", "kind", "start", "page", "title", "section_heading", "raw_text", "markdown_table", "n_rows", "n_cols", "has_header", "empty_cell_ratio", "readiness", "risk_flags", "source_chunk_id", "span_hash"]


def rows_to_text(rows: Column) -> Column:
    """Rows of cells as lines, cells between bars."""
    return stripped(F.array_join(F.transform(rows, lambda r: stripped(F.array_join(F.transform(r, stripped), " | "))), "\n"))


def rows_to_markdown(headers: Column, rows: Column) -> Column:
    """A pipe table; plain lines without headers."""
    every = F.concat(F.array(headers, F.transform(headers, lambda h: F.lit("---"))), rows)
    piped = F.array_join(F.transform(every, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    return F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, piped).otherwise(rows_to_text(rows))


def grid_records(grids: DataFrame) -> DataFrame:
    """Grids (doc, ord, page, caption, heading, flags, grid) as records, with their text and a pipe table where they have headers."""
    out = tables.grid_tables(grids).withColumn("raw_text", rows_to_text(F.col("clean"))).withColumn("caption", F.nullif(stripped(F.col("caption")), F.lit("")))
    out = out.withColumn("markdown_table", F.when(F.col("has_header"), rows_to_markdown(F.col("headers"), F.col("rows"))))
    return out.select("doc", F.lit(0).alias("kind"), F.col("ord").alias("start"), "page", F.col("caption").alias("title"), F.col("heading").alias("section_heading"), "raw_text", "markdown_table", "n_rows", "n_cols", "has_header", "empty_cell_ratio", "readiness", "risk_flags", F.lit(None).cast("string").alias("source_chunk_id"), F.sha2("raw_text", 256).alias("span_hash"))


def pipe_records(rows: DataFrame, chunks: DataFrame | None = None, fallback_used: bool = False, split: DataFrame | None = None) -> DataFrame:
    """Lines (doc, ord, line) to records of pipe tables, page by page. ``split``: ``tables.pages`` of the lines where they are
    written already.

    A run of lines with a bar holds at most one table: from the first line that a separator follows to the run's end. Rows
    without a filled cell are dropped. The title is the nearest line of up to nine before it that has no number.
    """
    split = tables.pages(rows) if split is None else split
    order = W.partitionBy(*PART).orderBy("ord")
    piped = F.coalesce(F.contains("line", F.lit("|")), F.lit(False))
    marked = split.withColumn("before", F.collect_list("line").over(order.rowsBetween(-9, -1)))
    marked = marked.withColumn("piped", piped).withColumn("run", F.sum((~F.col("piped")).cast("int")).over(order))
    head = F.col("piped") & F.coalesce(F.lead(F.col("line").rlike(V.SEPARATOR_LINE)).over(order), F.lit(False))
    # only a table's first line is asked for the lines before it: the others don't carry them through the next sort
    marked = marked.withColumn("head", head).withColumn("before", F.when(F.col("head"), F.col("before"))).where("piped").withColumn("start", F.min(F.when(F.col("head"), F.col("ord"))).over(W.partitionBy(*PART, "run")))
    marked = marked.where("ord >= start").withColumn("before", F.when(F.col("ord") == F.col("start"), F.reverse("before")))
    line = F.when(F.col("has_markers"), F.regexp_replace("line", r"\s+$", "")).otherwise(F.col("line"))
    made = marked.groupBy(*PART, "run", "start", "page", "has_markers").agg(F.max("before").alias("before"), F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    cells = lambda t: F.transform(F.split(F.regexp_replace(stripped(t), r"^\|+|\|+$", ""), r"\|"), collapsed)
    body = F.transform(F.slice("l.line", F.lit(3), F.size("l")), cells)
    made = made.withColumn("raw_text", stripped(F.array_join("l.line", "\n"))).withColumn("headers", cells(F.col("l.line")[0]))
    made = made.withColumn("rows", F.filter(body, lambda r: F.exists(r, lambda c: c != ""))).withColumn("grid", F.concat(F.array("headers"), "rows"))
    made = made.withColumn("title", tables.heading(F.col("before")))
    made = made.withColumn("n_rows", F.size("rows")).withColumn("n_cols", F.array_max(F.transform("grid", F.size))).withColumn("empty_cell_ratio", F.round(tables.empty_ratio(F.col("grid")), 6))
    flags = F.concat(tables.risk_flags(F.lit(True), F.col("n_rows"), F.col("n_cols"), F.col("empty_cell_ratio")), F.array(F.when(~F.col("has_markers"), "missing_page_markers"), F.when(F.lit(fallback_used), "fallback_parser_used")))
    made = made.withColumn("risk_flags", F.array_sort(F.array_compact(flags))).withColumn("readiness", F.when((F.col("n_rows") >= 1) & (F.col("n_cols") >= 2), "good").otherwise("weak"))
    if chunks is None:
        made = made.withColumn("source_chunk_id", F.lit(None).cast("string"))
    else:
        near = tables.nearest_chunk(made.select("doc", F.col("start").alias("id"), F.col("page").alias("page_start"), F.col("page").alias("page_end")), chunks)
        made = made.join(near.select(F.col("doc").alias("nd"), F.col("id").alias("ni"), F.col("chunk_id").alias("source_chunk_id")), (F.col("doc") == F.col("nd")) & (F.col("start") == F.col("ni")), "left")
    return made.select("doc", F.lit(1).alias("kind"), "start", "page", "title", F.col("title").alias("section_heading"), "raw_text", F.col("raw_text").alias("markdown_table"), "n_rows", "n_cols", F.lit(True).alias("has_header"), "empty_cell_ratio", "readiness", "risk_flags", "source_chunk_id", F.sha2("raw_text", 256).alias("span_hash"))


def _first(records: DataFrame) -> DataFrame:
    """One record of each text of a document."""
    return records.withColumn("nth", F.row_number().over(W.partitionBy("doc", "span_hash").orderBy("kind", "start"))).where("nth = 1").drop("nth")


def table_records(rows: DataFrame, grids: DataFrame | None = None, chunks: DataFrame | None = None, fallback_used: bool = False, most: int | None = 10_000) -> DataFrame:
    """X14 of tables: grids, then pipe tables, then table-like text of ``rows``, numbered on within a document.

    (doc, table_index, table_id, table_type, source_kind, page, title, section_heading, raw_text, markdown_table, n_rows, n_cols,
    has_header, empty_cell_ratio, readiness, risk_flags, source_chunk_id, span_hash). Grids and pipe tables have their number in
    their id, table-like text its number within the nearest chunk, else page.
    """
    # lines are split by page once for all kinds; grids and pipe tables are read twice, as records and as texts that are not repeated
    split = kept(tables.pages(rows), "table-lines")
    whole = pipe_records(rows, chunks, fallback_used, split).select(*TABLE)
    whole = kept(_first(whole if grids is None else grid_records(grids).select(*TABLE).unionByName(whole)), "table-records")
    like = tables.span_records(rows, chunks, fallback_used, most, whole.select("doc", "span_hash"), split)
    none = {"markdown_table": "string", "n_cols": "int", "empty_cell_ratio": "double"}
    like = like.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"kind": F.lit(2), "has_header": F.lit(False), "readiness": F.lit("weak"), "section_heading": F.col("title")})
    every = whole.withColumn("table_id", F.lit(None).cast("string")).unionByName(like.select(*TABLE, "table_id"))
    out = every.withColumn("table_index", F.row_number().over(W.partitionBy("doc").orderBy("kind", "start")) - 1)
    names = F.array(F.lit("docling_table"), F.lit("markdown_table"), F.lit("text_pattern"))
    out = out.withColumn("source_kind", names[F.col("kind")]).withColumn("table_type", F.when(F.col("kind") < 2, "structured").otherwise("table_like_text"))
    out = out.withColumn("table_id", F.coalesce("table_id", F.format_string("%s:table:%04d", F.substring("doc", 1, 12), "table_index")))
    return out.select("doc", "table_index", "table_id", "table_type", "source_kind", *TABLE[3:])


def page_texts(docs: DataFrame) -> DataFrame:
    """docs (content_hash, markdown) to (content_hash, page, text): what follows each page comment; the last of equal pages wins."""
    comment = r"(?i)<!--\s*page\s+([0-9]+)\s*-->"
    parts = F.arrays_zip(F.regexp_extract_all("markdown", F.lit(comment), F.lit(1)).alias("page"), F.slice(F.split("markdown", comment), F.lit(2), F.greatest(F.size(F.split("markdown", comment)) - 1, F.lit(0))).alias("text"))
    each = docs.select("content_hash", F.posexplode(parts).alias("n", "p")).select("content_hash", "n", F.col("p.page").try_cast("int").alias("page"), stripped(F.col("p.text")).alias("text"))
    return each.where("page IS NOT NULL").groupBy("content_hash", "page").agg(F.max_by("text", "n").alias("text"))


def visual_records(docs: DataFrame, headings: DataFrame | None = None, most: int | None = 800) -> DataFrame:
    """X14 of visuals: pictures, page renders, and figures that the text names where no picture has a page, numbered as their kind does.

    docs: content_hash, pictures array<struct<caption,page>>, page_count, figure_count, artifact_dir, markdown. Result: (content_hash,
    visual_index, visual_id, source_kind, page, artifact_path, caption, figure_label, section_heading, nearby_text, readiness,
    span_hash). A page's text is cut at ``most`` characters (the record's own limit; None cuts nothing); ``headings``: doc, ord, page, text.
    """
    short = F.substring("content_hash", 1, 12)
    pictures = visuals.pictures(docs).withColumn("visual_index", F.regexp_extract("visual_id", r"([0-9]+)$", 1).cast("int"))
    pictures = pictures.select("content_hash", "visual_index", "visual_id", F.lit("docling_picture").alias("source_kind"), "page", "caption", "figure_label", "readiness", F.sha2(F.format_string("%s:picture:%d", "content_hash", "visual_index"), 256).alias("span_hash"))
    none = F.lit(None).cast("string")
    renders = visuals.page_renders(docs).select("content_hash", (F.col("page") - 1).alias("visual_index"), "visual_id", F.lit("page_render").alias("source_kind"), "page", none.alias("caption"), none.alias("figure_label"), "readiness", none.alias("span_hash"))
    placed = docs.withColumn("pictures_with_page", F.coalesce(F.size(F.filter("pictures", lambda p: p["page"].isNotNull())), F.lit(0)))
    before = docs.select(F.col("content_hash").alias("bd"), (F.greatest(F.coalesce(F.size("pictures"), F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("page_count", F.lit(0)), F.lit(0))).alias("before"))
    named = visuals.figure_candidates(placed).join(before, F.col("content_hash") == F.col("bd"))
    named = named.withColumn("visual_index", F.col("before") + F.row_number().over(W.partitionBy("content_hash").orderBy("at")) - 1)
    named = named.select("content_hash", "visual_index", F.format_string("%s:figcand:%04d", short, "visual_index").alias("visual_id"), F.lit("text_reference").alias("source_kind"), "page", none.alias("caption"), F.col("label").alias("figure_label"), F.lit("poor").alias("readiness"), F.sha2(F.format_string("%s:figcand:%s", "content_hash", "label"), 256).alias("span_hash"), "nearby_text")
    near = page_texts(docs).select(F.col("content_hash").alias("ph"), F.col("page").alias("pp"), F.nullif(F.col("text") if most is None else F.substring("text", 1, most), F.lit("")).alias("nearby_text"))
    whole = pictures.unionByName(renders)
    whole = whole.join(near, (F.col("content_hash") == F.col("ph")) & (F.col("page") == F.col("pp")), "left").drop("ph", "pp").unionByName(named)
    folders = docs.select(F.col("content_hash").alias("fd"), "artifact_dir")
    path = F.when(F.col("page") != 0, F.concat(F.col("artifact_dir"), F.format_string("/visuals/pages/page_%04d.jpg", "page")))
    whole = whole.join(folders, F.col("content_hash") == F.col("fd"), "left").withColumn("artifact_path", path)
    if headings is None:
        whole = whole.withColumn("section_heading", none)
    else:
        at = tables.heading_as_of(whole.select(F.col("content_hash").alias("doc"), F.col("visual_id").alias("id"), "page"), headings)
        whole = whole.join(at.select(F.col("id").alias("hi"), F.col("doc").alias("hd"), F.col("heading").alias("section_heading")), (F.col("content_hash") == F.col("hd")) & (F.col("visual_id") == F.col("hi")), "left")
    return whole.select("content_hash", "visual_index", "visual_id", "source_kind", "page", "artifact_path", "caption", "figure_label", "section_heading", "nearby_text", "readiness", "span_hash")
