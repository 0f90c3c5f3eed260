"""Table evidence from markdown lines and cell grids (X1-X10, J9-J11). Lines are rows (doc, ord, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import collapsed, contains_any, numeric, stripped


def lines(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, ord, line), split at line feeds only."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text, "\n")).alias("ord", "line"))


def pages(rows: DataFrame) -> DataFrame:
    """(doc, ord, line, page, section, has_markers) without the markers; lines before the first marker have no page."""
    marker = F.coalesce(F.nullif(F.regexp_extract("line", V.PAGE_MARKER, 1), F.lit("")), F.nullif(F.regexp_extract("line", V.PAGE_MARKER, 2), F.lit("")))
    order = W.partitionBy("doc").orderBy("ord")
    out = rows.withColumn("marker", marker.try_cast("int")).withColumn("page", F.last("marker", ignorenulls=True).over(order))
    out = out.withColumn("section", F.count("marker").over(order))
    out = out.withColumn("has_markers", F.max(F.col("marker").isNotNull()).over(W.partitionBy("doc")))
    return out.where("marker IS NULL").drop("marker")


def cells(line: Column) -> Column:
    """A pipe row's cells."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", ""), r"\|"), collapsed)


def pipe_tables(rows: DataFrame) -> DataFrame:
    """(doc, start, headers, rows, n_rows, n_cols, readiness): a header row, a separator row, then rows until a line without a pipe."""
    order = W.partitionBy("doc").orderBy("ord")
    piped, separator = F.contains(F.col("line"), F.lit("|")), F.col("line").rlike(V.SEPARATOR_LINE)
    marked = rows.withColumn("piped", piped).withColumn("sep", separator)
    marked = marked.withColumn("head", F.col("piped") & ~F.col("sep") & F.coalesce(F.lead("sep").over(order), F.lit(False)))
    marked = marked.withColumn("start", F.last(F.when(F.col("head"), F.col("ord")), ignorenulls=True).over(order))
    # the first line after the start that ends the table
    marked = marked.withColumn("ended", F.max(~F.col("piped")).over(W.partitionBy("doc", "start").orderBy("ord")))
    inside = marked.where("start IS NOT NULL AND NOT ended AND NOT (sep AND ord = start + 1)")
    row = F.struct("ord", cells(F.col("line")).alias("cells"))
    made = inside.groupBy("doc", "start").agg(F.array_sort(F.collect_list(row)).alias("all"))
    made = made.select("doc", "start", F.element_at("all.cells", 1).alias("headers"), F.slice("all.cells", F.lit(2), F.size("all")).alias("rows"))
    made = made.withColumn("n_rows", F.size("rows")).withColumn("n_cols", F.size("headers"))
    return made.withColumn("readiness", F.when((F.col("n_rows") >= 1) & (F.col("n_cols") >= 2), "good").otherwise("weak"))


def line_score(line: Column) -> Column:
    """X6."""
    low = F.lower(line)
    numbers, years = F.regexp_count(line, F.lit(V.LINE_NUMBER)), F.regexp_count(line, F.lit(V.YEAR))
    score = F.when(numbers >= 3, 3).when(numbers >= 1, 1).otherwise(0) + F.when(years >= 2, 2).otherwise(0)
    score = score + F.when(contains_any(low, ["$", "%", "billion", "million"]), 1).otherwise(0)
    score = score + F.when(contains_any(low, V.FINANCIAL_TERMS), 2).otherwise(0)
    return score + F.when(line.rlike(r"[0-9]\s{2,}[0-9]"), 1).otherwise(0)


def spans(rows: DataFrame, least: int = 3, by: tuple[str, ...] = ("doc",), behind: int = 0) -> DataFrame:
    """(doc, first, last, highs): islands of high lines; one line that is not blank may lie between two of them. They end with a part
    ``by``. With ``behind``, so many lines before the first come along, the nearest first."""
    order = W.partitionBy(*by).orderBy("ord")
    scored = rows.withColumn("high", line_score(F.col("line")) >= least).withColumn("before_blank", F.trim(F.lag("line").over(order)) == "")
    if behind:
        scored = scored.withColumn("behind", lines_before(behind, by))
    high = scored.where("high").withColumn("gap", F.col("ord") - F.lag("ord").over(order))
    fresh = F.col("gap").isNull() | (F.col("gap") > 2) | ((F.col("gap") == 2) & F.col("before_blank"))
    high = high.withColumn("island", F.sum(fresh.cast("int")).over(order))
    own = [F.max(F.when(fresh, F.col("behind"))).alias("behind")] if behind else []  # one line of an island is its first
    out = high.groupBy(*by, "island").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("highs"), *own)
    return out.where("highs >= 2 AND last - first + 1 >= 3").drop("island")


def heading(before: Column) -> Column:
    """Of lines, the nearest first, the first that has text, at most 120 characters and no number."""
    bare = F.transform(before, lambda x: stripped(F.regexp_replace(stripped(x), "^#+|#+$", "")))
    return F.try_element_at(F.filter(bare, lambda t: (t != "") & (F.length(t) <= 120) & ~F.call_function("regexp_like", t, F.lit("[0-9]"))), F.lit(1))


def span_start(ord_: Column, before: Column) -> Column:
    """Where a span that would begin at a line starts, by the lines before it (ord, line), the nearest first."""

    def step(s: Column, x: Column) -> Column:
        low = F.lower(x["line"])
        goes = ~s["stop"] & (stripped(x["line"]) != "") & ((F.length(stripped(x["line"])) <= 140) | contains_any(low, V.FINANCIAL_TERMS))
        return F.struct(F.when(goes, x["ord"]).otherwise(s["at"]).alias("at"), (~goes).alias("stop"))

    return F.aggregate(before, F.struct(ord_.alias("at"), F.lit(False).alias("stop")), step)["at"]


def lines_before(n: int, by: tuple[str, ...]) -> Column:
    """The ``n`` lines (ord, line) before each line, the nearest first."""
    return F.reverse(F.collect_list(F.struct("ord", "line")).over(W.partitionBy(*by).orderBy("ord").rowsBetween(-n, -1)))


def look_behind(rows: DataFrame, by: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Each line with the start of a span that would begin at it, and the heading before it."""
    out = rows.withColumn("seven", lines_before(7, by)).withColumn("nine", lines_before(9, by))
    return out.select(*by, "ord", span_start(F.col("ord"), F.col("seven")).alias("span_start"), heading(F.transform("nine", lambda x: x["line"])).alias("heading"))


def span_records(rows: DataFrame, chunks: DataFrame | None = None, fallback_used: bool = False, most: int | None = 10_000, seen: DataFrame | None = None, split: DataFrame | None = None) -> DataFrame:
    """Lines (doc, ord, line) to table-like text as evidence, page by page.

    (doc, start, table_id, page, title, raw_text, n_rows, risk_flags, source_chunk_id, span_hash): spans with the lines before them,
    of three lines or more after a cut at ``most`` characters (the record's own limit; None cuts nothing), each text once a document
    and none that ``seen`` (doc, span_hash) has. Ids count within the nearest chunk of ``chunks``, else the page, else 0.
    ``split``: ``pages`` of the lines where they are written already.
    """
    part = ("doc", "section")
    lines_ = pages(rows) if split is None else split
    # a span starts up to 7 lines before its first line, its heading is one of the 9 before that: only spans are looked at
    found = spans(lines_, by=part, behind=16).withColumn("start", span_start(F.col("first"), F.slice("behind", 1, 7)))
    title = heading(F.transform(F.slice(F.filter("behind", lambda x: x["ord"] < F.col("start")), 1, 9), lambda x: x["line"]))
    found = found.select("doc", "start", "first", title.alias("title"), F.explode(F.sequence("start", "last")).alias("ord"))
    text = found.join(lines_, ["doc", "ord"]).groupBy("doc", "start", "first", "page", "has_markers").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"), F.max("title").alias("title"))
    text = text.withColumn("raw_text", stripped(F.array_join("l.line", "\n")))
    if most is not None:
        text = text.withColumn("raw_text", F.when(F.length("raw_text") > most, stripped(F.substring("raw_text", 1, most))).otherwise(F.col("raw_text")))
    text = text.withColumn("n_rows", F.size(F.split("raw_text", "\n"))).where("n_rows >= 3").withColumn("span_hash", F.sha2("raw_text", 256))
    if seen is not None:
        text = text.join(seen, ["doc", "span_hash"], "left_anti")
    once = text.withColumn("n", F.row_number().over(W.partitionBy("doc", "span_hash").orderBy("first"))).where("n = 1")
    out = once.drop("l", "n")
    if chunks is None:
        out = out.withColumn("chunk_index", F.lit(None).cast("int")).withColumn("source_chunk_id", F.lit(None).cast("string"))
    else:
        near = nearest_chunk(out.select("doc", F.col("first").alias("id"), F.col("page").alias("page_start"), F.col("page").alias("page_end")), chunks)
        out = out.join(near.select("doc", F.col("id").alias("first"), "chunk_index", F.col("chunk_id").alias("source_chunk_id")), ["doc", "first"], "left")
    out = out.withColumn("chunk_index", F.coalesce("chunk_index", "page", F.lit(0)))
    nth = F.row_number().over(W.partitionBy("doc", "chunk_index").orderBy("first")) - 1
    flags = F.array_sort(F.array_compact(F.array(F.lit("fallback_parser_used" if fallback_used else "fallback_text_span"), F.when(~F.col("has_markers"), "missing_page_markers"))))
    out = out.withColumn("table_id", F.format_string("%s:table_text:%04d:%02d", F.substring("doc", 1, 12), "chunk_index", nth)).withColumn("risk_flags", flags)
    return out.select("doc", "start", "table_id", "page", "title", "raw_text", "n_rows", "risk_flags", "source_chunk_id", "span_hash")


def evidence(rows: DataFrame, **options) -> DataFrame:
    """Pipe tables, then table-like spans, numbered on within a document: (doc, table_index, source_kind, start, n_rows, readiness)."""
    piped = pipe_tables(rows).select("doc", F.lit("markdown").alias("source_kind"), "start", "n_rows", "readiness", F.lit(1).alias("kind"))
    like = span_records(rows, **options).select("doc", F.lit("text_pattern").alias("source_kind"), "start", "n_rows", F.lit("weak").alias("readiness"), F.lit(2).alias("kind"))
    nth = F.row_number().over(W.partitionBy("doc").orderBy("kind", "start")) - 1
    return piped.unionByName(like).select("doc", nth.alias("table_index"), "source_kind", "start", "n_rows", "readiness")


def header_row(flags: Column, first_row: Column) -> Column:
    """A flagged cell in the first row, or at least as many text cells as numbers there."""
    text = F.size(F.filter(first_row, lambda c: (c != "") & numeric(c).isNull()))
    numbers = F.size(F.filter(first_row, lambda c: numeric(c).isNotNull()))
    return F.coalesce(F.exists(flags, lambda f: f), F.lit(False)) | (text >= F.greatest(F.lit(1), numbers))


def empty_ratio(rows: Column) -> Column:
    """Null without cells."""
    flat = F.flatten(rows)
    return F.size(F.filter(flat, lambda c: F.trim(c) == "")) / F.nullif(F.size(flat), F.lit(0))


def grid_tables(grids: DataFrame) -> DataFrame:
    """(id, flags, grid) to headers, rows, readiness, empty_cell_ratio and risk flags; blank rows are dropped."""
    rows = F.filter(F.transform("grid", lambda r: F.transform(r, collapsed)), lambda r: F.exists(r, lambda c: c != ""))
    out = grids.withColumn("clean", rows).where(F.size("clean") > 0)
    out = out.withColumn("has_header", header_row(F.col("flags"), F.element_at("clean", 1)))
    out = out.withColumn("headers", F.when(F.col("has_header"), F.element_at("clean", 1)))
    out = out.withColumn("rows", F.when(F.col("has_header"), F.slice("clean", F.lit(2), F.size("clean"))).otherwise(F.col("clean")))
    out = out.withColumn("n_rows", F.size("rows")).withColumn("n_cols", F.array_max(F.transform("clean", F.size)))
    out = out.withColumn("readiness", F.when(F.col("has_header") & (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2), "good").otherwise("weak"))
    return out.withColumn("empty_cell_ratio", F.round(empty_ratio(F.col("clean")), 6)).withColumn("risk_flags", risk_flags(F.col("has_header"), F.col("n_rows"), F.col("n_cols"), F.col("empty_cell_ratio")))


def risk_flags(header: Column, n_rows: Column, n_cols: Column, empty: Column) -> Column:
    """X10, in order of name."""
    flags = [
        F.when(~header, "missing_header"), F.when(n_rows <= 1, "single_row_table"), F.when(n_cols < 2, "single_column_table"),
        F.when(empty > 0.35, "many_empty_cells"),
    ]
    return F.array_sort(F.array_compact(F.array(*flags)))


def dense_grid(cells_: DataFrame) -> DataFrame:
    """X1 for cell lists: (id, r, c, r_end, c_end, text) to (id, grid), each cell at its start; the last of equal places wins by position."""
    size = cells_.groupBy("id").agg(F.max("r_end").alias("nr"), F.max("c_end").alias("nc"), F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.concat_ws(",", "r", "c").alias("k"), "text")))).alias("at"))
    row = lambda i: F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda j: F.coalesce(F.try_element_at("at", F.concat_ws(",", i, j)), F.lit("")))
    return size.where("nr > 0 AND nc > 0").select("id", F.transform(F.sequence(F.lit(0), F.col("nr") - 1), row).alias("grid"))


def heading_as_of(items: DataFrame, headings: DataFrame) -> DataFrame:
    """Items (doc, id, page) with the last heading (doc, ord, page, text) in document order up to their page; without a page, the last of all.

    One sort a document by page, with a running maximum: items and headings never meet in pairs.
    """
    every, none = F.lit(2**31 - 1), F.lit(-(2**31))
    i = items.select("doc", "id", "page", F.coalesce("page", every).alias("at"), F.lit(True).alias("item"))
    h = headings.select("doc", F.coalesce("page", none).alias("at"), F.lit(False).alias("item"), F.col("ord").alias("ho"), F.col("text").alias("text"))
    upto = W.partitionBy("doc").orderBy("at")
    near = i.unionByName(h, allowMissingColumns=True).withColumn("heading", F.max_by("text", "ho").over(upto))
    return near.where("item").select("doc", "id", "page", "heading")


def nearest_chunk(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items (doc, id, page_start, page_end) with the chunk whose pages are nearest; ties go to the smaller index."""
    c = chunks.where("page_start IS NOT NULL AND page_end IS NOT NULL").select(F.col("content_hash").alias("cd"), "chunk_id", "chunk_index", F.col("page_start").alias("cs"), F.col("page_end").alias("ce"))
    paged = items.where("page_start IS NOT NULL AND page_end IS NOT NULL")
    both = paged.select("doc", "page_start", "page_end").distinct().join(c, F.col("doc") == F.col("cd"))  # items of the same pages ask once
    gap = F.greatest(F.lit(0), F.col("page_start") - F.col("ce"), F.col("cs") - F.col("page_end"))
    near = both.groupBy("doc", "page_start", "page_end").agg(F.min(F.struct(gap.alias("distance"), "chunk_index", "chunk_id")).alias("n"))
    return paged.select("doc", "id", "page_start", "page_end").join(near, ["doc", "page_start", "page_end"]).select("doc", "id", "n.distance", "n.chunk_index", "n.chunk_id")


def captions(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Items (doc, id, refs array) with the texts (doc, self_ref, ord, text) they refer to, joined by spaces; the last of equal refs wins."""
    last = texts.groupBy("doc", "self_ref").agg(F.max_by("text", "ord").alias("text")).withColumnRenamed("doc", "td")
    each = items.select("doc", "id", F.posexplode_outer("refs").alias("at", "ref"))
    found = each.join(last, (F.col("doc") == F.col("td")) & (F.col("ref") == F.col("self_ref")), "left")
    whole = found.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))).alias("t"))
    return whole.select("doc", "id", F.array_join(F.col("t.text"), " ").alias("caption"))
