"""Registry relations as latest-state views, scope and index maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import basename

PARSED = ["parsed", "indexed"]


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; one combining pass picks it where Spark can limit the window."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def modality_status(run_status: Column, count: Column) -> Column:
    """failed, then indexed by count, then not_available, not_indexed and unknown, in this order."""
    return F.when(run_status == "failed", "failed").when(count > 0, "indexed").when(run_status == "no_evidence", "not_available").when(run_status.isNull(), "not_indexed").otherwise("unknown")


def parsed_documents(documents: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with chunks and their newest parsed job, latest first and unfinished last."""
    usable = jobs.where(F.col("status").isin(PARSED) & F.col("artifact").isNotNull())
    with_chunks = documents.join(chunks.select("content_hash").distinct(), "content_hash", "left_semi")
    return latest(with_chunks.join(usable, "content_hash"), "content_hash", [F.col("completed_at").desc_nulls_last(), F.col("job_id")])


def in_scope(rows: DataFrame, column: str, allowed: list[str] | None) -> DataFrame:
    """All rows without a scope, none for an empty one."""
    if allowed is None:
        return rows
    return rows.where(F.col(column).isin(allowed)) if allowed else rows.where(F.lit(False))


def scope_all(documents: DataFrame, *modalities: DataFrame) -> DataFrame:
    """Documents with a row of any modality, by filename."""
    keys = [m.select("content_hash") for m in modalities]
    every = keys[0]
    for k in keys[1:]:
        every = every.unionByName(k)
    return documents.join(every.distinct(), "content_hash", "left_semi")


def suffix_matches(names: DataFrame, documents: DataFrame) -> DataFrame:
    """names (doc_id, filename) to (doc_id, content_hash) of each document whose lower-case path ends with the name, where an
    underscore in a name stands for any one character and a per cent sign for any.

    The longest literal piece of a name after its last per cent sign, and its distance from the end, are looked up in an index of
    the paths: each path has one row for each distinct (distance, length) that names have. Pairs that agree there are matched
    whole. Names without a literal piece at a known place have no matches: they would match everything."""
    low = names.where("filename IS NOT NULL").select("doc_id", F.lower("filename").alias("name"))
    tail = F.substring_index("name", "%", -1)
    pieces = F.split(tail, "_")
    # (length, distance from the end, piece): pieces in order, each followed by one character for the underscore
    after = lambda i: F.aggregate(F.slice(pieces, i + 2, F.size(pieces)), F.lit(0), lambda n, p: n + F.length(p) + 1)
    placed = F.transform(pieces, lambda p, i: F.struct(F.length(p).alias("length"), after(i).alias("distance"), p.alias("piece")))
    low = low.withColumn("k", F.array_max(placed)).select("doc_id", "name", "k.*").where("length > 0")
    shapes = [(r["length"], r["distance"]) for r in low.select("length", "distance").distinct().collect()]  # as many as names have shapes
    path = F.lower("source_path")
    cut = [F.struct(F.lit(n).alias("length"), F.lit(d).alias("distance"), F.when(F.length(path) >= n + d, F.substring(path, F.length(path) - (n + d) + 1, F.lit(n))).alias("piece")) for n, d in shapes]
    empty = F.array().cast("array<struct<length:int,distance:int,piece:string>>")
    ends = documents.select("content_hash", path.alias("path"), F.explode(F.array(*cut) if cut else empty).alias("k")).select("content_hash", "path", "k.*")
    both = low.join(ends, ["length", "distance", "piece"]).withColumn("pattern", F.concat(F.lit("%"), F.replace("name", F.lit("\\"), F.lit("\\\\"))))
    return both.where(F.expr("path LIKE pattern")).select("doc_id", "content_hash").distinct()


def _exact_matches(names: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select(F.lower(basename(F.col("source_path"))).alias("name"), "content_hash")
    return names.select("doc_id", F.lower("filename").alias("name")).join(d, "name").select("doc_id", "content_hash").distinct()


def resolve_ids(names: DataFrame, documents: DataFrame) -> DataFrame:
    """Names (doc_id, filename) to documents: (doc_id, n, content_hash, status). A document whose file has that name in any case,
    else one whose path ends with it (``suffix_matches``). None is not_found; several are ambiguous, and have the least hash."""
    exact = _exact_matches(names, documents)
    rest = names.join(exact.select("doc_id").distinct(), "doc_id", "left_anti")
    found = exact.unionByName(suffix_matches(rest, documents))
    counts = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("content_hash").alias("content_hash"))
    both = names.select("doc_id").distinct().join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return both.select("doc_id", "n", "content_hash", F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("status"))


def reverse_ids(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Each document's doc_id: the first name, in map order, that is its file's name or that its path ends with, in any case and
    as written: underscores stand for themselves here. Names (doc_id, filename, ord) have few lengths; each path is looked up once
    a length."""
    n = names.where("filename <> ''").select("doc_id", F.lower("filename").alias("name"), "ord")
    lengths = [r[0] for r in n.select(F.length("name")).distinct().collect()]
    path = F.lower("source_path")
    ends = F.array(*[F.right(path, F.lit(k)) for k in lengths]) if lengths else F.array().cast("array<string>")
    both = documents.select("content_hash", F.explode_outer(F.array_distinct(ends)).alias("name")).join(n, "name", "left")
    return both.groupBy("content_hash").agg(F.min_by("doc_id", "ord").alias("doc_id"))


def registered(names: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Names (doc_id, filename) to the document (document_id, content_hash, source_path) whose path ends so, case as written, and
    how many chunks it has: (doc_id, filename, document_id, content_hash, indexed_chunk_count). Of several, the least id counts.

    Names have few lengths, so each path is looked up once a length.
    """
    known = names.where("filename <> ''")
    lengths = [r[0] for r in known.select(F.length("filename")).distinct().collect()]
    ends = documents.select("document_id", "content_hash", F.explode(F.array(*[F.right("source_path", F.lit(n)) for n in lengths] or [F.lit(None).cast("string")])).alias("filename"))
    first = known.join(ends, "filename").groupBy("doc_id").agg(F.min(F.struct("document_id", "content_hash")).alias("d")).select("doc_id", "d.*")
    counts = chunks.groupBy("document_id", "content_hash").agg(F.count("*").alias("indexed_chunk_count"))
    found = first.join(counts, ["document_id", "content_hash"], "left").select("doc_id", "document_id", "content_hash", "indexed_chunk_count")
    return names.join(found, "doc_id", "left").select("doc_id", F.coalesce("filename", F.lit("")).alias("filename"), "document_id", "content_hash", F.coalesce("indexed_chunk_count", F.lit(0).cast("long")).alias("indexed_chunk_count"))


def enriched(hits: DataFrame, scope: DataFrame, override_document: bool) -> DataFrame:
    """Hits with the scope's doc_id, and for texts its document_id, by content hash."""
    s = scope.select(F.col("content_hash").alias("sh"), F.col("doc_id").alias("sd"), F.col("document_id").alias("si"))
    both = hits.join(s, F.col("content_hash") == F.col("sh"), "left").withColumn("doc_id", F.coalesce("sd", "doc_id"))
    return (both.withColumn("document_id", F.coalesce("si", "document_id")) if override_document else both).drop("sh", "sd", "si")


def matching(documents: DataFrame, text: str | None = None, **exact: str | None) -> DataFrame:
    """exact filters, and a case-blind substring of id, filename and hash."""
    out = documents
    for column, value in exact.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.where(F.contains(F.lower(F.concat_ws(" ", "doc_id", "filename", "content_hash")), F.lit(text.lower()))) if text else out


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """L4: a page of rows with the total that was there."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def upserted(current: DataFrame, incoming: DataFrame, key: str = "content_hash") -> DataFrame:
    """M1: the incoming row where a key is new or known, else the current one. ``incoming`` has one row a key, or its first by ``ord``."""
    first = latest(incoming, key, [F.col("ord")])
    kept = current.join(first.select(key), key, "left_anti")
    return kept.unionByName(first.drop("ord"))


def pending(documents: DataFrame, runs: DataFrame, index: str) -> DataFrame:
    """M2, M4: documents without a finished run of an index."""
    done = runs.where((F.col("index_name") == index) & F.col("status").isin("indexed", "no_evidence")).select("content_hash").distinct()
    return documents.join(done, "content_hash", "left_anti")


def without(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """M7, M8: a table less the rows of removed documents; a caller rewrites each dependent table with it."""
    return table.join(removed.select(key).distinct(), key, "left_anti")


def replace_rows(table: DataFrame, path: str, key: str = "content_hash") -> None:
    """M4, M5: overwrites just the partitions of the keys in ``table``, in one commit."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
