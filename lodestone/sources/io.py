"""Sources and sinks (S1-S19): files in, canonical documents and evidence out. All of them are Spark readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import basename, filled, safe_filename
from lodestone.operators.registry import latest
from lodestone.sources import schemas, stored

MAGIC = b"%PDF"


def inspected_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Path, filename, size, content hash and whether the file starts as a PDF does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = basename(F.col("path"))
    return files.select("path", name.alias("filename"), safe_filename(name).alias("safe_filename"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("content_hash"), (F.substring("content", 1, 4) == F.lit(MAGIC)).alias("is_pdf"), "content")


def routed(files: DataFrame, backend: str = "auto", threshold: int = 50_000_000) -> DataFrame:
    """Which parser a file goes to, and why."""
    if backend != "auto":
        return files.withColumn("parser", F.lit(backend)).withColumn("reason", F.lit(None).cast("string"))
    big = F.col("file_size_bytes") > threshold
    return files.withColumn("parser", F.when(big, "text").otherwise("layout")).withColumn("reason", F.when(big, "size_threshold"))


def parsed(files: DataFrame, parse: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """Pages of files by a parser that each worker holds; empty pages are left out, a failure is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for h, content in zip(f.content_hash, f.content, strict=True):
                try:
                    rows += [(h, n, text, None) for n, text in parse(bytes(content)) if text.strip()]
                except Exception as e:  # noqa: BLE001 - a file that can't be parsed is a result
                    rows.append((h, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["content_hash", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("content_hash", "content").mapInPandas(run, "content_hash string, page int, text string, error string")


ERRORS = "array<struct<type:string,stage:string,message:string>>"


def parsed_in_order(files: DataFrame, parsers: list[tuple[str, Callable[[bytes], tuple[list[tuple[int, str]], list[str]]]]], threshold: int = 50_000_000) -> DataFrame:
    """(content_hash, parser, pages, errors) of each file: the first parser's pages, or where it raises or reports errors the
    next one's, and so on; what went wrong before is carried along in ``errors``.

    A parser takes a file's bytes and gives pages (number, text) and messages of errors; each worker holds it. Files larger than
    ``threshold`` go to the last parser at once, with the reason among their errors. Each step is a written table of the files that
    came that far, so none is parsed twice. The last parser's result stands, with its errors; where it raises there are no pages.
    Blank pages are left out; null contents count as empty; files of equal content hash are files of their own."""
    spark = files.sparkSession
    schema = f"content_hash string, parser string, pages array<struct<page:int,text:string>>, errors {ERRORS}, done boolean"
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    large = F.array(F.struct(F.lit("parser_selection").alias("type"), F.lit("selection").alias("stage"), F.lit("Used the last parser because the file size exceeded the threshold.").alias("message")))
    rows = files.select("content_hash", "content", F.when(size > threshold, large).otherwise(F.array().cast(ERRORS)).alias("errors"), F.when(size > threshold, len(parsers) - 1).otherwise(0).alias("at"))
    out = None
    for k, (name, parse) in enumerate(parsers):
        last = k == len(parsers) - 1

        def run(frames: Iterator[pd.DataFrame], name: str = name, parse: Callable = parse, last: bool = last) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = []
                for h, content, before in zip(f.content_hash, f.content, f.errors, strict=True):
                    try:
                        pages, said = parse(bytes(content or b""))
                        errors = [{"type": "parser_error", "stage": name, "message": str(m)} for m in said]
                    except Exception as e:  # noqa: BLE001 - a file that can't be parsed goes to the next parser
                        pages, errors = [], [{"type": type(e).__name__, "stage": name, "message": str(e)}]
                    kept_pages = [{"page": int(n), "text": t} for n, t in pages if t and t.strip()]
                    got.append((h, content, name, kept_pages, [*[dict(x) if isinstance(x, dict) else x.asDict() for x in before], *errors], last or not errors))
                yield pd.DataFrame(got, columns=["content_hash", "content", "parser", "pages", "errors", "done"])

        own = rows.where(F.col("at") == k).select("content_hash", "content", "errors")
        tried = own.mapInPandas(run, f"content_hash string, content binary, {schema.partition(', ')[2]}")
        tried = stored.kept(tried, f"parsed-{k}")
        ended = tried.where("done").select("content_hash", "parser", "pages", "errors")
        out = ended if out is None else out.unionByName(ended)
        if not last:
            rows = rows.where(F.col("at") > k).unionByName(tried.where("NOT done").select("content_hash", "content", "errors", F.lit(k + 1).alias("at")))
    return out if out is not None else spark.createDataFrame([], schema).drop("done")


def markdown(pages: DataFrame) -> DataFrame:
    """One markdown per document, a comment before each page, lines stripped and blank ones dropped."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda l: F.regexp_replace(l, r"(?U)^\s+|\s+$", "")), lambda l: l != "")
    page = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.array_join(lines, "\n"))
    each = pages.where("error IS NULL").select("content_hash", F.struct("page", page.alias("body")).alias("p"))
    return each.groupBy("content_hash").agg(F.array_join(F.array_sort(F.collect_list("p"))["body"], "\n\n").alias("markdown"), F.max("p.page").alias("page_count"))


def canonical(files: DataFrame, texts: DataFrame) -> DataFrame:
    """The canonical document of each file."""
    d = files.join(texts, "content_hash")
    pages = F.when(F.col("page_count") > 0, F.transform(F.sequence(F.lit(1), F.greatest("page_count", F.lit(1))), lambda n: F.struct(n.alias("page_number")))).otherwise(F.array().cast("array<struct<page_number:int>>"))
    return d.select(
        F.lit("lodestone.canonical_document.v1").alias("schema_version"), F.struct("filename", F.col("path").alias("source_path"), "content_hash", "file_size_bytes").alias("document"),
        pages.alias("pages"), F.struct(F.length("markdown").alias("markdown_char_count")).alias("content"), F.struct(F.lit("parsed").alias("status"), "page_count").alias("parse"), "markdown",
    )


def write_canonical(docs: DataFrame, path: str) -> None:
    """JSON, in folders by the first two digits of the hash."""
    docs.withColumn("prefix", F.substring("document.content_hash", 1, 2)).write.mode("append").partitionBy("prefix").json(path)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """With the full schema; a line that is no JSON has just ``_corrupt_record``."""
    return spark.read.schema(schemas.CANONICAL + ", _corrupt_record string").json(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TREE).option("multiLine", "true").json(path)


def tree_pages(tree: Column) -> Column:
    """Pages of a parse tree in JSON: the size of its list or object ``pages``, else 0."""
    pages = F.get_json_object(tree, "$.pages")
    return F.coalesce(F.json_array_length(pages), F.size(F.json_object_keys(pages)), F.lit(0))


def tree_labels(tree: Column, labels: list[str]) -> Column:
    """Nodes of a parse tree in JSON, at any depth, whose label is one of these, in any case, blanks read as underscores.

    JSON is written anew without blanks between tokens. A quote inside a string has a backslash before it, so that what looks
    like a label there is none. A tree that is no JSON has 0.
    """
    names = "|".join(x.replace("_", "[_ ]") for x in labels)
    return F.coalesce(F.regexp_count(F.to_json(F.try_parse_json(tree)), F.lit(rf'(?i)(?<!\\)"(?-i:label)":"(?:{names})"')), F.lit(0))


def optional_text(docs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """A left join where missing and blank texts are null."""
    return docs.join(texts.withColumn("text", filled(F.trim("text"))), key, "left")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from CSV; rows without id or question are skipped."""
    rows = spark.read.schema(schemas.QUESTIONS).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    rows = rows.select(*[filled(F.trim(c)).alias(c) for c in rows.columns]).where("qa_id IS NOT NULL AND question IS NOT NULL")
    return rows.withColumn("should_abstain", F.coalesce(F.lower("should_abstain").isin("yes", "true", "1"), F.lit(False)))


def read_corpus(rows: DataFrame) -> DataFrame:
    """One row a doc_id; later rows (by ``ord``) win."""
    return latest(rows, "doc_id", [F.col("ord").desc()])


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines."""
    results.write.mode("overwrite").json(path)


def ragas_rows(results: DataFrame) -> DataFrame:
    """What an outside scorer reads of evaluated rows."""
    return results.where("status = 'evaluated'").select("question", "answer", F.col("expected_answer").alias("ground_truth"), "contexts", "qa_id", "doc_id")


def allowed(path: str, roots: list[str]) -> bool:
    """Whether a path lies under one of the roots, by its parts."""
    import posixpath

    p = posixpath.normpath(path)
    return any(p == r or p.startswith(r.rstrip("/") + "/") for r in map(posixpath.normpath, roots))
