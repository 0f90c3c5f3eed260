"""Workbooks as a Spark source (S12, S13): ``spark.read.format("xlsx").option("sheet", name).load(path)``.

A file is a partition, read by the standard library's zip and XML readers row by row. Columns are strings named after the cells of
the sheet's first row; ``load`` takes a file, or a folder or pattern of files with the same sheet. Options: ``sheet`` (the first one
where it is not given) and ``columns``, names separated by line feeds; without it the first file's heading is read.

Defined results: blank cells, and cells that a row lacks, are null; booleans are TRUE and FALSE; numbers are as written, whole ones
without a point; formulas give their stored values; texts of several runs are joined; a heading that repeats gets its number (``A``,
``A_2``); rows without any value are left out. A workbook without the sheet is an error that names it; a sheet without rows is empty.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions.text import filled

# Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Headings of the golden questions' and of the corpus sheet.
QUESTION_SHEET, CORPUS_SHEET = "QA Evaluation Template", "Starter Corpus"
QUESTION_COLUMNS = {
    "QA ID": "qa_id", "Doc ID": "doc_id", "Question Category": "category", "Question": "question", "Expected Answer": "expected_answer", "Expected Evidence Type": "expected_evidence_type",
    "Expected Page(s)": "expected_pages", "Expected Source Notes": "expected_source_notes", "Should Abstain?": "should_abstain", "Difficulty": "difficulty", "Status": "status", "Reviewer Notes": "reviewer_notes",
}
CORPUS_COLUMNS = {"Doc ID": "doc_id", "Category": "category", "Document Title": "title", "Source Organization": "source_organization", "Year": "year"}


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _sheet_path(book: zipfile.ZipFile, sheet: str | None, path: str) -> str:
    sheets = [(s.get("name"), s.get(RELATED)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    found = [r for n, r in sheets if sheet is None or n == sheet]
    if not found:
        raise ValueError(f"no sheet {sheet!r} in {path}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[found[0]]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return _text(cell) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)] or None
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    if kind in ("str", "e", "d"):
        return v.text or None
    return re.sub(r"\.0+$", "", v.text)


def sheet_rows(path: str, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows of a sheet, cells at their places."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        with book.open(_sheet_path(book, sheet, path)) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{MAIN}row":
                    row: list[str | None] = []
                    for place, cell in enumerate(node.iter(f"{MAIN}c")):
                        at = _column(cell.get("r")) if cell.get("r") else max(place, len(row))
                        row += [None] * (at + 1 - len(row))
                        row[at] = _value(cell, shared)
                    node.clear()
                    if any(x is not None for x in row):
                        yield row


def headings(row: list[str | None]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(row):
        name = (name or "").strip() or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], sheet: str | None, names: list[str]):
        self.files, self.sheet, self.names = files, sheet, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(partition.value, self.sheet)
        own = {n: i for i, n in enumerate(headings(next(rows, [])))}
        for row in rows:
            yield tuple(row[own[n]] if n in own and own[n] < len(row) else None for n in self.names)


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _files(self) -> list[str]:
        path = re.sub("^file:(//)?", "", self.options["path"])
        found = sorted(glob.glob(f"{path}/**/*.xlsx", recursive=True) if os.path.isdir(path) else glob.glob(path))
        if not found:
            raise FileNotFoundError(f"no workbooks at {path}")
        return found

    def schema(self) -> StructType:
        if given := self.options.get("columns"):
            names = given.split("\n")
        else:
            names = headings(next(sheet_rows(self._files()[0], self.options.get("sheet")), []))
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._files(), self.options.get("sheet"), schema.names)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(XlsxDataSource)
    reader = spark.read.format("xlsx")
    for k, v in (("sheet", sheet), ("columns", "\n".join(columns) if columns else None)):
        reader = reader.option(k, v) if v else reader
    return reader.load(path)


def read_golden_questions(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an id and a question; optional columns are trimmed, blank ones null; what isn't yes, true or 1 is no abstention."""
    rows = read_sheet(spark, path, QUESTION_SHEET, list(QUESTION_COLUMNS))
    rows = rows.select(*[F.col(f"`{k}`").alias(v) for k, v in QUESTION_COLUMNS.items()]).where("qa_id <> '' AND question <> ''")
    plain = {"qa_id", "doc_id", "category", "question"}
    rows = rows.select(*[F.col(c) if c in plain else filled(F.trim(c)).alias(c) for c in rows.columns])
    return rows.withColumn("expected_answer", F.coalesce("expected_answer", F.lit(""))).withColumn("should_abstain", F.coalesce(F.lower("should_abstain").isin("yes", "true", "1"), F.lit(False)))


def read_corpus_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a doc_id; of rows that repeat one, the last in the sheet."""
    rows = read_sheet(spark, path, CORPUS_SHEET, list(CORPUS_COLUMNS))
    rows = rows.select(*[F.col(f"`{k}`").alias(v) for k, v in CORPUS_COLUMNS.items()]).where("doc_id <> ''").withColumn("ord", F.monotonically_increasing_id())
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("category", "title", "source_organization")]
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("doc_id", "ord")]), "ord").alias("r")).select("doc_id", "r.*")
    return last.select("doc_id", *texts, F.expr("try_cast(year AS int)").alias("year"))
