"""Text blocks and chunks (P1-P5): ordered greedy folds as higher-order functions over one document's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import collapsed, evidence_id

BLOCK = "struct<ord:int,label:string,page:int,text:string>"
SKIPPED_LABELS = ["page_header", "page_footer"]


def text_blocks(docs: DataFrame, blocks: str = "blocks") -> DataFrame:
    """(content_hash, ord, label, page, text) without page headers, footers and blank blocks."""
    rows = docs.select("content_hash", F.posexplode(blocks).alias("ord", "b"))
    rows = rows.select("content_hash", "ord", F.col("b.label").alias("label"), F.col("b.page").alias("page"), collapsed(F.col("b.text")).alias("text"))
    return rows.where(~F.col("label").isin(SKIPPED_LABELS) & (F.col("text") != ""))


def split_long(text: Column, most: int) -> Column:
    """A text over ``most`` characters as greedily packed words; a word that is longer stays whole."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def step(s: Column, w: Column) -> Column:
        over = (s["cur"] != "") & (F.length(s["cur"]) + F.length(w) + 1 > most)
        cur = F.when(over | (s["cur"] == ""), w).otherwise(F.concat(s["cur"], F.lit(" "), w))
        return F.struct(cur.alias("cur"), F.when(over, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"))

    packed = F.aggregate(words, start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def _carry(cur: Column, overlap: int) -> Column:
    """The shortest run of last whole blocks that reaches ``overlap`` characters, two for each separator."""
    start = F.struct(F.array().cast(f"array<{BLOCK}>").alias("kept"), F.lit(0).alias("total"))

    def step(s: Column, b: Column) -> Column:
        done = s["total"] >= overlap
        more = s["total"] + F.length(b["text"]) + F.when(F.size(s["kept"]) > 0, 2).otherwise(0)
        return F.struct(F.when(done, s["kept"]).otherwise(F.concat(F.array(b), s["kept"])).alias("kept"), F.when(done, s["total"]).otherwise(more).alias("total"))

    return F.aggregate(F.reverse(cur), start, step)


def pack(blocks: Column, most: int, overlap: int) -> Column:
    """array<struct<ord,label,page,text>> in order to an array of chunks, each an array of blocks."""
    none = F.array().cast(f"array<{BLOCK}>")
    start = F.struct(none.alias("cur"), F.lit(0).alias("len"), F.array().cast(f"array<array<{BLOCK}>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        full = (F.size(s["cur"]) > 0) & (s["len"] + F.length(b["text"]) + 2 > most)
        carried = _carry(s["cur"], overlap) if overlap > 0 else F.struct(none.alias("kept"), F.lit(0).alias("total"))
        cur = F.when(full, carried["kept"]).otherwise(s["cur"])
        length = F.when(full, carried["total"]).otherwise(s["len"])
        return F.struct(
            F.concat(cur, F.array(b)).alias("cur"), (length + F.length(b["text"]) + 2).cast("int").alias("len"),
            F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(blocks, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def chunks(blocks: DataFrame, most: int = 1200, overlap: int = 200) -> DataFrame:
    """Rows of text blocks to (content_hash, chunk_id, chunk_index, text, page_start, page_end).

    A document's blocks are ordered by an explicit position; headings get "## " after the budget is spent, so that a chunk may
    exceed it by that. Where documents are still rows with their blocks, ``document_chunks`` needs no shuffle.
    """
    one = F.struct(F.col("ord").cast("int").alias("ord"), "label", F.col("page").cast("int").alias("page"), "text")
    return _chunked(blocks.groupBy("content_hash").agg(F.array_sort(F.collect_list(one)).alias("blocks")), most, overlap)


def document_chunks(docs: DataFrame, most: int = 1200, overlap: int = 200, blocks: str = "blocks") -> DataFrame:
    """Documents (content_hash, blocks) to chunks as of ``chunks``, each where it is: nothing is shuffled.

    Defined results: blocks with a null label or a null or blank text are left out, as are page headers and footers; documents with
    null or without blocks have no chunks; rows that repeat a content hash are documents of their own."""
    one = lambda b, i: F.struct(i.cast("int").alias("ord"), b["label"].alias("label"), b["page"].cast("int").alias("page"), collapsed(b["text"]).alias("text"))
    own = F.filter(F.transform(blocks, one), lambda b: ~b["label"].isin(SKIPPED_LABELS) & (b["text"] != ""))
    # found once: what explode gives is a column, which the fold below may use as often as it likes
    return _chunked(docs.select("content_hash", F.explode(F.array(own)).alias("blocks")), most, overlap)


def _chunked(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(split_long(b["text"], most), lambda t: F.struct(b["ord"].alias("ord"), b["label"].alias("label"), b["page"].alias("page"), t.alias("text")))))
    rows = docs.select("content_hash", F.posexplode(pack(pieces, most, overlap)).alias("chunk_index", "c"))
    text = F.array_join(F.transform("c", lambda b: F.when(b["label"] == "section_header", F.concat(F.lit("## "), b["text"])).otherwise(b["text"])), "\n\n")
    return rows.select("content_hash", evidence_id(F.col("content_hash"), "text", F.col("chunk_index")).alias("chunk_id"), "chunk_index", text.alias("text"), F.array_min("c.page").alias("page_start"), F.array_max("c.page").alias("page_end"))
