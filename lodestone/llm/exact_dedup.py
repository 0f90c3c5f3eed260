"""Exact duplicates by an extendible-hash index on shared files. DataFrame functions only.

1. Every row's normalised text gets a 64-bit key and a SHA-256; (id, key, digest) is written once to the shared folder.
2. The directory starts with one bucket. While a bucket holds more distinct keys than its capacity, the directory doubles
   and the overfull buckets split on the next bit of the key; a bucket keeps its own (local) depth. The directory is a
   written table; it is broadcast only where a count finds at most ``BROADCAST_SLOTS`` slots.
3. Rows go through the directory to their bucket. A key that one row has is an entry as it is; only texts under repeated keys
   are read again. Scanning tasks combine their copies, so a group that holds a third of all rows moves as a few rows a task.
4. Owner tasks take ranges of (bucket, key). They compare the bytes of what shares a key: equal texts are one entry, different
   ones form a chain of entries. The entries are written in that order, and every row finds its own by bucket, key and digest.
   Should two texts of a chain share the digest too, those rows are looked up by text.

Defined results: null text is empty; one result row for each row, also for rows that repeat both id and text (all of them are
marked as kept where their id is); a null id ranks after all others, so it stays only where every copy has one; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import emptied, small, written

KEY_BITS = 64
SALTS = 16
BROADCAST_SLOTS = 131_072


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def prefix(key: Column, bits: int) -> Column:
    """The first bits of a key, as a number."""
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, int]:
    """Slots (slot, bucket, local_depth) of the directory over distinct ``key`` values, and its global depth."""
    cells = written(keys.select(prefix(F.col("key"), max_depth).alias("cell"), "key").distinct().groupBy("cell").agg(F.count("*").alias("n")), "cells")
    at = lambda depth: F.shiftrightunsigned(F.col("cell"), max_depth - depth)
    depth, leaves = 0, []
    live = cells.select(F.lit(0).cast("long").alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n"))
    while True:
        live = written(live, f"depth{depth}")
        over = live.where(F.col("n") > capacity)
        last = depth == max_depth or over.isEmpty()
        full = live if last else live.where(F.col("n") <= capacity)
        leaves.append(full.select("bucket", F.lit(depth).alias("local_depth")))
        if last:
            break
        depth += 1  # the directory doubles; only overfull buckets split
        split = cells.select(at(depth).alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n"))
        live = split.join(over.select(F.col("bucket").alias("parent")), F.shiftrightunsigned("bucket", 1) == F.col("parent"), "left_semi")
    slots = leaves[0]
    for more in leaves[1:]:
        slots = slots.unionByName(more)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("local_depth"))
    first = F.col("bucket") * width
    slots = written(slots.select(F.explode(F.sequence(first, first + width - 1)).alias("slot"), first.alias("bucket"), "local_depth"), "directory")
    emptied(cells)
    return slots, depth


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 50_000,
    max_depth: int = 24,
    key: Callable[[Column], Column] = F.xxhash64,
    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
    tables: list[DataFrame] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. See the module for the method.

    ``tables`` gets the written tables that the result depends on, for ``emptied``."""
    scan = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = written(scan.select("id", key(F.col("norm")).cast("long").alias("key"), digest(F.col("norm")).alias("digest")), "dedup-keys")
    own = [rows]
    slots, depth = directory(rows, capacity, max_depth)
    places = small(slots.select("slot", "bucket"), BROADCAST_SLOTS)
    rows = rows.withColumn("slot", prefix(F.col("key"), depth)).join(places, "slot").drop("slot")

    keys = rows.groupBy("bucket", "key").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"), F.min("digest").alias("digest"))
    keys = written(keys, "dedup-buckets")
    single = keys.where("n = 1").select("bucket", "key", "digest", "keep_id", F.col("n").alias("group_size"), F.lit(1).alias("link"))
    again = small(keys.where("n > 1").select("bucket", "key"))
    copies = scan.withColumn("key", key(F.col("norm")).cast("long")).join(again, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    copies = copies.groupBy("bucket", "key", "norm", "salt").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    owned = copies.repartitionByRange("bucket", "key").groupBy("bucket", "key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "norm"))
    entries = owned.select("bucket", "key", digest(F.col("norm")).alias("digest"), "keep_id", "group_size", chain.alias("link"))
    index = written(single.unionByName(entries), "dedup-index")
    emptied(keys)
    if tables is not None:
        tables += [*own, index]

    clashes = index.where("link > 1").select("key").distinct().join(index, "key").groupBy("key", "digest").agg(F.count("*").alias("texts")).where("texts > 1").select("key", "digest")
    found = rows.join(index.drop("link"), ["bucket", "key", "digest"]).select("id", "keep_id", "group_size", "digest")
    if not clashes.isEmpty():
        found = _by_text(scan.withColumn("key", key(F.col("norm")).cast("long")).withColumn("digest", digest(F.col("norm"))), rows, index, clashes)
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def _by_text(texts: DataFrame, rows: DataFrame, index: DataFrame, clashes: DataFrame) -> DataFrame:
    """As the usual lookup, but rows whose key and digest belong to several texts are matched by the text itself."""
    plain = rows.join(clashes, ["key", "digest"], "left_anti").join(index, ["bucket", "key", "digest"]).select("id", "keep_id", "group_size", "digest")
    odd = texts.join(clashes, ["key", "digest"], "left_semi")
    chains = odd.groupBy("key", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return plain.unionByName(odd.join(chains, ["key", "norm"]).select(plain.columns))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept. Of rows that repeat the id that stays, one stays.

    Only rows that go, and those that repeat an id, are looked up; the others pass through without a shuffle where the
    former are few enough to be broadcast."""
    tables: list[DataFrame] = []
    rows = written(exact_duplicates(docs, id_col, text_col, tables=tables), "dedup-rows")
    emptied(*tables)
    ids = [F.col(id_col).alias("__id"), F.col("text_sha256").alias("__ksha")]
    gone = rows.where("NOT kept").select(*ids)
    twice = written(rows.where("kept AND group_size > 1").groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").select("__id", "__ksha"), "dedup-twice")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__ksha"))
    out = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256)).join(small(gone), same, "left_anti")
    if not twice.isEmpty():
        again = small(twice)
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([id_col, "__sha"]))
    return out.drop("__sha")
