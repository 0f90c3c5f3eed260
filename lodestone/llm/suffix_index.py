"""Byte strings that start at two places of a corpus, by a logarithmic family of suffix indexes; texts without them.

A string of ``length`` bytes that starts at a second place, in the same text or another, is repeated. Every byte that a repeated
string covers goes.

*Which suffixes.* A suffix array of every byte would take many times the corpus. Of the 64-byte grams inside each window of
``length`` bytes one is its anchor: the one with the smallest hash, the leftmost of several. Equal windows have equal anchors, so
suffixes that start at anchors, about one in sixty, find them all. The windows that share an anchor are consecutive; the bytes that
they cover together are the anchor's *stretch*. A suffix stands in its array by ``key``: its first three bytes, then 40 bits of a
hash of its first 64; suffixes of one key are ordered by a hash of their stretch. An entry counts the places of one (key, stretch).

*The family.* Texts come in batches. A new batch gets its own array. It is merged in a scan with all levels there are: a key on both
sides, or twice in the batch, is live, which is to say that a long match may lie there. Then the batch becomes a level, and while
the last two levels hold equally many batches they merge into one. So an entry is written anew log2(batches) times. A later
batch needs the levels alone, not the earlier texts (``Family.add``).

*Long matches.* Under a live key, a stretch with two places is repeated whole. Where a key has several stretches, one of them with
a single place, a text that holds it gives the bytes of each. All their windows, sorted as suffixes by their bytes, show by equal
neighbours which are repeated. A key with more than ``crowd`` stretches is too much for one task: its windows are rows by hash, which
Spark adds up. Repeated windows go back to the places, are joined by text, and the texts lose what they cover.

Sizes: a place is a row of some 30 bytes for about sixty bytes of text, written once. Only live places are shuffled to their texts.
Texts with repeated bytes meet their spans by a broadcast where these are few by a count, by a shuffle where not.

Defined results: a null text is empty; a text shorter than ``length`` has nothing repeated; rows are independent, so rows that repeat
an id count as texts of their own, and all copies of a text lose the same bytes; null ids are ids like others; an empty table gives
no rows. A cut may fall inside a character, so what is kept is binary. Other columns are left out. Stretches count as equal by 128
bits of two hashes, and texts too; windows are compared byte by byte (by 64 bits within crowded keys).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import emptied, shared_path, shuffles_end, small, small_batches, written
from lodestone.llm.shingles import each_text

U = np.uint64
GRAM = 64
BLOCK = 1 << 20
BROADCAST_BYTES = 64 << 20
_draw = np.random.default_rng(20_240_611)
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_MULTIPLY = [U(int(x) | 1) for x in _draw.integers(0, 2**63, 12)]


def _grams(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of each of ``sizes`` bytes (powers of two), by doubling."""
    found, h, k, step = {}, _BYTE[data], 1, 0
    while True:
        if k in sizes:
            found[k] = h
        if k >= max(sizes):
            return found
        t = h[:-k] * _MULTIPLY[step]
        t += h[k:]
        t ^= t >> U(31)
        h, k, step = t, 2 * k, step + 1


def _string_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each string of ``size`` bytes, from the hashes of all strings of 128: first, middle and last, so for 128 to 384."""
    out = h[start] * _MULTIPLY[8] + h[start + (size - 128) // 2] * _MULTIPLY[9] + h[start + size - 128] * _MULTIPLY[10]
    out ^= out >> U(29)
    return out * _MULTIPLY[11] + size.astype(np.uint64)


def anchors(data: np.ndarray, stop: np.ndarray, length: int, starts: int) -> dict[str, np.ndarray]:
    """Anchors of the windows that start at the first ``starts`` bytes of ``data``; ``stop`` is each byte's end of text.

    key, stretch: hashes; first: where the first window starts; windows: how many; left: bytes from there to the anchor."""
    starts = min(starts, len(data) - length + 1)
    if starts <= 0:
        return {k: np.zeros(0, np.int64) for k in ("key", "stretch", "first", "windows", "left")}
    h = _grams(data, (GRAM, 128))
    v = (h[GRAM] >> U(24) << U(24)) | np.arange(len(h[GRAM]), dtype=np.uint64)
    wide, k, least = length - GRAM + 1, 1, v
    while 2 * k <= wide:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[: len(least) - (wide - k)], least[wide - k :])[:starts]
    at = np.flatnonzero(np.arange(starts) + length <= stop[:starts])
    if not len(at):
        return anchors(data[:0], stop, length, 0)
    anchor, text = (least[at] & U(0xFFFFFF)).astype(np.int64), stop[at]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first, last, anchor = at[new], at[np.r_[new[1:] - 1, len(at) - 1]], anchor[new]
    head = (data[anchor].astype(np.int64) << 16) | (data[anchor + 1].astype(np.int64) << 8) | data[anchor + 2]
    key = (head - (1 << 23) << 40) | (h[GRAM][anchor] >> U(24)).astype(np.int64)
    windows, left = last - first + 1, anchor - first
    stretch = _string_hash(h[128], first, windows + length - 1) ^ (left.astype(np.uint64) * _MULTIPLY[8])
    return {"key": key, "stretch": stretch.view(np.int64), "first": first, "windows": windows, "left": left}


def text_hashes(text: Column) -> list[Column]:
    """Two hashes of 64 bits by which equal texts are known."""
    return [F.xxhash64(F.lit(1), text).alias("d1"), F.xxhash64(F.lit(2), text).alias("d2")]


def _places(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """A row for each anchor of each text: batch, key, stretch, n (equal texts of a scanned batch count at once), id, d1, d2, first,
    windows. Written by batch."""
    spark = docs.sparkSession
    rows = docs.where(F.octet_length("text") >= length).select("text", "id", *text_hashes(F.col("text")))
    id_type = rows.schema["id"].dataType
    names = ["batch", "key", "stretch", "n", "id", "d1", "d2", "first", "windows"]
    longs = [T.StructField(c, T.LongType()) for c in ("key", "stretch")]
    schema = T.StructType([T.StructField("batch", T.IntegerType()), *longs, T.StructField("n", T.LongType()), T.StructField("id", id_type), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("windows", T.IntegerType())])

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
            _, own, copies = np.unique(np.stack([d1, d2], axis=1), axis=0, return_index=True, return_counts=True)
            order = np.argsort(own)
            own, copies = own[order], copies[order]
            all_texts = list(each_text(batch, 0))
            texts = [all_texts[k] for k in own]
            sizes = np.array([len(t) for t in texts], np.int64)
            data, stops = np.concatenate([*texts, np.zeros(0, np.uint8)]), np.cumsum(sizes)
            for b in range(0, len(data), BLOCK):
                block = data[b : b + BLOCK + 2 * length]
                inside = np.searchsorted(stops, np.arange(b, b + len(block)), side="right")
                found = anchors(block, stops[inside] - b, length, BLOCK)
                n = len(found["key"])
                if not n:
                    continue
                which = inside[found["first"]]
                row = own[which]
                first = found["first"] + b - (stops - sizes)[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((d1[row] % batches).astype(np.int32)), pa.array(found["key"]), pa.array(found["stretch"]), pa.array(copies[which]), batch.column("id").take(pa.array(row)), pa.array(d1[row]), pa.array(d2[row]), pa.array(first.astype(np.int32)), pa.array(found["windows"].astype(np.int32))], names
                )

    path = shared_path(spark, "suffix-places")
    small_batches(spark)
    with shuffles_end(spark):
        rows.mapInArrow(scan, schema).write.partitionBy("batch").parquet(path)
    return spark.read.schema(schema).parquet(path)


class Family:
    """Levels of entries (key, stretch, n), each as large as all batches it holds; no two levels of the same size stay."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.live: list[DataFrame] = []

    def add(self, entries: DataFrame, tag: str) -> None:
        """Scans a batch's array with all levels, then takes it in."""
        own = _array(entries, f"suffix-{tag}")
        keys = own.groupBy("key").agg(F.sum("n").alias("n"))
        live = keys.where("n > 1").select("key")
        if self.levels:
            before = self.levels[0][1].select("key")
            for _, level in self.levels[1:]:
                before = before.unionByName(level.select("key"))
            live = live.unionByName(keys.where("n = 1").select("key").join(before.distinct(), "key", "left_semi"))
        self.live.append(written(live, f"suffix-live-{tag}"))
        self.levels.append((1, own))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge(tag)

    def _merge(self, tag: str) -> None:
        (n, a), (m, b) = self.levels.pop(), self.levels.pop()
        self.levels.append((n + m, _array(a.unionByName(b), f"suffix-{tag}-{n + m}")))
        emptied(a, b)

    def entries(self) -> DataFrame:
        """All entries in one level."""
        while len(self.levels) > 1:
            self._merge("all")
        return self.levels[0][1]

    def live_keys(self) -> DataFrame:
        keys = self.live[0]
        for more in self.live[1:]:
            keys = keys.unionByName(more)
        return keys.distinct()


def _array(entries: DataFrame, tag: str) -> DataFrame:
    """Entries added up by (key, stretch), each part of the table in that order."""
    return written(entries.groupBy("key", "stretch").agg(F.sum("n").alias("n")).sortWithinPartitions("key", "stretch"), tag)


def _of_keys(rows: DataFrame, keys: DataFrame, salts: int = 16) -> DataFrame:
    """Rows under ``keys``; where these are too many to broadcast, a key's rows are dealt to several tasks."""
    few = small(keys)
    if few is not keys:
        return rows.join(few, "key", "left_semi")
    each = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod("d1", F.lit(salts)).cast("int")).join(each, ["key", "salt"], "left_semi").drop("salt")


def _bytes_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, stretch, n, crowded, bytes) of each row of ``wanted``, from the text of its sample place."""
    each = F.struct("key", "stretch", "n", "crowded", F.col("at.first").alias("first"), F.col("at.windows").alias("windows"))
    by_text = wanted.groupBy(F.col("at.id").alias("sid"), F.col("at.d1").alias("s1"), F.col("at.d2").alias("s2")).agg(F.collect_list(each).alias("each"))
    by_text = written(by_text, "suffix-samples")
    texts = docs.select("id", "text", *text_hashes(F.col("text")))
    same = F.col("id").eqNullSafe(F.col("sid")) & (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))
    rows = texts.join(_few(by_text, F.size("each") * 40 + 64), same).select("text", "each")

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k, text in enumerate(each_text(batch, 0)):
                s = batch.column("each")[k].values
                first, size = s.field("first").to_numpy(), s.field("windows").to_numpy() + length - 1
                raw = text.tobytes()
                pieces = pa.array([raw[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(s.field(c) for c in ("key", "stretch", "n", "crowded")), pieces], ["key", "stretch", "n", "crowded", "bytes"])

    return rows.mapInArrow(cut, "key long, stretch long, n long, crowded boolean, bytes binary")


def _few(table: DataFrame, size: Column) -> DataFrame:
    """``table``, for a broadcast where its rows' ``size`` adds up to at most ``BROADCAST_BYTES``."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


RANGES = "key long, stretch long, ranges array<struct<from:int,to:int>>"


def _ranges(again: np.ndarray) -> list[dict]:
    """Of flags, the stretches [from, to) that are set."""
    edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def repeated_windows(groups: np.ndarray, pieces: list[np.ndarray], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows some other window of its group equals, or the piece's own count repeats.

    All windows are sorted by group and bytes, as a suffix array of the pieces cut at ``length``; equal ones are neighbours."""
    windows = np.array([max(0, len(p) - length + 1) for p in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces)), windows)
    data = np.concatenate([*pieces, np.zeros(length, np.uint8)])
    begin = np.cumsum([0, *(len(p) for p in pieces[:-1])])
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    table = np.empty((len(at), length + 4), np.uint8)
    table[:, :4] = groups[owner].astype(">u4").view(np.uint8).reshape(-1, 4)
    table[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    flat = table.view(f"S{length + 4}").ravel()
    order = np.argsort(flat)
    same = (table[order[1:]] == table[order[:-1]]).all(axis=1)
    again = counts[owner] > 1
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.split(again, np.cumsum(windows)[:-1])


def _matched(pieces: DataFrame, length: int) -> DataFrame:
    """``RANGES`` of the pieces with one place: windows that other pieces of the key hold, for keys that one task can take."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys = np.array([k for k, _ in held], np.int64)
                groups = np.unique(keys, return_inverse=True)[1]
                counts = np.array([n for n, _ in held.values()], np.int64)
                flags = repeated_windows(groups, [p for _, p in held.values()], counts, length)
                rows = [(k, s, _ranges(f)) for (k, s), n, f in zip(held, counts, flags, strict=True) if n == 1 and f.any()]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["key", "stretch", "ranges"])
                held.clear()

        last = None
        for batch in stream:
            for k, s, n, b in zip(*(batch.column(c).to_pylist() for c in ("key", "stretch", "n", "bytes")), strict=True):
                if k != last and size > 4_000_000:
                    yield from flush()
                    size = 0
                last = k
                held[k, s] = (n, np.frombuffer(b, np.uint8))
                size += 70 * len(b)
        yield from flush()

    return pieces.repartition("key").sortWithinPartitions("key", "stretch").mapInArrow(scan, RANGES)


def _matched_in_crowds(pieces: DataFrame, length: int) -> DataFrame:
    """As ``_matched``, for keys of any number of pieces: windows are rows, which Spark adds up by hash."""

    def spread(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k, s, n, b in zip(*(batch.column(c).to_pylist() for c in ("key", "stretch", "n", "bytes")), strict=True):
                h = _grams(np.frombuffer(b, np.uint8), (128,))[128]
                at = np.arange(len(b) - length + 1)
                w = _string_hash(h, at, np.full(len(at), length))
                full = [np.full(len(at), x, np.int64) for x in (k, s, min(n, 2))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, full), pa.array(at.astype(np.int32)), pa.array(w.view(np.int64))], ["key", "stretch", "n", "at", "w"])

    windows = pieces.dropDuplicates(["key", "stretch"]).mapInArrow(spread, "key long, stretch long, n long, at int, w long")
    windows = written(windows, "suffix-windows")
    again = windows.groupBy("key", "w").agg(F.sum("n").alias("c")).where("c > 1").select("key", "w")
    hits = windows.where("n = 1").join(again, ["key", "w"]).groupBy("key", "stretch").agg(F.collect_set("at").alias("at"))
    return hits.select("key", "stretch", F.transform("at", lambda a: F.struct(a.alias("from"), (a + 1).cast("int").alias("to"))).alias("ranges"))


def repeated_spans(docs: DataFrame, length: int = 200, batches: int = 4, crowd: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d1, d2, runs: for each text with repeated bytes, known by its two hashes, the maximal [from, to) of them, in order.

    ``length`` is from 200 to 250 (anchors and stretch hashes are laid out for it)."""
    if not 200 <= length <= 250:
        raise ValueError("length is from 200 to 250")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = _places(docs, length, batches)
    family = Family()
    for b in range(batches):
        family.add(places.where(F.col("batch") == b).select("key", "stretch", "n"), str(b))
    entries = family.entries()
    live = written(entries.join(family.live_keys(), "key", "left_semi"), "suffix-candidates")
    emptied(entries, *family.live)
    keys = live.groupBy("key").agg(F.count("*").alias("stretches"), F.min("n").alias("least"))
    mixed = written(keys.where("stretches > 1 AND least = 1").select("key", (F.col("stretches") > crowd).alias("crowded")), "suffix-mixed")
    sample = F.min(F.struct("id", "d1", "d2", "first", "windows")).alias("at")
    wanted = _of_keys(places, mixed.select("key")).groupBy("key", "stretch").agg(F.sum("n").alias("n"), sample).join(small(mixed), "key")
    pieces = written(_bytes_of(docs, wanted, length), "suffix-bytes")
    ranges = _matched(pieces.where("NOT crowded"), length)
    if not mixed.where("crowded").isEmpty():
        ranges = ranges.unionByName(_matched_in_crowds(pieces.where("crowded"), length))
    whole = live.where("n > 1").select("key", "stretch", F.lit(None).cast("array<struct<from:int,to:int>>").alias("ranges"))
    found = written(whole.unionByName(ranges), "suffix-matches")
    emptied(live, pieces)
    hits = places.join(found, ["key", "stretch"])
    span = lambda a, b: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"))
    of_ranges = F.transform("ranges", lambda r: span(F.col("first") + r["from"], F.col("first") + r["to"] + (length - 1)))
    every = F.array(span(F.col("first"), F.col("first") + F.col("windows") + (length - 1)))
    hits = hits.select("d1", "d2", F.explode(F.coalesce(of_ranges, every)).alias("span"))
    merge = F.arrow_udf(_joined, "array<struct<from:int,to:int>>")
    spans = written(hits.groupBy("d1", "d2").agg(F.collect_set("span").alias("spans")).select("d1", "d2", merge("spans").alias("runs")), "suffix-spans")
    emptied(places, found)
    return spans


def _joined(spans: pa.Array) -> pa.Array:
    """Overlapping and touching [from, to) of each row as one."""
    out = []
    for own in spans:
        a, b = own.values.field("from").to_numpy(), own.values.field("to").to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
        out.append([{"from": x, "to": y} for x, y in zip(a[new].tolist(), b[np.r_[new[1:] - 1, len(b) - 1]].tolist(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))


def _without(text: pa.Array, runs: pa.Array) -> pa.Array:
    """What is left of each text; null where runs are null."""
    out = []
    for raw, own in zip(text, runs, strict=True):
        if not own.is_valid:
            out.append(None)
            continue
        raw = raw.as_buffer().to_pybytes()
        starts, ends = own.values.field("from").to_pylist(), own.values.field("to").to_pylist()
        out.append(b"".join(raw[x:y] for x, y in zip([0, *ends], [*starts, len(raw)], strict=True)))
    return pa.array(out, pa.binary())


def without_repeats(docs: DataFrame, length: int = 200, batches: int = 4, crowd: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, runs (the removed [from, to), maximal, in order) and kept (binary) of each row."""
    spans = repeated_spans(docs, length, batches, crowd, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"))
    rows = rows.join(_few(spans, F.size("runs") * 16 + 64), (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left")
    cut = F.arrow_udf(_without, "binary")
    kept = cut(F.when(F.col("runs").isNotNull(), F.col("text").cast("binary")), "runs")
    empty = F.array().cast("array<struct<from:int,to:int>>")
    return rows.select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("runs", empty).alias("runs"), F.coalesce(kept, F.col("text").cast("binary")).alias("kept"))
