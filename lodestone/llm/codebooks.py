"""Vectors as short codes: parts, each coded by the nearest entry of a codebook that exact integer Lloyd rounds have moved.

Components become integers, floor(scale * x). A vector is cut into equal consecutive parts, and each part position has a codebook
of its own. Each round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index), then moves
each entry to the componentwise floor of its parts' mean.

Hamerly's bounds save most distances. With every part two numbers are kept from round to round: an upper bound of the distance to
its entry, and a lower bound of the distance to the second nearest one. Entries that move widen them by how far they went. While
the upper bound is strictly below the lower one, or below half the way from the entry to the nearest other entry, the assignment
stands: no other entry is as near, so there is no tie either. Otherwise the distance to the entry is measured and compared again,
and only if that fails too, all entries are looked at. Distances are exact integers; bounds are rounded away from each other.

A round is a scan of the written table of vectors with their bounds, which writes the next one; the former is emptied. Sums are
added up in each task and then by (part, entry, position). Codebooks (``entries`` vectors) pass through the driver.

Defined results: vectors that are null or hold a null or a non-finite component take no part. Shorter vectors count as filled up
with zeros, to the largest width and to a multiple of ``parts``. The first codebooks are the vectors with the smallest ids, null
ids last, rows that repeat an id by their components. With fewer vectors than entries there are fewer entries; entries that no
part takes stay. An empty table gives no codes. Components beyond 64 bits after scaling, and sums of squares beyond them in
``error``, count as the nearest number of 64 bits; assignments are by the whole numbers at any size. Errors are added up as
decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import emptied, written
from lodestone.llm.topk import integers

NARROW = 1 << 24  #: components up to this size have sums of squares that fit 64 bits, for parts of up to 4,096 components
MOST = np.iinfo(np.int64).max
STATE = "id long, label_at string, v array<long>, entry array<int>, upper array<double>, lower array<double>, scans int, error long"


@dataclass
class Codebooks:
    """``entries[part]``: a matrix of integers, a row an entry."""

    entries: list[np.ndarray]
    scanned: list[int] = field(default_factory=list)  #: full scans of each assignment, in parts

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for x in book.ravel()).encode()).hexdigest()


def _narrow(x: np.ndarray) -> np.ndarray:
    return (x.max(axis=1, initial=0) <= NARROW) & (x.min(axis=1, initial=0) >= -NARROW)


def _whole(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances as whole numbers of any size."""
    d = x.astype(object)[:, None, :] - c.astype(object)[None, :, :]
    return (d * d).sum(axis=2) if d.shape[2] else np.zeros(d.shape[:2], object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``c``: int64, or whole numbers of any size where some are not narrow."""
    top = (int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))) ** 2 * x.shape[1] if _narrow(x).all() and _narrow(c).all() else MOST
    if top >= 2**61:
        return _whole(x, c)
    kind = np.float64 if top < 2**51 else np.int64  # both exact; the former is faster
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to the row of ``c`` beside it; narrow rows only."""
    d = x - c
    return (d * d).sum(axis=1)


def _up(square: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(square.astype(np.float64)), np.inf) * (1 + 2**-50)


def _down(square: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(square.astype(np.float64)), 0) * (1 - 2**-50), 0)


@dataclass
class Book:
    """What a task needs of a codebook: entries, how far each went at most, how far the others went, half the way to the nearest."""

    c: np.ndarray
    went: np.ndarray
    others: np.ndarray
    half: np.ndarray
    narrow: np.ndarray

    @staticmethod
    def of(c: np.ndarray, before: np.ndarray | None) -> Book:
        k = len(c)
        went = np.zeros(k)
        if before is not None:
            d = c.astype(object) - before.astype(object)
            went = _up(np.array([sum(int(x) ** 2 for x in row) for row in d], object))
        others = np.array([np.delete(went, j).max(initial=0) for j in range(k)])
        half = np.full(k, np.inf)
        if k > 1:
            d = squared(c, c)
            d[np.arange(k), np.arange(k)] = d.max() + 1
            half = _down(d.min(axis=1)) / 2
        return Book(c, went, others, half, _narrow(c))


def _clipped(x: np.ndarray, book: Book) -> np.ndarray:
    """As ``squared`` for narrow rows, where some entries are not narrow; distances to these are cut at more than any other's."""
    d = np.full((len(x), len(book.c)), 2**62)
    d[:, book.narrow] = squared(x, book.c[book.narrow])
    d[:, ~book.narrow] = np.minimum(_whole(x, book.c[~book.narrow]), 2**62).astype(np.int64)
    return d


def assign(x: np.ndarray, book: Book, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The next entries and bounds of parts ``x``, and how many parts looked at all entries. ``entry`` is -1 before the first round."""
    entry, old = entry.copy(), np.maximum(entry, 0)
    upper = np.where(entry < 0, np.inf, (upper + book.went[old]) * (1 + 2**-50))
    lower = np.where(entry < 0, 0, np.maximum((lower - book.others[old]) * (1 - 2**-50), 0))
    enough = np.maximum(lower, book.half[old])
    open_ = np.flatnonzero(~(upper < enough))
    plain = open_[(entry[open_] >= 0) & _narrow(x[open_]) & book.narrow[old[open_]]]
    if len(plain):
        upper[plain] = _up(_own(x[plain], book.c[old[plain]]))
        open_ = open_[~(upper[open_] < enough[open_])]
    wide = ~_narrow(x[open_]) if book.narrow.any() else np.ones(len(open_), bool)
    for at, exact in ((open_[~wide], False), (open_[wide], True)):
        for s in range(0, len(at), 8192):
            rows = at[s : s + 8192]
            d = squared(x[rows], book.c) if exact or book.narrow.all() else _clipped(x[rows], book)
            near = d.argmin(axis=1)
            first = d[np.arange(len(rows)), near]
            if d.shape[1] > 1:
                d[np.arange(len(rows)), near] = d.max() + 1
                second = _down(d.min(axis=1))
            else:
                second = np.full(len(rows), np.inf)
            entry[rows], upper[rows], lower[rows] = near, _up(first), second
    return entry, upper, lower, len(open_)


def _matrix(column: pa.ListArray, n: int, kind: type) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1)


def _assigned(state: DataFrame, books: list[Book], measure: bool) -> DataFrame:
    """The table after one assignment; ``error`` is filled in if ``measure``."""
    parts, names = len(books), state.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column("v"), n, np.int64)
            entry, upper, lower = (_matrix(batch.column(c), n, t) for c, t in (("entry", np.int32), ("upper", np.float64), ("lower", np.float64)))
            scans, error, w = 0, np.zeros(n, object), v.shape[1] // parts
            for p, book in enumerate(books):
                x = np.ascontiguousarray(v[:, p * w : (p + 1) * w])
                entry[:, p], upper[:, p], lower[:, p], full = assign(x, book, entry[:, p], upper[:, p], lower[:, p])
                scans += full
                if measure:
                    c = book.c[entry[:, p]]
                    plain = _narrow(x) & _narrow(c)
                    error[plain] += _own(x[plain], c[plain])
                    for r in np.flatnonzero(~plain):
                        error[r] += int(_whole(x[r : r + 1], c[r : r + 1])[0, 0])
            lists = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(m.ravel(), t))
            error = [min(int(e), MOST) for e in error] if measure else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label_at"), batch.column("v"), lists(entry, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(np.r_[scans, np.zeros(n - 1)].astype(np.int32)), pa.array(error, pa.int64())], names)

    return state.mapInArrow(step, STATE)


def _sums(state: DataFrame, parts: int, k: int) -> DataFrame:
    """part, entry, n, and high and low halves of the sums by position: at most ``parts * k`` rows a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v, entry = _matrix(batch.column("v"), n, np.int64), _matrix(batch.column("entry"), n, np.int64)
            w = v.shape[1] // parts
            for p in range(parts):
                order = np.argsort(entry[:, p], kind="stable")
                which, first, count = np.unique(entry[order, p], return_index=True, return_counts=True)
                x = v[order, p * w : (p + 1) * w]
                high, low = (np.add.reduceat(y, first, axis=0) if w else np.zeros((len(first), 0), np.int64) for y in (x >> 32, x & 0xFFFFFFFF))
                for j, m, h, s in zip(which.tolist(), count.tolist(), high, low, strict=True):
                    if own := total.get((p, j)):
                        own[0] += m
                        own[1] += h
                        own[2] += s
                    else:
                        total[p, j] = [m, h.copy(), s.copy()]
        rows = [(p, j, m, h.tolist(), s.tolist()) for (p, j), (m, h, s) in total.items()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["part", "entry", "n", "high", "low"])

    return state.select("v", "entry").mapInArrow(add, "part int, entry int, n long, high array<long>, low array<long>")


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after an update: each entry is the floor of its parts' mean."""
    out = [b.copy() for b in books]
    if not books[0].shape[1]:
        return out
    each = _sums(state, len(books), len(books[0])).select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), total(F.col("s.high")).alias("high"), total(F.col("s.low")).alias("low"))
    for r in sums.toLocalIterator():
        out[r["part"]][r["entry"], r["at"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
    return out


def trained_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """(id, label_at, entry, error) of every vector that takes part, and the codebooks. ``label_at`` is the label as text."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label_at"), integers(F.col(vector_col), scale).alias("v")).where("v IS NOT NULL")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // parts) * parts
    v = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    empty = lambda x, t: F.array_repeat(F.lit(x).cast(t), parts)
    state = rows.select("id", "label_at", v.alias("v"), empty(-1, "int").alias("entry"), empty(0, "double").alias("upper"), empty(0, "double").alias("lower"), F.lit(0).alias("scans"), F.lit(0).cast("long").alias("error"))
    state = written(state, "codes-0")
    seeds = [r["v"] for r in state.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    first = np.array(seeds, np.int64).reshape(len(seeds), width)
    w, before, found = width // parts, None, Codebooks([])
    books = [np.ascontiguousarray(first[:, p * w : (p + 1) * w]) for p in range(parts)]
    for k in range(rounds + 1 if len(seeds) else 0):
        used = [Book.of(c, b) for c, b in zip(books, before or [None] * parts, strict=True)]
        last, state = state, written(_assigned(state, used, k == rounds), f"codes-{k + 1}")
        emptied(last)
        found.scanned.append(int(state.agg(F.sum("scans")).first()[0] or 0))
        if k < rounds:
            before, books = books, _moved(state, books)
    found.entries = books
    return state.select("id", "label_at", "entry", "error"), found


def code(entry: Column) -> Column:
    """Indexes in part order, two hexadecimal digits each."""
    return F.array_join(F.transform(entry, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the errors of all vectors of the same label added up, nulls together.

    Labels are added up in each task before they move. Where there are few of them Spark broadcasts the sums; else rows are dealt
    by label and a salt, and a label's sum goes to each of its salts, so that a label of many rows is no single task's work."""
    salts = 32
    sums = codes.groupBy(F.col("label_at").alias("sum_at")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = codes.withColumn("salt", F.pmod(F.xxhash64("id", "entry"), F.lit(salts)).cast("int"))
    same = F.col("label_at").eqNullSafe(F.col("sum_at")) & (dealt["salt"] == sums["salt"])
    return dealt.join(sums, same).drop("sum_at", "salt")
