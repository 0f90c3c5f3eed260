"""Periodic runs of words, found through Lyndon arrays, and texts without their repeated periods.

A run is a stretch of words with a smallest period q that can't be extended on either side. Every run holds a Lyndon word of
length q for one of two orders of its words, and that word is the longest Lyndon word at its place, which ends at the next
smaller suffix. So both orders' next smaller suffixes give all candidates.

``lyndon`` finds them from right to left. To compare two suffixes it matches words only up to a place from which a pair of
suffixes follows that was compared before, and takes that pair's matched length: pairs are edges to the next or the previous
smaller suffix, at most two a word, each kept with its length. From one candidate to the next, two known lengths that differ
decide without a look at the words, and equal ones are where matching goes on. The length matched at a candidate is the run's
extension to the right; its extension to the left is less than a period, or the run was found at an earlier word. No suffix
array, no hashes.

Words become numbers by sorting (``ranks``). Before that, ``stretches`` leaves out, exactly, what no run can reach: in a run of at
least three periods, each word after the first period has its like at most a period before, so a stretch of at least twice the
largest such gap is needed.

Defined results: a null text is empty; texts without words have no runs; rows are independent, so that repeated rows, null ids
and ties give each row its own result; an empty table gives no rows. Other columns than those named are left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import small_batches
from lodestone.llm.shingles import _SPACE, each_text

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon(x: array) -> tuple[array, array]:
    """Of each place, the start of the next smaller suffix, and how many words both suffixes share; the end counts as smallest."""
    n = len(x)
    zeros = bytes(4 * (n + 1))
    nxt, shared, prev, prev_shared = (array("i", zeros) for _ in range(4))
    for k in range(n + 1):
        prev[k] = -1
    nxt[n] = n
    for i in range(n - 1, -1, -1):
        j, same = i + 1, 0
        while j < n:
            a, b = i + same, j + same
            while True:
                if b == n:
                    smaller = True
                elif same and nxt[a] == b:
                    same, smaller = same + shared[a], True
                elif same and prev[b] == a:
                    same, smaller = same + prev_shared[b], False
                elif x[a] != x[b]:
                    smaller = x[b] < x[a]
                else:
                    same, a, b = same + 1, a + 1, b + 1
                    continue
                break
            while not smaller:
                prev[j], prev_shared[j] = i, same
                known, j = shared[j], nxt[j]
                if j == n or known == same:  # both are known to go on alike so far: match from there
                    break
                if known < same:  # the next one departs from both, downwards
                    same, smaller = known, True
            if smaller:
                break
        else:
            same = 0
        nxt[i], shared[i] = j, same
    return nxt, shared


def find_runs(x: np.ndarray, min_length: int = 2, min_periods: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` and ``min_periods`` periods, by start and period.

    ``min_periods`` is 2 at least."""
    found = set()
    for sign in (1, -1):
        y = array("i", (sign * x).astype(np.int32).tobytes())
        nxt, shared = lyndon(y)
        ends = np.frombuffer(nxt, np.int32)[:-1].astype(np.int64)
        period = ends - np.arange(len(y))
        right = np.frombuffer(shared, np.int32)[:-1].astype(np.int64)
        for i in np.flatnonzero((right > (min_periods - 2) * period) & (ends < len(y))).tolist():
            p, r = int(period[i]), int(right[i])
            if i >= p and nxt[i - p] == i and shared[i - p] >= p:
                continue  # not the first root of its run
            left = 0
            while left < p and left < i and y[i - 1 - left] == y[i + p - 1 - left]:
                left += 1
            if left < p and left + p + r >= max(min_length, min_periods * p):
                found.add((i - left, left + p + r, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other in ``data``, each in [begin, stop)."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = begins < stops
    at = begins[full]
    first[at] = word[at]
    at = stops[full] - 1
    last[at] = word[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words and no others: words are sorted by seven bytes and their length left, then by seven more."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def chunk(which: np.ndarray, skip: int) -> np.ndarray:
        left = np.minimum(ends[which] - starts[which] - skip, 8)
        v = np.ascontiguousarray(windows[starts[which] + skip]).view(">u8").ravel().astype(np.uint64)
        shift = (8 * (8 - np.minimum(left, 7))).astype(np.uint64)
        return (v >> shift << shift) | left.astype(np.uint64)

    if not len(starts):
        return np.zeros(0, np.int64)
    out = np.unique(chunk(np.arange(len(starts)), 0), return_inverse=True)[1].astype(np.int64)
    size, skip, base = ends - starts, 7, int(out.max()) + 1
    more = np.arange(len(starts))
    while len(more := more[size[more] > skip]):
        v = chunk(more, skip)
        order = np.lexsort((v, out[more]))
        a, b = out[more][order], v[order]
        out[more[order]] = base + np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        base, skip = base + len(more), skip + 7
    return out


def stretches(word: np.ndarray, text: np.ndarray, first: np.ndarray, count: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int]]:
    """[from, to) of words between which runs of at least three periods may lie, with a word to spare on each side where the text
    has one. ``word`` and ``text`` number each word's like and its text; texts have ``count`` words from ``first`` on."""
    n = len(word)
    if not n:
        return []
    order = np.argsort(text * (int(word.max()) + 1) + word, kind="stable")
    w, t = word[order], text[order]
    again = np.flatnonzero((w[1:] == w[:-1]) & (t[1:] == t[:-1])) + 1
    gap = np.full(n, n + 1, np.int64)
    gap[order[again]] = order[again] - order[again - 1]
    least = -(-min_length * (min_periods - 1) // min_periods)
    found, reach, deepest = [], 8, int(count.max())
    while True:
        near = np.concatenate([[False], gap <= reach, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1])
        u, v = edge[::2], edge[1::2]
        cut = v - u >= max(least, (reach // 2) * (min_periods - 1) if reach > 8 else least)
        found += [(a - (b - a) // (min_periods - 1) - 1, b + 1, int(text[a])) for a, b in zip(u[cut].tolist(), v[cut].tolist(), strict=True)]
        if reach >= deepest:
            break
        reach *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted((max(a, int(first[k])), min(b, int(first[k] + count[k]))) for a, b, k in found):
        if merged and a < merged[-1][1]:  # of the same text, as none reaches beyond its own
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _column(pieces: list[bytes]) -> pa.Array:
    """Strings from their UTF-8 bytes."""
    raw = pa.array(pieces, pa.binary())
    return pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2])


def _batch(texts: list[np.ndarray], min_length: int, min_periods: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Of each text: its number of words, its runs, and its kept words joined by spaces."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.concatenate([*texts, np.zeros(0, np.uint8)])
    stops = np.cumsum(sizes)
    begins = stops - sizes
    starts, ends = words_of(data, begins, stops)
    first = np.searchsorted(starts, begins)
    count = np.searchsorted(starts, stops) - first
    text = np.repeat(np.arange(len(texts)), count)
    word = ranks(data, starts, ends)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in stretches(word, text, first, count, min_length, min_periods):
        k = int(text[a])
        at, end = int(first[k]), int(first[k] + count[k])
        for s, length, p in find_runs(np.unique(word[a:b], return_inverse=True)[1], min_length, min_periods):
            if (s > 0 or a == at) and (s + length < b - a or b == end):
                runs.setdefault(k, []).append((a + s - at, length, p))
    raw = data.tobytes()
    for k in range(len(texts)):
        own = sorted(runs.get(k, []), key=lambda r: (r[0], r[2]))
        kept = np.arange(int(first[k]), int(first[k] + count[k]))
        if own:
            change = np.zeros(int(count[k]) + 1, np.int64)
            for s, length, p in own:
                change[s + p] += 1
                change[s + length] -= 1
            kept = kept[np.cumsum(change)[:-1] == 0]
        s, e = starts[kept].tolist(), ends[kept].tolist()
        yield int(count[k]), own, b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])


def word_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """``carry`` columns, n_words, runs (by start, then period), and collapsed: the words that no run holds after its first period.

    Words are what lies between ASCII white space. ``min_periods`` is 3 at least, as ``stretches`` needs it."""
    if min_periods < 3:
        raise ValueError("min_periods is 3 at least")
    small_batches(docs.sparkSession)
    carry = carry or ["doc_id"]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *carry)
    fields = [rows.schema[c] for c in carry]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = list(_batch(list(each_text(batch, 0)), min_length, min_periods))
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in each], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([n for n, _, _ in each], pa.int64()), runs, _column([c for _, _, c in each])], [*carry, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(found, schema)


def strongest(runs: Column) -> Column:
    """Of an array of runs, the one with the greatest length / period (of equal ones the first); null for none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))), "")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: a stated tenth of the texts made periodic from a stated word on, for measuring what ``word_runs`` finds.

    With n words, h the CRC32 of the id as text and g = h div 10: if h mod 10 is 0, word i >= a becomes word a + (i - a) mod p, where
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other texts, and rows with a null id, stay."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    rows = rows.withColumn("p", (F.floor((n - F.col("a")) / (3 + g % 8)) + 1).cast("int"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(F.col("w"), F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(again, " ")).alias("text"))
