"""Quality of whole texts by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Learned filters run over overlapping chunks of ``WIDTH`` bytes, one every ``STRIDE`` bytes, up to the
end of the text. Each place has two inputs: its byte, and how far back (2 to 31 bytes, or not at all) the eight bytes that start
there stand as well. Filters have a learned weight for each value of each input at each place of a chunk. Each filter's
strongest response over the whole text (max pooling) goes into one logistic unit, learned too: the probability that the label
is 1. Texts of any length are scored in blocks, so memory is bounded.

The network is trained on the driver on at most ``sample`` labelled rows of each class (those with the smallest hashes) of at
most ``most_chars`` characters; rows that ``held_out`` marks are never used. Scores use nothing but the text.

Defined results: null and empty texts get the score of a text without any response; without labels of both classes every
score is the share of label 1 (0.5 without any); conflicting labels of one row count as 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import small_batches
from lodestone.llm.shingles import each_text

WIDTH, STRIDE, FILTERS = 8, 4, 16
LAGS = range(2, 32)
PAD = 48  #: zero bytes after each text, more than a lag and eight bytes
BLOCK = 1 << 20
THRESHOLD = 0.7


def held_out(id_col: Column) -> Column:
    """One row in four, by a checksum of its id as text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Network:
    """filters: (WIDTH, 256, FILTERS) for bytes; back: (WIDTH, 32, FILTERS) for distances; out: weights of the pooled responses."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.filters = draw.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.back = draw.normal(0, 0.1, (WIDTH, LAGS.stop, FILTERS)).astype(np.float32)
        self.out = draw.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.float32(0.0)

    def respond(self, buffer: np.ndarray, lags: np.ndarray) -> np.ndarray:
        """Responses of each chunk of a buffer."""
        n = (len(buffer) - WIDTH) // STRIDE + 1
        acts = np.zeros((n, FILTERS), np.float32)
        for j in range(WIDTH):
            acts += np.take(self.filters[j], buffer[j : j + n * STRIDE : STRIDE], axis=0)
            acts += np.take(self.back[j], lags[j : j + n * STRIDE : STRIDE], axis=0)
        return acts

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Each text's strongest response of each filter (not below 0)."""
        out = np.zeros((len(texts), FILTERS), np.float32)
        for buffer, owner, first, stop in packed(texts):
            acts = self.respond(buffer, distances(buffer))
            np.maximum.at(out, owner, np.maximum.reduceat(acts, np.stack([first, stop], axis=1).ravel(), axis=0)[::2])
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.pooled(texts) @ self.out + self.bias).astype(np.float64), -30, 30)))


def packed(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid out in buffers of about ``BLOCK`` bytes: (buffer, owners, first, stop), the chunks of each piece of a text.

    A text's chunks start at each ``STRIDE``-th byte (an empty text has one). Long texts are cut into pieces with some bytes of
    what is before and after them, and each chunk counts in one piece, where all that it looks at is there."""
    parts, owner, first, stop, size = [], [], [], [], 0

    def flush():
        return np.concatenate([*parts, np.zeros(WIDTH, np.uint8)]), np.array(owner), np.array(first), np.array(stop)

    for i, t in enumerate(texts):
        n = max(1, len(t))
        for at in range(0, n, BLOCK):
            low = max(0, at - 2 * PAD)
            piece = t[low : at + BLOCK]
            parts += [piece, np.zeros(PAD + -(len(piece) + PAD) % STRIDE, np.uint8)]
            begin, end = max(0, at - PAD), n if at + BLOCK >= n else at + BLOCK - PAD
            owner.append(i), first.append((size + begin - low) // STRIDE), stop.append((size + end - low + STRIDE - 1) // STRIDE)
            size += len(piece) + len(parts[-1])
            if size >= BLOCK:
                yield flush()
                parts, owner, first, stop, size = [], [], [], [], 0
    if parts:
        yield flush()


def distances(buffer: np.ndarray) -> np.ndarray:
    """For each place, the least of ``LAGS`` so many places before which the same eight bytes start; 0 for none."""
    out = np.zeros(len(buffer), np.uint8)
    n = len(buffer) - 7
    eight = np.ndarray((n,), "<u8", np.ascontiguousarray(buffer).data, 0, (1,))
    for lag in reversed(LAGS):
        if n > lag:
            out[lag:n][(eight[lag:] == eight[:-lag]) & (eight[lag:] != 0)] = lag
    return out


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 0.03, seed: int = 7) -> Network:
    """Adam on the log loss; only the chunk with a filter's strongest response passes its gradient on.

    Short pieces of good texts are added as good texts: a few responses must do where a text has no more.
    """
    net, draw, t = Network(seed), np.random.default_rng(seed), 0
    good = [texts[i] for i in np.flatnonzero(labels == 1)]
    for i in draw.integers(0, len(good), len(good) // 3):
        at = int(draw.integers(0, max(1, len(good[i]) - 16)))
        texts = [*texts, good[i][at : at + int(draw.integers(8, 64))]]
    labels = np.r_[labels, np.ones(len(texts) - len(labels), labels.dtype)]
    params = [net.filters, net.back, net.out]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for at in range(0, len(texts), batch):
            pick = order[at : at + batch]
            pooled = np.zeros((len(pick), FILTERS), np.float32)
            where: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for buffer, owner, first, stop in packed([texts[i] for i in pick]):
                lags = distances(buffer)
                acts = net.respond(buffer, lags)
                for k, i in enumerate(owner):
                    piece = acts[first[k] : stop[k]]
                    best = piece.argmax(axis=0)
                    for f in np.flatnonzero(piece[best, np.arange(FILTERS)] > pooled[i]):
                        pooled[i, f] = piece[best[f], f]
                        p = (first[k] + best[f]) * STRIDE
                        where[i, f] = buffer[p : p + WIDTH], lags[p : p + WIDTH]
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
            miss = (p - labels[pick]).astype(np.float32) * weight[pick] / len(pick)
            grads = [np.zeros_like(net.filters), np.zeros_like(net.back), pooled.T @ miss + 1e-4 * net.out]
            for (i, f), (chunk, back) in where.items():
                grads[0][np.arange(WIDTH), chunk, f] += miss[i] * net.out[f]
                grads[1][np.arange(WIDTH), back, f] += miss[i] * net.out[f]
            t += 1
            for w, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
            net.bias = np.float32(net.bias - rate * miss.sum())
    return net


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 800, most_bytes: int = 8_000) -> Network | float:
    """A network from a bounded sample of labelled rows, or the share of label 1 where a class is missing.

    Of a longer text, ``most_bytes`` bytes from a place by its hash are learned from; scoring always takes whole texts."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(id_col).agg(F.min(label_col).alias("label"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    known = rows.join(docs.select(id_col), id_col, "left_semi")
    picked = known.where("label = 1").orderBy(*order).limit(sample).unionByName(known.where("label <> 1").orderBy(*order).limit(sample))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    start = F.pmod(F.xxhash64(text), F.greatest(F.octet_length(text) - most_bytes + 1, F.lit(1))).cast("int")
    texts = docs.select(F.col(id_col), F.substring(text, start + 1, F.lit(most_bytes)).alias("__text"))
    got = texts.join(F.broadcast(picked), id_col)  # at most 2 * sample ids are broadcast
    # of rows that repeat an id, the one with the least text
    got = got.groupBy(id_col, "label").agg(F.min("__text").alias("__text")).collect()
    got.sort(key=lambda r: (r[id_col], r["__text"]))
    y = np.array([int(r["label"] == 1) for r in got])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train([np.frombuffer(r["__text"], np.uint8) for r in got], y)


def scored(docs: DataFrame, model: Network | float, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score of each whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                score = sent.value.score(list(each_text(b, at))) if isinstance(sent.value, Network) else np.full(b.num_rows, sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, out_col])

    return docs.mapInArrow(run, f"{kinds}, `{out_col}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted (1 from ``THRESHOLD`` on)."""
    out = scored(docs.select(id_col, text_col), fitted(docs, labels, id_col, text_col), text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those the classifier rejects."""
    return scored(docs, fitted(docs, labels, id_col, text_col), text_col, "__score").where(F.col("__score") >= THRESHOLD).select(*docs.columns)
