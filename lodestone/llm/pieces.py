"""SentencePiece BPE encoding and decoding by a max-plus parallel scan.

The supplied vocabulary is a BPE model. A sequence of pieces is the BPE encoding of its text exactly if each two adjacent
pieces are the encoding of their own concatenation: the first merge that would cross a border of the sequence would cross it
in those two pieces alone as well. So encoding is a best path: a node is an occurrence of a piece in the text, and an edge
between adjacent occurrences weighs 0 if the two are compatible and minus infinity if not. In the max-plus semiring one path
from start to end weighs 0, and it is the encoding.

A document over ``chunk_chars`` is cut into chunks, each with ``max_len - 1`` characters of its neighbours. A boundary's states
are the occurrences that start before it and end at or after it. Each chunk yields a matrix from the states of its left
boundary to those of its right one; matrices are combined associatively per document (prefixes from the left, suffixes from
the right), which fixes one state at each boundary; each chunk is then backtraced on its own between its two states.
Shorter documents are the same with one chunk. Within a chunk, no piece spans the start of a run of spaces (checked when the
model is loaded), so all paths meet there and the words between are solved once and kept in a bounded cache.

Defined results: null and empty texts have no pieces; unknown characters become byte pieces; U+2581 in a text counts as a
space, as in SentencePiece, and decodes to one; rows with equal or null ids are rows of their own; an empty table gives none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import small_batches, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 32_768
SPACE = "▁"
CACHED_WORDS, CACHED_LENGTH, CACHED_PAIRS = 120_000, 32, 1_000_000
SOLVED_ROWS = 256  #: matrices that a task combines, about


class Vocabulary:
    """Pieces of a model, which of them may follow each other, and encodings of words."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        text = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {text[i]: m.get_score(i) for i in plain}
        self.id = {text[i]: i for i in plain}
        bad = [t for t in self.id if SPACE in t.lstrip(SPACE)]
        if bad:
            raise ValueError(f"pieces with a space after another character, such as {bad[0]!r}, are not supported")
        self.byte = {int(text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.max_len = max(map(len, self.id))
        self.follows: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.known = {t: self.merge(t) == [t] for t in self.id}
        # a tree by character: (children, the piece that ends here if it is the encoding of its own text)
        self.tree: dict = {}
        for t, whole in self.known.items():
            level = self.tree
            for n, ch in enumerate(t, 1):
                level = level.setdefault(ch, [{}, None])
                if n == len(t) and whole:
                    level[1] = t
                level = level[0]
        for ch, node in self.tree.items():
            node[1] = ch  # a character stands for itself
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Greedy merging, for short strings: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, piece: str) -> bool:
        """Whether a piece, or an unknown character, is the encoding of its own text."""
        return self.known.get(piece, len(piece) == 1)

    def compatible(self, a: str, b: str) -> bool:
        after = self.follows.setdefault(a, {})
        if (got := after.get(b)) is None:
            if self.pairs >= CACHED_PAIRS:
                self.follows.clear()
                self.pairs, after = 0, self.follows.setdefault(a, {})
            self.pairs += 1
            got = after[b] = self.merge(a + b) == [a, b]
        return got

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte.get(x, self.unknown) for x in p.encode("utf-8", "replace")] if self.byte else [self.unknown]
        return out

    def paths(self, text: str, start: int, stop: int, before: str | None) -> list[str | None]:
        """For each end in (start, stop]: the last piece of the one valid path from ``start`` to it that follows ``before``, or None."""
        last: list[str | None] = [None] * (stop - start + 1)
        tree, follows, none = self.tree, self.follows, {}
        for begin in range(start, stop):
            prev = before if begin == start else last[begin - start]
            if prev is None and begin > start:
                continue
            after = none if prev is None else follows.get(prev, none)
            level, at = tree, begin - start
            for ch in text[begin : min(stop, begin + self.max_len)]:
                at += 1
                node = level.get(ch)
                if node is None:
                    if level is not tree:
                        break
                    level, piece = none, ch  # an unknown character stands for itself
                else:
                    level, piece = node
                if piece is not None and last[at] is None:
                    if prev is not None:
                        fits = after.get(piece)
                        if not (self.compatible(prev, piece) if fits is None else fits):
                            continue
                    last[at] = piece
        return last

    def back(self, last: list[str | None], length: int) -> list[str]:
        out = []
        while length > 0:
            piece = last[length]
            assert piece is not None
            out.append(piece)
            length -= len(piece)
        return out[::-1]

    def word(self, word: str) -> bytes:
        """Ids (int32) of a space and ``word``, which has no space; all paths meet where it starts and where it ends."""
        got = self.older.get(word)
        if got is None:
            got = self.solved(SPACE + word)
        if len(word) <= CACHED_LENGTH:
            if len(self.words) >= CACHED_WORDS:  # words not met since the last change are forgotten
                self.words, self.older = {}, self.words
            self.words[word] = got
        return got

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that a text has at a place, the longest last."""
        level, out = self.tree, []
        for ch in text[at : at + self.max_len]:
            node = level.get(ch)
            if node is None:
                if level is self.tree:
                    out.append(ch)  # an unknown character stands for itself
                break
            level, piece = node
            if piece is not None:
                out.append(piece)
        return out

    def solved(self, text: str) -> bytes:
        """Ids (int32) of the one valid path through a text that starts and ends where all paths meet.

        Depth first, longest pieces first: only one valid path leads to any place, so a place from which the end can't be
        reached is left for good.
        """
        n, at, prev, path, dead, held = len(text), 0, None, [], set(), []
        choice, follows = self.starting(text, 0), self.follows
        while at < n:
            while choice:
                piece = choice.pop()
                end = at + len(piece)
                if end in dead:
                    continue
                if prev is not None:
                    after = follows.get(prev)
                    fits = after.get(piece) if after is not None else None
                    if not (self.compatible(prev, piece) if fits is None else fits):
                        continue
                held.append((at, prev, choice))
                path.append(piece)
                at, prev = end, piece
                if at < n:
                    choice = self.starting(text, at)
                break
            else:
                dead.add(at)
                at, prev, choice = held.pop()
                path.pop()
        ids = self.ids_of(path)
        return struct.pack(f"{len(ids)}i", *ids)

    def stretches(self, text: str, fresh: bool = True) -> np.ndarray:
        """Ids of a text that starts and ends where all paths meet, after one more space if it starts a document."""
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        if not fresh and text[0] != " ":
            head, _, text = text.partition(" ")
            out.append(self.solved(head))
            parts = text.split(" ") if _ else []
        else:
            parts = text.split(" ") if fresh else text[1:].split(" ")
        run = 0
        for w in parts:
            if w:
                if run:
                    out.append(self.solved(SPACE * (run + 1) + w))
                    run = 0
                else:
                    out.append(self.words.get(w) or self.word(w))
            else:
                run += 1
        if run:
            out.append(self.solved(SPACE * run))
        return np.frombuffer(b"".join(out), np.int32)


class Spelling:
    """The bytes that each id stands for."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        text = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.raw = [bytes([int(t[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else t.encode() for i, t in enumerate(text)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def spaced(text: str) -> str:
    return text.replace(SPACE, " ") if SPACE in text else text


class Chunk:
    """A stretch ``text[left:right]`` of a document, with some of what is before and after it. first, last: of its document."""

    def __init__(self, v: Vocabulary, text: str, left: int, right: int, first: bool, last: bool):
        self.v, self.text, self.left, self.right, self.first, self.last = v, text, left, right, first, last

    def states(self, at: int) -> list[tuple[int, str]]:
        """Occurrences (start, piece) that start before a boundary and end at or after it; in order, so that both sides number them alike."""
        out = []
        for begin in range(max(0, at - self.v.max_len), at):
            for end in range(at, min(len(self.text), begin + self.v.max_len) + 1):
                piece = self.text[begin:end]
                if self.v.stands(piece):
                    out.append((begin, piece))
        return out

    def entries(self) -> list[tuple[int, str | None]]:
        return [(0, None)] if self.first else self.states(self.left)  # type: ignore[list-item]

    def meets(self) -> tuple[int, int] | None:
        """The first and the last place from ``left``, before ``right``, where all paths meet."""
        t, found = self.text, []
        i = t.find(SPACE, max(self.left, 1))
        while 0 <= i < self.right:
            if t[i - 1] != SPACE:
                found.append(i)
                break
            i = t.find(SPACE, i + 1)
        if not found:
            return None
        j = t.rfind(SPACE, found[0], self.right)
        while j > found[0] and t[j - 1] == SPACE:
            j -= 1
        return found[0], j

    def end(self, state: tuple[int, str | None]) -> int:
        return state[0] + len(state[1]) if state[1] is not None else self.left

    def out(self, start: int, before: str | None) -> tuple[list[str | None], list[int]]:
        """Paths from ``start``, and which exit states they reach."""
        stop = min(len(self.text), self.right + self.v.max_len - 1)
        last = self.v.paths(self.text, start, stop, before)
        ends = [e for e in range(max(self.right, start + 1), stop + 1) if (p := last[e - start]) is not None and e - len(p) < self.right]
        number = {s: i for i, s in enumerate(self.states(self.right))}
        return last, [number[e - len(last[e - start]), last[e - start]] for e in ends]  # type: ignore[arg-type,index]

    def matrix(self) -> np.ndarray:
        """Weights (0 or minus infinity) from entry states to exit states."""
        entries, exits = self.entries(), self.states(self.right)
        m = np.full((len(entries), len(exits)), -np.inf, np.float32)
        meet = self.meets()
        tail = self.out(meet[1], None)[1] if meet else []
        for i, state in enumerate(entries):
            start = self.end(state)
            if meet:
                if start == meet[0] or self.v.paths(self.text, start, meet[0], state[1])[-1] is not None:
                    m[i, tail] = 0
            elif start >= self.right:  # the entry's piece covers the whole chunk
                if (state[0], state[1]) in exits:
                    m[i, exits.index((state[0], state[1]))] = 0  # type: ignore[arg-type]
            else:
                m[i, self.out(start, state[1])[1]] = 0
        return m

    def trace(self, entry: int, exit_: int) -> list[int]:
        """Ids of the pieces that start in this chunk, on the path between two states."""
        state, (begin, piece) = self.entries()[entry], self.states(self.right)[exit_]
        start, stop, meet, v = self.end(state), begin + len(piece), self.meets(), self.v
        if start >= self.right and not meet:
            return []
        if not meet:
            last = v.paths(self.text, start, stop, state[1])
            return v.ids_of(v.back(last, stop - start))
        head = v.ids_of(v.back(v.paths(self.text, start, meet[0], state[1]), meet[0] - start))
        tail = v.paths(self.text, meet[1], stop, None)
        middle = v.stretches(self.text[meet[0] : meet[1]].replace(SPACE, " "), fresh=False).tolist()
        return head + middle + v.ids_of(v.back(tail, stop - meet[1]))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf, np.float32)


def scanned(matrices: list[np.ndarray], op) -> list[np.ndarray]:
    """Inclusive prefixes under an associative operation, in log2(n) rounds of doubling."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [x if i < step else op(out[i - step], x) for i, x in enumerate(out)]
        step *= 2
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Each chunk's entry and exit state on the one path that weighs 0 from the start to the end."""
    forth = scanned(matrices, combine)
    back = scanned(matrices[::-1], lambda b, a: combine(a, b))[::-1]
    ends = [int(np.argmax(forth[-1][0]))]
    end = ends[0]
    exits = [int(np.argmax(forth[k][0] + back[k + 1][:, end])) for k in range(len(matrices) - 1)] + ends
    return list(zip([0, *exits[:-1]], exits, strict=True))


_loaded: dict = {}


def loaded(kind: type, model: bytes):
    """A Vocabulary or Spelling; one per worker process and model."""
    if (k := (kind, hash(model))) not in _loaded:
        _loaded[k] = kind(model)
    return _loaded[k]


def cut(text: str, size: int, margin: int) -> Iterator[tuple[str, int, int]]:
    """Windows of a normalised text: (window, left, right)."""
    for at in range(0, len(text), size):
        low, right = max(0, at - margin), min(len(text), at + size)
        yield text[low : right + margin - 1], at - low, right - low


def encode(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, model: str = MODEL, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``carry`` columns (default: all but the text) with ids array<int> and n_chunks. The model file (bounded) goes to the workers by broadcast."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    with open(model, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.struct(*carry).alias("kept") if carry else F.lit(None).cast("string").alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["kept"].dataType.simpleString()
    long = F.length("text") >= chunk_chars

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(Vocabulary, sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [v.stretches(spaced(t)) for t in part.column(1).to_pylist()]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([1] * part.num_rows, pa.int32())], ["kept", "ids", "n_chunks"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = loaded(Vocabulary, sent.value).max_len
        for b in batches:
            for i in range(b.num_rows):
                windows = list(cut(normal(b.column(2)[i].as_py()), chunk_chars, margin))
                n = len(windows)
                for k, (text, left, right) in enumerate(windows):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([text]), pa.array([left], pa.int32()), pa.array([right], pa.int32())], ["rid", "kept", "k", "n", "window", "left", "right"])

    def chunk(v: Vocabulary, r: dict) -> Chunk:
        return Chunk(v, r["window"], r["left"], r["right"], r["k"] == 0, r["k"] == r["n"] - 1)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(Vocabulary, sent.value)
        for b in batches:
            for r in b.to_pylist():
                m = chunk(v, r).matrix()
                yield pa.RecordBatch.from_pylist([{"rid": r["rid"], "k": r["k"], "n_in": m.shape[0], "weights": m.tobytes()}], pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("n_in", pa.int32()), ("weights", pa.binary())]))

    def solve(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        got = boundary_states([np.frombuffer(w, np.float32).reshape(n, -1) for n, w in zip(pdf.n_in, pdf.weights, strict=True)])
        return pd.DataFrame({"rid": pdf.rid.to_numpy(), "k": pdf.k.to_numpy(), "enter": [a for a, _ in got], "leave": [b for _, b in got]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(Vocabulary, sent.value)
        for b in batches:
            for i, r in enumerate(b.drop_columns(["kept"]).to_pylist()):
                ids = chunk(v, r).trace(r["enter"], r["leave"])
                yield pa.RecordBatch.from_arrays([b.column("rid").slice(i, 1), b.column("kept").slice(i, 1), b.column("k").slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], ["rid", "kept", "k", "ids"])

    out = rows.where(~long).mapInArrow(short, f"kept {kind}, ids array<int>, n_chunks int")
    giants = rows.where(long).select(F.monotonically_increasing_id().alias("rid"), "kept", "text")
    chunks = written(giants.mapInArrow(chunked, f"rid long, kept {kind}, k int, n int, window string, left int, right int"), "pieces-chunks")
    if not chunks.isEmpty():
        moved = chunks.select("rid", "k", "n", "window", "left", "right").mapInArrow(transfer, "rid long, k int, n_in int, weights binary")
        # documents are dealt to tasks of about SOLVED_ROWS matrices; a text is at most 2 GB, so one has at most 65,536 small ones
        tasks = max(1, -(-chunks.count() // SOLVED_ROWS))
        states = moved.repartition(tasks, "rid").groupBy("rid").applyInPandas(solve, "rid long, k int, enter int, leave int")
        traced = chunks.join(states, ["rid", "k"]).mapInArrow(trace, f"rid long, kept {kind}, k int, ids array<int>")
        whole = traced.groupBy("rid").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        out = out.unionByName(whole.select("kept", F.flatten(F.col("parts.ids")).alias("ids"), F.size("parts").alias("n_chunks")))
    return out.select(*[F.col(f"kept.`{c}`") for c in carry], "ids", "n_chunks")


def decode(encoded: DataFrame, carry: list[str], model: str = MODEL) -> DataFrame:
    """``carry`` columns with the text that ``ids`` stand for."""
    with open(model, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select(F.struct(*carry).alias("kept"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(Spelling, sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.decode(x.values.to_numpy()) for x in part.column(1)], pa.string())], ["kept", "text"])

    out = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, text string")
    return out.select(*[F.col(f"kept.`{c}`") for c in carry], "text")
