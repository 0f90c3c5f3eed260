"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans are what the patterns of ``BASE`` find and their checks admit: leftmost, not overlapping within a kind. They stay.

The semi-Markov model adds spans. A text is cut into tokens (letters, digits, white space, single marks); a candidate segment is up
to ``MOST`` tokens that begin and end with a letter, a digit or an opening mark and hold a digit or an @. Its features are of the
whole span: its shape, length, digit count, checksum, parts, and the words before and after. Segment scores are sums of learned
weights and of a weight for each pair of neighbouring labels. Dynamic programming over (end, label) with segments of bounded
length chooses boundaries and types together; a segment without a digit or @ can only be outside, so stretches without
those characters are left out before, and long stretches are cut where no segment can be. Weights are learned on the driver from generated examples, by gradient ascent on the
conditional likelihood with the forward and backward sums over all segmentations.

Added kinds: email, ip, card and phone in forms that the patterns miss, and secret (assigned keys and tokens). An added span
never overlaps a base span.

Defined results: null and empty texts have no spans; texts of any length are read whole; positions are code points; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.shared import small_batches

# The base patterns, in the order in which kinds are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = (*BASE, "secret")
LABELS = ("out", *KINDS)
BLANK = "blank"  #: the last feature of a segment that holds white space
WHOLE = frozenset(LABELS.index(k) for k in ("email", "ip"))  #: kinds that hold none
MOST = 14
NEAR = 40  #: characters on each side of a digit or @ that are looked at
_TOKEN = re.compile(r"(?=[^\W\d_]*[0-9])(?=[0-9]*[^\W\d_])[^\W_]{12,}|[^\W\d_]+|[0-9]+|\s+|.", re.S)
_MARK = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PIECE, LEAD = 50_000, 200  #: a longer stretch is cut after so many characters; features look back so far at most
_CUT = re.compile(r"(?<=[^\W\d_])\s+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _admits(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in found.split("."))
    digits = re.sub(r"[^0-9]", "", found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, in linear time: each run of characters of a local part before an @ is looked at once."""
    local, at, seen = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > seen and text[begin - 1] in local:
            begin -= 1
        m = BASE["email"].match(text, begin) if begin < at else None
        if m:
            yield m.span()
            seen = m.end()
        else:
            seen = at + 1
        at = text.find("@", seen)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, in linear time: a chain of numbers between single dots holds one for each four numbers in turn."""
    for chain in _CHAIN.finditer(text):
        parts = list(_NUMBER.finditer(text, *chain.span()))
        for k in range(0, len(parts) - 3, 4):
            yield parts[k].start(), parts[k + 3].end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text) if _admits("ip", text[a:b])]
        for kind in ("card", "phone"):
            if kind == "phone" and "+" not in text:
                continue
            out += [(kind, *m.span()) for m in BASE[kind].finditer(text) if _admits(kind, m[0])]
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @ that touch none of their neighbours; marks less than NEAR apart share one."""
    start = stop = -1
    for m in _MARK.finditer(text):
        if m.start() < stop:
            stop = max(stop, min(len(text), m.end() + NEAR))
            continue
        if start >= 0:
            yield start, stop
        start, stop = max(0, stop, m.start() - NEAR), min(len(text), m.end() + NEAR)
    if start >= 0:
        yield start, stop


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of each token: h a long run of letters and digits, a letters, 9 digits, white space, or the mark itself."""
    out = []
    for m in _TOKEN.finditer(text):
        c, n = m[0][0], m.end() - m.start()
        mixed = n >= 12 and _DIGIT.search(m[0]) and not m[0].isdigit()
        out.append((m.start(), m.end(), "h" if mixed else "9" if "0" <= c <= "9" else " " if c.isspace() else "a" if c.isalpha() else c))
    return out


@lru_cache(200_000)
def inner_features(span: str, shape: str) -> tuple[str, ...]:
    """What a whole span shows on its own."""
    digits = re.sub(r"[^0-9]", "", span)
    n, d = len(span), len(digits)
    short = re.sub(r"(..?)\1+", r"\1+", shape)
    out = [f"shape {short}", f"digits {min(d, 20)}", f"length {min(n, 40) // 4}", f"first {shape[0]} last {shape[-1]}", f"parts {min(len(shape), 12)}"]
    if d >= 12 and luhn(digits):
        out.append("checksum")
    if "@" in span:
        out.append(f"at {min(span.count('@'), 2)} dots {min(span.partition('@')[2].count('.'), 2)}")
    if shape.count(".") == 3 and d + 3 == n:
        out.append("four small" if all(int(p or 999) <= 255 for p in span.split(".") if len(p) < 5) else "four large")
    if n >= 16 and re.fullmatch(r"[0-9a-fA-F]+", span):
        out.append("hex" if re.search(r"[a-f]", span, re.I) else "long number")
    if n >= 16 and re.fullmatch(r"[A-Za-z0-9_\-]+", span) and re.search(r"[A-Za-z]", span) and d:
        out.append("mixed")
    return tuple(out)


def pieces(text: str, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(lead, start, end) of parts of a stretch: a cut is white space after a letter, which no candidate segment holds."""
    at = low
    while high - at > PIECE and (m := _CUT.search(text, at + PIECE, high)):
        yield max(low, at - LEAD), at, m.end()
        at = m.end()
    yield max(low, at - LEAD), at, high


def candidates(text: str, toks: list[tuple[int, int, str]]) -> list[list[tuple[int, tuple[str, ...]]]]:
    """For each end, the segments (first token, features) that may be more than outside."""
    out: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in range(len(toks) + 1)]
    marks = [0]
    for t in toks:
        marks.append(marks[-1] + (t[2] in ("9", "@", "h")))
    words = [text[a:b].lower() if c == "a" else c for a, b, c in toks]
    for i, (a, _, c) in enumerate(toks):
        if c not in "a9h+(":
            continue
        before = next((words[k] for k in range(i - 1, max(-1, i - 6), -1) if words[k] not in ' "\'=:'), "")
        sign = words[i - 1] if i else "^"
        for j in range(i + 1, min(len(toks), i + MOST) + 1):
            b, last = toks[j - 1][1], toks[j - 1][2]
            if last == "\n":
                break
            if last not in "a9h" or marks[j] == marks[i]:
                continue
            shape = "".join(t[2] for t in toks[i:j])
            if "  " in shape or (" " in shape and ("a" in shape or "h" in shape)):  # words apart belong to no kind
                continue
            follows = words[j] if j < len(toks) else "$"
            joined = f"joined {sign if sign in 'a9@.' else '-'} {follows if follows in 'a9@' else '-'}"
            sides = (f"before {before[:12]}", f"sign {sign[:1]}", f"after {follows[:1]}", joined)
            if " " in shape:
                sides += (BLANK,)
            out[j].append((i, inner_features(text[a:b], shape) + sides))
    return out


class Model:
    """Weights by (label, feature) and by (label, label)."""

    def __init__(self) -> None:
        self.w: dict[tuple[int, str], float] = {}
        self.pair = [[0.0] * len(LABELS) for _ in LABELS]
        self.bias = [0.0] + [-2.0] * len(KINDS)

    def segment_scores(self, features: tuple[str, ...]) -> list[float]:
        get = self.w.get
        blank = features[-1] == BLANK
        return [-math.inf if blank and y in WHOLE else self.bias[y] + sum(get((y, f), 0.0) for f in features) for y in range(1, len(LABELS))]

    def best(self, found: list[list[tuple[int, tuple[str, ...]]]]) -> list[tuple[int, int, int]]:
        """(first, end, label) of the segments of the best segmentation that are not outside."""
        n, size = len(found) - 1, len(LABELS)
        score = [[0.0] * size]
        back: list[list[tuple[int, int]]] = [[(0, 0)] * size]
        for j in range(1, n + 1):
            prev = score[j - 1]
            k = max(range(size), key=lambda x: prev[x] + self.pair[x][0])
            row, from_ = [prev[k] + self.pair[k][0]] + [-math.inf] * (size - 1), [(j - 1, k)] + [(0, 0)] * (size - 1)
            for i, features in found[j]:
                prev = score[i]
                for y, s in enumerate(self.segment_scores(features), 1):
                    k = max(range(size), key=lambda x: prev[x] + self.pair[x][y])
                    if (v := s + prev[k] + self.pair[k][y]) > row[y]:
                        row[y], from_[y] = v, (i, k)
            score.append(row)
            back.append(from_)
        out, j = [], n
        y = max(range(size), key=lambda x: score[n][x])
        while j > 0:
            i, k = back[j][y]
            if y:
                out.append((i, j, y))
            j, y = i, k
        return out[::-1]

    def learn(self, found: list[list[tuple[int, tuple[str, ...]]]], truth: dict[tuple[int, int], int], rate: float) -> None:
        """One step up the gradient of the log likelihood of a segmentation: its features less those expected."""
        n, size = len(found) - 1, len(LABELS)
        scores = [[(i, f, self.segment_scores(f)) for i, f in ends] for ends in found]
        ahead = [[0.0] + [-math.inf] * (size - 1)]
        for j in range(1, n + 1):
            row = [[ahead[j - 1][x] + self.pair[x][0] for x in range(size)]] + [[] for _ in KINDS]
            for i, _, s in scores[j]:
                for y in range(1, size):
                    row[y] += [ahead[i][x] + self.pair[x][y] + s[y - 1] for x in range(size)]
            ahead.append([_logsum(r) for r in row])
        total = _logsum(ahead[n])
        behind = [[-math.inf] * size for _ in range(n)] + [[0.0] * size]
        starts: list[list[tuple[int, tuple[str, ...], list[float]]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, f, s in scores[j]:
                starts[i].append((j, f, s))
        for i in range(n - 1, -1, -1):
            for x in range(size):
                behind[i][x] = _logsum([self.pair[x][0] + behind[i + 1][0]] + [self.pair[x][y] + s[y - 1] + behind[j][y] for j, _, s in starts[i] for y in range(1, size)])
        step: dict[tuple[int, str], float] = {}
        pair = [[0.0] * size for _ in LABELS]
        for i in range(n):
            for x in range(size):
                a = ahead[i][x]
                if a == -math.inf:
                    continue
                pair[x][0] -= math.exp(min(0.0, a + self.pair[x][0] + behind[i + 1][0] - total))
                for j, f, s in starts[i]:
                    for y in range(1, size):
                        p = math.exp(min(0.0, a + self.pair[x][y] + s[y - 1] + behind[j][y] - total))
                        if p > 1e-6:
                            pair[x][y] -= p
                            for g in f:
                                step[y, g] = step.get((y, g), 0.0) - p
                            self.bias[y] -= rate * p
        j, x = 0, 0
        byspan = {(i, e): f for i in range(n) for e, f, _ in starts[i]}
        while j < n:
            e, y = next(((e, y) for (i, e), y in truth.items() if i == j and (i, e) in byspan), (j + 1, 0))
            pair[x][y] += 1
            if y:
                self.bias[y] += rate
                for g in byspan[j, e]:
                    step[y, g] = step.get((y, g), 0.0) + 1
            j, x = e, y
        for k, v in step.items():
            self.w[k] = self.w.get(k, 0.0) * (1 - 1e-4) + rate * v
        for a in range(size):
            for b in range(size):
                self.pair[a][b] += rate * pair[a][b]


def _logsum(xs: list[float]) -> float:
    m = max(xs, default=-math.inf)
    return m if m == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))


def example(draw: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A short text with personal data or look-alikes, and the spans in it."""
    word = lambda: "".join(draw.choice(["er", "th", "ou", "la", "de", "ing", "mi", "ó", "ü", "ê"]) for _ in range(draw.randint(1, 4)))
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    capital = lambda n: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        d = draw.choice("3456") + digits(draw.choice([14, 14, 14, 13]))
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if draw.random() < 0.6 else draw.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return draw.choice([f"+{draw.randint(1, 49)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{draw.randint(1, 49)} {a} {b} {c}"])

    name = f"{word()}{draw.choice(['.', '', '_'])}{draw.randint(1, 99)}"
    made = {
        "email": lambda: f"{name}@{word()}{draw.choice(['', str(draw.randint(1, 9))])}.{draw.choice(['example.com', 'org', 'net'])}",
        "ip": lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
        "secret": lambda: draw.choice([hexes(18), hexes(32), hexes(36), hexes(40), "sk" + draw.choice("-_") + hexes(24), "AK" + capital(18)]),
    }
    fakes = [lambda: digits(draw.randint(1, 8)), lambda: digits(16), lambda: f"{digits(2)}.{digits(2)}", lambda: f"{draw.randint(1900, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(2)}.{digits(3)}", lambda: word() + digits(2), lambda: word() + word() + word() + word() + digits(1), lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)},{digits(3)}"]
    out, spans = "", []
    for _ in range(draw.randint(1, 3)):
        out += " ".join(word() for _ in range(draw.randint(1, 4))) + " "
        if draw.random() < 0.7:
            kind = draw.choice(KINDS)
            text = made[kind]()
            pre = ""
            if kind == "secret":
                pre = draw.choice(["token = \"", "key = \"", "secret: ", "password=", "api_key = '", ""])
            spans.append((kind, len(out) + len(pre), len(out) + len(pre) + len(text)))
            out += pre + text + ("\"" if pre.endswith("\"") else "'" if pre.endswith("'") else "") + draw.choice([" ", " ", ". ", ", "])
        else:
            out += draw.choice(fakes)() + draw.choice([" ", ". "])
    return out + word(), spans


def trained(examples: int = 500, rounds: int = 4, seed: int = 11) -> Model:
    draw, model = random.Random(seed), Model()
    rows = []
    for _ in range(examples):
        text, spans = example(draw)
        toks = tokens(text)
        first, last = {t[0]: i for i, t in enumerate(toks)}, {t[1]: i + 1 for i, t in enumerate(toks)}
        rows.append((candidates(text, toks), {(first[a], last[b]): LABELS.index(k) for k, a, b in spans if a in first and b in last}))
    for r in range(rounds):
        draw.shuffle(rows)
        for found, truth in rows:
            model.learn(found, truth, 0.2 / (1 + r))
    return model


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """The model's spans that overlap no base span."""
    out = []
    for low, high in windows(text):
        for lead, start, end in pieces(text, low, high):
            part = text[lead:end]
            toks = tokens(part)
            for i, j, y in model.best(candidates(part, toks)):
                a, b = lead + toks[i][0], lead + toks[j - 1][1]
                if a >= start:  # what the lead holds belongs to the piece before
                    out.append((LABELS[y], a, b))
    if base and out:
        taken = sorted((a, b) for _, a, b in base)
        tops = list(itertools.accumulate((b for _, b in taken), max))
        starts = [a for a, _ in taken]
        out = [(k, a, b) for k, a, b in out if (p := bisect.bisect_left(starts, b)) == 0 or tops[p - 1] <= a]
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret of each row; counts of the first four are of base spans."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or trained())
    rows = docs.select(id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "n_secret"]
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out: list[tuple] = []
                for text in b.column(1).to_pylist():
                    if not text or not _MARK.search(text):
                        out.append((0, 0, 0, 0, none, "", 0, 0))
                        continue
                    base = base_spans(text)
                    more = added_spans(text, base, sent.value)
                    counts = [sum(s[0] == k for s in base) for k in BASE]
                    out.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), sum(s[0] == "secret" for s in more)))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
                cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long")
