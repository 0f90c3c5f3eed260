"""Periodic runs against a brute-force search."""

import hashlib
import random
import re
import time
import zlib
from array import array

import numpy as np
import pytest

from lodestone.llm import queries, runs

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(x, min_length, min_periods):
    found = []
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            s = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            n = i - s + p
            if n >= max(min_length, min_periods * p) and not any(all(x[k] == x[k + q] for k in range(s, s + n - q)) for q in range(1, p)):
                found.append((s, n, p))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    """The query's row, from the definition."""
    w = [x for x in SPACE.split(text or "") if x]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w, 24, 3)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(w), len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    draw = random.Random(3)
    for _ in range(1500):
        n, k = draw.randint(0, 60), draw.choice([1, 2, 3, 5])
        x = [draw.randrange(k) for _ in range(n)]
        if n > 4 and draw.random() < 0.4:
            p = draw.randint(1, 7)
            x = [x[i % p] for i in range(n)]
            x[draw.randrange(n)] = 9
        for least in ((2, 2), (6, 3)):
            assert runs.find_runs(np.array(x, np.int64), *least) == brute(x, *least), x


@pytest.mark.parametrize("text", ["copies", "fibonacci", "growing"])
def test_time_is_linear(text):
    def made(n):
        if text == "copies":
            return ([5] * (n // 2 - 1) + [6] + [5] * (n // 2))[:n]
        if text == "growing":
            return [y for k in range(1, int((2 * n) ** 0.5)) for y in [1] * k + [2]][:n]
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    def took(n):
        x, began = array("i", made(n)), time.process_time()
        runs.lyndon(x)
        return time.process_time() - began

    assert took(160_000) < 40 * max(took(10_000), 0.01)


def test_long_words_and_ranks():
    texts = [b"a" * 3000 + b" b " + b"a" * 3001, b"", b" ", b"x\x00 x x\x00", "é  é".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum([len(t) for t in texts])
    starts, ends = runs.words_of(data, stops - np.array([len(t) for t in texts]), stops)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in re.split(rb"[\x20\x09-\x0D]+", t) if w]
    rank = runs.ranks(data, starts, ends)
    assert all((rank[i] == rank[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(5)
    rows = []
    for i in range(240):
        vocabulary = [f"w{k}" * draw.choice([1, 1, 5]) for k in range(draw.choice([1, 2, 3, 40, 400]))]
        w = [draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 5, 30, 90, 260]))]
        if draw.random() < 0.4 and w:
            p, a = draw.randint(1, 20), draw.randrange(len(w))
            w = w[:a] + (w[a : a + p] * 30)[: draw.randint(20, 100)] + w[a:]
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(w), 7))
    rows += [(500, None, 1), (501, "", 1), (502, " \n ", 1), (503, "one", 1), (504, "a b " * 12, 1), (504, "a b " * 12, 1), (505, "a b " * 11 + "a", 1), (506, "x " * 24 + "y " * 24, 1), (507, ("x " * 23 + "z ") * 3, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_words"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == sorted(r[0] for r in rows)
    want = {i: digest(i, t) for i, t, _ in rows}
    assert all(g[1:] == want[g[0]] for g in got)
    assert sum(g[2] > 0 for g in got) > 40 and any(g[2] > 1 for g in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.word_runs(empty).count() == 0
    assert runs.word_runs(runs.with_periods(spark.createDataFrame([(None, "a b " * 30)], "doc_id long, text string"))).first()["runs"][0]["period"] == 2
