"""Vector codes against plain Lloyd rounds in whole numbers of any size."""

import hashlib
import math
import random

import numpy as np

from lodestone.llm import codebooks, queries


def plain(rows, entries=256, rounds=4, parts=4, scale=1024):
    """Codes, errors and codebooks from the definition; rows of (id, vector, label)."""
    kept = [(i, [max(-(2**63), min(2**63 - 1, math.floor(scale * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = sorted(((i, v + [0] * (width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    split = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for s in split:
                taken.setdefault(near(s[p], books[p])[1], []).append(s[p])
            for j, xs in taken.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[near(s[p], books[p]) for p in range(parts)] for s in split]
    out = [(i, label, "".join(f"{j:02x}" for _, j in f), min(2**63 - 1, sum(d for d, _ in f))) for (i, _, label), f in zip(kept, found, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def run(spark, rows, entries):
    frame = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], "vec_id long, embedding array<double>, label int, entry int, error int")
    codes, books = codebooks.trained_codes(frame, entries=entries)
    got = codes.select("id", "label_at", codebooks.code(codes["entry"]).alias("code"), "error").collect()
    return codes, [(r["id"], None if r["label_at"] is None else int(r["label_at"]), r["code"], r["error"]) for r in got], books


def both(spark, rows, entries):
    codes, got, books = run(spark, rows, entries)
    want, sha = plain(rows, entries)
    assert sorted(got, key=str) == sorted(want, key=str)
    if want:
        assert books.sha256() == sha
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    if max(sums.values(), default=0) < 2**63:
        for r in codebooks.label_errors(codes).collect():
            assert r["label_error"] == sums[None if r["label_at"] is None else int(r["label_at"])]
    return books


def test_codes_equal_plain_rounds(spark):
    draw = random.Random(2)
    near = [(i, [draw.gauss(draw.choice([-1, 0, 1]), 0.2) for _ in range(8)], draw.choice([1, 1, 2, None])) for i in range(400)]
    books = both(spark, near, 20)
    assert books.scanned[0] == 1600 and books.scanned[-1] < 800  # the bounds save full scans
    ties = [(i, [draw.choice([0, 1, 2]) / 1024 for _ in range(4)], i % 3) for i in range(200)]
    both(spark, ties, 16)


def test_edges_of_codes(spark):
    draw = random.Random(3)
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (3, [inf, 1.0, 1.0, 1.0], 1), (4, [nan, 1.0, 1.0, 1.0], None), (7, [0.5, -0.5, 0.25], None), (7, [0.5, -0.5, 0.25], 2), (7, [0.1, 0.1, 0.1, 0.1, 9.0], 2), (None, [0.3] * 5, 1), (9, [], 1)]
    both(spark, rows, 256)
    both(spark, rows, 2)
    both(spark, rows[:4], 4)
    both(spark, [], 4)
    both(spark, [(1, [], None), (2, [], None)], 4)
    large = [(i, [draw.gauss(0, 1) for _ in range(4)], 0) for i in range(60)] + [(70, [1e9, 0.1, 0.1, -3e12], 0), (71, [1e9, 0.1, -0.1, 3e12], 1), (0, [1e300, 1.0, -1e300, 1.0], 2)]
    both(spark, large, 5)
    both(spark, large, 64)


def test_distances_are_exact_at_any_size():
    x = np.array([[2**24, -(2**24)], [3, 4]], np.int64)
    assert codebooks.squared(x, x).tolist() == codebooks._whole(x, x).tolist()
    wide = np.array([[2**62, -(2**62)], [3, 4]], np.int64)
    assert codebooks.squared(wide, wide)[0, 1] == (2**62 - 3) ** 2 + (2**62 + 4) ** 2


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    cols = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(queries.oracle_sql()["op12_vector_codes"]).df()[cols]
    got = queries.op12_vector_codes(spark, sf).toPandas()[cols]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
