"""Repeated byte strings against all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import queries, suffix_index

DOCS = "doc_id long, text string, d1 int, spans int, batch int"


def brute(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha256 of what is kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(frame):
    return sorted(((r["doc_id"], r["n_bytes"], sum(x["to"] - x["from"] for x in r["runs"]), len(r["runs"]), hashlib.sha256(r["kept"]).hexdigest()) for r in frame.collect()), key=str)


def corpus():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghä ") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)] + [prose(36)]
    texts = [prose(draw.choice([5, 40, 120])) for _ in range(40)]
    for k in range(40):
        s = draw.choice(shared)
        cut = draw.randint(0, 40)
        texts.append(prose(draw.randint(0, 30)) + s[cut : len(s) - draw.randint(0, 40)] + prose(draw.randint(0, 30)))
    texts += [shared[0], shared[0], shared[1][:200], shared[1][:199], shared[1][1:201], "x" * 199, "x" * 150, "y" * 201, "z" * 200, "ab" * 300, "", None, prose(300) * 2]
    near = prose(200)
    texts += [near[:k] + "#" + near[k + 1 :] for k in (3, 250, 251, 600, 900)]
    return texts


@pytest.mark.parametrize("options", [{}, {"batches": 3, "crowd": 1}, {"batches": 1}])
def test_repeats_equal_all_windows(spark, options):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], DOCS)
    want = sorted(((i, *w) for i, w in enumerate(brute(texts))), key=str)
    assert sum(w[2] > 0 for w in want) > 40 and sum(w[2] == 0 for w in want) > 30
    assert rows_of(suffix_index.without_repeats(frame, **options)) == want


def test_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "BLOCK", 500)
    draw = random.Random(6)
    long = "".join(draw.choice("abcd") for _ in range(4000))
    texts = [long[:3000], long[1000:], "q" * 900, long[1500:1720]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    whole = suffix_index.anchors(data, np.full(len(data), len(data)), 200, len(data))
    assert whole["windows"].sum() == len(data) - 199 and len(whole["key"]) < len(data) / 20 + 900
    frame = spark.createDataFrame([(i % 3 if i else None, t, 1, 2, 3) for i, t in enumerate(texts)] + [(1, texts[1], 1, 2, 3)], DOCS)
    ids = [None, 1, 2, 0, 1]
    assert rows_of(suffix_index.without_repeats(frame)) == sorted(((i, *w) for i, w in zip(ids, brute([*texts, texts[1]]), strict=True)), key=str)


def test_empty_table_and_lengths(spark):
    assert suffix_index.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="length"):
        suffix_index.without_repeats(spark.createDataFrame([], DOCS), length=50)


def test_levels_merge_geometrically(spark):
    family = suffix_index.Family()
    sizes = []
    for k in range(6):
        family.add(spark.createDataFrame([(k % 3, k, 1), (100 + k, 0, 1)], "key long, stretch long, n long"), str(k))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    assert sorted(r["key"] for r in family.live_keys().collect()) == [0, 1, 2]
    assert family.entries().count() == 12


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = con.execute(queries.oracle_sql()["op11_suffix_dedup"]).df()[cols]
    got = queries.op11_suffix_dedup(spark, sf).toPandas()[cols]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
