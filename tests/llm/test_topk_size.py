"""Blocks of queries and candidates meet without a broadcast, in numbers as narrow as the vectors allow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk
from lodestone.llm.shared import written


@pytest.mark.parametrize("size,kind", [(1, "tinyint"), (100, "smallint"), (3e4, "int")])
def test_blocks_are_not_broadcast(spark, monkeypatch, size, kind):
    """All pairs of blocks were joined to the candidates by a broadcast, as Spark took them for as small as the queries' file."""
    tables = []

    def noted(df, tag):
        tables.append((tag, df))
        return written(df, tag)

    monkeypatch.setattr(topk, "written", noted)
    e = np.random.default_rng(11).uniform(-size, size, (120, 5))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>")
    top = topk.top_k(v, F.col("vec_id") % 20 == 0, 7, query_rows=3, candidate_rows=25)
    got = sorted(map(tuple, top.collect()))
    whole = np.floor(64 * e).astype(np.int64)
    scores = whole @ whole.T
    best = {q: sorted((-scores[q, i], i) for i in range(120) if i != q)[:7] for q in range(0, 120, 20)}
    assert got == [(q, n, i, -s) for q in best for n, (s, i) in enumerate(best[q], 1)]
    met = [df._jdf.queryExecution().executedPlan().toString() for tag, df in [*tables, ("topk-bounds", top)] if tag == "topk-bounds"]
    assert len(met) > 1 and all("Broadcast" not in p and "MapInArrow" in p for p in met)
    assert dict(dict(tables)["topk-candidates"].dtypes)["c_data"] == f"array<{kind}>"
