import math

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import topk


def brute(rows, k):
    vecs = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vecs.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q, v in vecs:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in topk.exact_topk(df.repartition(3), F.col("vec_id") % 100 == 0, k).collect())


def test_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 37)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "TILE", 200)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(450)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (None, [1.0] * 6), (503, []), (600, [0.5])]
    rows += [rows[7], (7, [9.0] * 6), (7, [8.5] * 6), (200, [-9.0] * 6), (504, [math.inf] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows, 10)


def test_few_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert run(spark, rows) == [(0, 1, 1, 1024 * 2048)]
    assert run(spark, []) == []


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    assert run(spark, [(100, [1.0]), (7, [2.0]), (7, [1.5])]) == [(100, 1, 7, 2048 * 1024), (100, 2, 7, 1536 * 1024)]
