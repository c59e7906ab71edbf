"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

import tessella.llm.topk as topk
from tessella.llm.topk import nra_block, top_k


def brute(rows, k=5, scale=256, divisor=50):
    whole = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % divisor == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("block", (4096, 37))
def test_random_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=8) / 3).round(1).tolist()) for i in range(400)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "vec_id long, embedding array<float>, score string")
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    assert found(top_k(df)) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (50, None), (100, [-1.0, 0.5]), (150, [1.0, 1.0, 1.0]), (200, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(top_k(df)) == [x for x in brute(rows) if x[0] != 200]
    assert found(top_k(df.limit(0))) == []


def test_bounds_are_exact_for_any_size_of_numbers():
    r = np.random.default_rng(3)
    for scale in (10, 10**5, 10**8):
        x, q = r.integers(-scale, scale, (500, 6)), r.integers(-scale, scale, (20, 6))
        ids, q_ids = np.arange(500), np.arange(20) * 10
        qs, cs, score = nra_block(q_ids, q, ids, x, 5)
        for i in range(20):
            s = x @ q[i]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q_ids[i]][:5]
            assert cs[qs == i].tolist() == order and score[qs == i].tolist() == s[order].tolist()
