"""Exact results against all products, with ties, and vectors that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import topk_search


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in good if i % 4 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int, rank int").repartition(4)
    return sorted(tuple(r) for r in topk_search.top_k(table, F.col("vec_id") % 4 == 0).collect())


@pytest.mark.parametrize("block,docs,queries", [(64, 512, 8_192), (3, 20, 7)])
def test_best_ten_of_all(spark, monkeypatch, block, docs, queries):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "CELL_DOCS", docs)
    monkeypatch.setattr(topk_search, "CELL_DOCS_LEAST", docs)
    monkeypatch.setattr(topk_search, "CELL_QUERIES", queries)
    monkeypatch.setattr(topk_search, "SAMPLE", 40)
    rng = random.Random(block)
    vectors = [[float(np.float32(rng.gauss(0, 1))) for _ in range(6)] for _ in range(150)] + [[0.5, -0.25, 0.0, 1.0, -1.0, 0.125]] * 60
    rows = list(enumerate(vectors))
    assert run(spark, [(*r, 0, 0) for r in rows]) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (4, None), (8, [1.0, None]), (12, [float("nan"), 1.0]), (16, [float("inf"), 1.0]), (1, [1.0]), (2, []), (None, [1.0, 1.0]), (3, [-1.0, 0.5]), (20, [])]
    assert run(spark, [(*r, 0, 0) for r in rows]) == brute(rows)
    repeated = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]
    assert run(spark, [(*r, 0, 0) for r in repeated]) == [(0, 1, 1, 2 * 1024**2), (0, 2, 1, 2 * 1024**2)]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_search.top_k(empty, F.col("vec_id") % 4 == 0).count() == 0


def test_large_values_stay_exact(spark):
    rows = [(i, [2.0**17 + i, -(2.0**18) + 3 * i, 1.0]) for i in range(12)]
    assert run(spark, [(*r, 0, 0) for r in rows]) == brute(rows)


@pytest.mark.parametrize("kind,large", [("float", 1e30), ("double", 1e300), ("float", 2.0**45)])
def test_finite_values_of_any_size(spark, kind, large):
    rows = [(i, [float(i % 5), 2.0 - i % 3, 0.5]) for i in range(30)] + [(30 + i, [(-1) ** i * large, float(i), 1.0]) for i in range(8)]
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    whole = {i: [math.floor(1024.0 * x) for x in v] for i, v in rows}
    want = []
    for q in sorted(i for i in whole if i % 4 == 0):
        clipped = lambda d: min(max(sum(x * y for x, y in zip(whole[q], whole[d])), -(1 << 63)), (1 << 63) - 1)  # noqa: B023, E731
        want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted((-clipped(d), d) for d in whole if d != q)[:10])]
    assert sorted(tuple(r) for r in topk_search.top_k(table, F.col("vec_id") % 4 == 0).collect()) == want
