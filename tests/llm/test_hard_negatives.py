"""Results against all products, bounds against all pairs, what the filter spares, and vectors that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import hard_negatives as hn

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def brute(rows, every=5, positives=5, negatives=3):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, l, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    for a, (label, av) in anchors.items():
        scored = [(-min(max(sum(x * y for x, y in zip(av, v)), LEAST), MOST), i, l) for i, l, v in good if i != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted((s, i) for s, i, l in scored if l != label and 50 * -ps <= 100 * -s <= 95 * -ps)[:negatives]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, every=5, kind="float"):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, score int, angles string").repartition(4)
    return sorted(tuple(r) for r in hn.hard_negatives(table, F.col("vec_id") % every == 0).collect())


def clustered(rng, clusters, each, width, spread):
    out = []
    for c in range(clusters):
        centre = [rng.gauss(0, 1) for _ in range(width)]
        out += [([float(np.float32(x + rng.gauss(0, spread))) for x in centre], c % 7) for _ in range(each)]
    rng.shuffle(out)
    return [(i, v, l) for i, (v, l) in enumerate(out)]


@pytest.mark.parametrize("window,cell,anchors,spread", [(64, 512, 4_096, 1.0), (4, 30, 7, 0.3), (1, 50, 20, 0.8)])
def test_against_all_products(spark, monkeypatch, window, cell, anchors, spread):
    monkeypatch.setattr(hn, "WINDOW", window)
    monkeypatch.setattr(hn, "CELL_ROWS", cell)
    monkeypatch.setattr(hn, "CELL_ROWS_LEAST", cell)
    monkeypatch.setattr(hn, "CELL_ANCHORS", anchors)
    monkeypatch.setattr(hn, "SAMPLE", 30)
    monkeypatch.setattr(hn, "PENDING", 50)
    rows = clustered(random.Random(window), 12, 14, 6, spread)
    rows += [(1_000 + i, [0.5, -0.25, 0.0, 1.0, -1.0, 0.125], i % 3) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def made(rng, n, width, scale=1.0):
    values = np.floor(rng.normal(size=(n, width)) * 256 * scale)
    refs = hn.directions(values[:9], 4)
    return hn.Vectors(np.arange(n), rng.integers(0, 3, n), values, hn.norms_of(values), hn.angles_to(values, refs))


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e4])
def test_every_score_lies_within_its_window_bounds(scale):
    rng = np.random.default_rng(5)
    rows = made(rng, 150, 5, scale)
    rows.values[7] = 0
    rows.norms[7], rows.angles[7] = 0, 0
    windows = hn.Windows(rows, 8)
    low, high = windows.bounds(rows)
    for k in range(len(windows.starts)):
        found = hn.scores(rows, windows.window(k))
        assert (found <= high[:, k, None]).all() and (found >= low[:, k, None]).all()


def test_windows_of_clusters_are_spared():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 32))
    values = np.floor(256 * (np.repeat(centres, 256, axis=0) + 0.1 * rng.normal(size=(4096, 32))))
    refs = hn.directions(values[rng.permutation(4096)[:512]])
    rows = hn.Vectors(np.arange(4096), np.arange(4096) // 256, values, hn.norms_of(values), hn.angles_to(values, refs))
    anchors, scored = rows.take(slice(0, 4096, 50)), []
    at, score, ids = hn.best_positives(anchors, rows, counter=scored)
    assert sum(scored) < 0.2 * len(anchors.ids) * 4096
    own = np.zeros((len(anchors.ids), 5), np.int64)
    own[at, np.arange(len(at)) - np.searchsorted(at, at)] = score
    scored.clear()
    hn.best_negatives(anchors, own, own != 0, rows, counter=scored)
    assert sum(scored) < 0.5 * len(anchors.ids) * 4096


def test_score_range():
    p = np.array([0, 1, 2, 199, 200, -7, MOST, 10**18 + 3], np.int64)
    least, most = hn.score_range(p)
    assert least.tolist() == [-(-50 * int(x) // 100) for x in p]
    assert most.tolist() == [95 * int(x) // 100 for x in p]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (5, None, 1), (10, [1.0, None], 1), (15, [nan, 1.0], 1), (20, [inf, 1.0], 2), (1, [1.0], 1), (2, [], 1), (None, [1.0, 1.0], 1), (3, [0.5, 0.5], None), (25, [], 2)]
    rows += [(4, [0.5, 0.75], 2), (6, [0.0, 0.0], 3), (30, [0.0], 1)]
    assert run(spark, rows) == brute(rows)
    repeated = [(0, [1.0], 1), (0, [1.0], 1), (1, [2.0], 1), (1, [2.0], 1), (2, [1.5], 2), (2, [1.5], 2)]
    assert run(spark, repeated) == brute(repeated)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hn.hard_negatives(empty, F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("kind,large", [("float", 2.0**40), ("float", 1e30), ("double", 1e300)])
def test_large_components(spark, kind, large):
    rows = [(i, [float(1 + i % 3), 1.0 - i % 4, 0.25 * i], i % 3) for i in range(40)]
    rows += [(40 + i, [float(np.float32(large)) if kind == "float" else large, float(i), 1.0], i % 2) for i in range(6)] + [(46, [-large if kind == "double" else float(np.float32(-large)), 1.0, 2.0], 0)]
    assert run(spark, rows, kind=kind) == brute(rows)
