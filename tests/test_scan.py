"""Two-level scans against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions.scan import nearest_rank, number_rows, scan


def rows(seed=1):
    rnd = random.Random(seed)
    return [(k, i, rnd.choice([1, -1, 0]), rnd.choice([None, None, i])) for k in "ab" for i in range(1, 60)]


@pytest.mark.parametrize("wide", [False, True])
def test_running_values(spark, wide):
    data = rows()
    df = spark.createDataFrame(data, "k string, i bigint, d int, v bigint")
    got = scan(
        df, ["k"], "i", sums={"s": F.col("d")}, lows={"low": "s"}, lasts={"last": F.col("v")}, prevs={"prev": F.col("v")},
        peaks={"peak": F.col("d")}, wide=wide, chunk=7,
    ).collect()
    found = {(r.k, r.i): (r.s, r.low, r["last"], r.prev, r.peak) for r in got}
    for k in "ab":
        s, low, last, peak = 0, 0, None, None
        for kk, i, d, v in data:
            if kk != k:
                continue
            low, prev = min(low, s), last
            s += d
            last = v if v is not None else last
            peak = d if peak is None else max(peak, d)
            assert found[k, i] == (s, low, last, prev, peak)


@pytest.mark.parametrize("wide", [False, True])
def test_numbering(spark, wide):
    data = [("a" if i % 3 else "b", i * 7 % 50, i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, id int")
    got = number_rows(df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], "n", wide).collect()
    for k in "ab":
        want = [r[2] for r in sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2]))]
        assert [r.id for r in sorted((x for x in got if x.k == k), key=lambda x: x.n)] == want


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("n", [1, 2, 10, 11, 31])
def test_nearest_rank(spark, n, wide):
    rnd = random.Random(n)
    values = [rnd.randrange(0, 9000) for _ in range(n)]
    df = spark.createDataFrame([("x", v) for v in values], "k string, v bigint")
    row = nearest_rank(df, ["k"], "v", {"p50": 50, "p95": 95}, wide).first()
    ordered = sorted(values)
    assert (row.p50, row.p95) == tuple(ordered[int(round(p / 100.0 * (n - 1)))] for p in (50, 95))
