"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import release, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the smallest node reachable.

    Each round joins every node's smallest neighbour to its edges: first the
    larger neighbours are hung onto it (large star), then the smaller ones
    (small star).  Rounds grow with the logarithm of the longest path.  Edges
    of one node may be very many; they are counted before the shuffle and
    joined with a single row.  Null ends and loops are ignored.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(lower, F.col("a") == F.col("u"))
        hung = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select(F.col("u").alias("a"), F.col("m").alias("b")))
        older, now = now, stored(hung.filter("a <> b").distinct(), purpose)
        release(older.sparkSession, older)
        before, state = state, _state(now)
        if state == before:
            break
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
