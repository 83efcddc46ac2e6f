"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are whole numbers.  Documents lie in groups of ranges ("blocks"); each
block keeps the largest and smallest value of every component.  For a query,
the sum over components of what the block could contribute at most bounds every
score inside it.  Blocks are visited from the highest bound down and scored
through their forward index (a dense matrix); a query stops when no bound left
can reach its k-th score.

Queries and documents meet in cells of a bounded number of each, so neither
side is ever held whole.  A bounded sample of documents gives each query a first
lower bound of its k-th score and the reference points that order documents
inside a cell; it affects speed only, every document is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import short_batches, spark_hash_partitions
from faultline.llm.vectors import EXACT, complete, exact_products, whole_numbers

K = 10
SCALE = 1024
# documents of one block, of one cell at most and at least, queries of one cell at most
BLOCK = 64
CELL_DOCS = 16_384
CELL_DOCS_LEAST = 512
CELL_QUERIES = 8_192
# rows of the sample
SAMPLE = 2_048
PIVOTS = 32


def _bounds(queries: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """Highest score each query can have in each block: exact where float64 is, else widened for rounding."""
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = positive @ top.T + negative @ bottom.T
        size = positive @ np.abs(top).T - negative @ np.abs(bottom).T
        bounds = np.where(size < EXACT, bounds, bounds + size * 1e-9 + 1)
    return np.where(np.isnan(bounds), np.inf, bounds)


def search(
    query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int = K, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of ``ids`` for each query (its own id left out): query ids, ids, scores, in no order.

    ``floor`` is a score that the k-th best of all documents is known to reach.
    """
    # document ranges: documents nearest to the same reference point lie together
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.argmax(vectors @ pivots.T, axis=1) if len(pivots) and vectors.size else np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, near))
    ids, vectors = ids[order], vectors[order]
    starts = np.arange(0, len(ids), block)
    top, bottom = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    bounds = _bounds(queries, top, bottom)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    kth = floor.copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    active = np.arange(len(query_ids))
    for turn in range(len(starts)):
        at = visit[active, turn]
        go = np.nextafter(bounds[active, at], np.inf) >= kth[active]  # a tie may still win by a smaller id
        active, at = active[go], at[go]
        if not len(active):
            break
        by_block = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by_block])) + 1
        for part in np.split(by_block, cuts):
            lo = starts[at[part[0]]]
            own_ids, mine = ids[lo : lo + block], active[part]
            scores = exact_products(queries[mine], vectors[lo : lo + block])
            for row, q in enumerate(mine):
                line = scores[row]
                take = np.flatnonzero((line >= kth[q]) & (own_ids != query_ids[q]))
                if not len(take):
                    continue
                s, d = np.concatenate([best[q][0], line[take]]), np.concatenate([best[q][1], own_ids[take]])
                if len(s) > k:
                    keep = np.lexsort((d, ~s))[:k]
                    s, d = s[keep], d[keep]
                best[q] = (s, d)
                if len(s) >= k:
                    kth[q] = max(kth[q], s.min())
    counts = [len(b[0]) for b in best]
    none = np.zeros(0, np.int64)
    return np.repeat(query_ids, counts), np.concatenate([b[1] for b in best] or [none]), np.concatenate([b[0] for b in best] or [none])


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), the key, score: each query's ``k`` best other rows, ties to the smaller key.

    Rows whose vector is null or holds a null or non-finite component, and rows
    with a null key, take no part.  Shorter vectors count as zero beyond their
    end; empty ones score 0.  Rows repeated with one key: all are candidates of
    other queries, none of its own key's query, which is asked once.  With
    fewer than ``k`` candidates all are given; an empty table gives no rows.
    Scores beyond a long count as the nearest long, in ranking, too.
    Other columns take no part.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    rows = vectors.filter(F.col(key).isNotNull() & complete(F.col(vector))).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")
    )
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("q"), F.max(F.size("v")).alias("width")).first()
    n, asked, width = sizes["n"], sizes["q"] or 0, sizes["width"] or 0
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample_ids, sample_vectors = np.array([r["id"] for r in sample], np.int64), whole_numbers([r["v"] for r in sample], width, scale)
    shared = spark.sparkContext.broadcast((sample_ids, sample_vectors))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near_ids, near = shared.value
        for batch in batches:
            ids, scores = batch["id"].to_numpy(np.int64), exact_products(whole_numbers(list(batch["v"]), width, scale), near)
            floor = []
            for i, line in zip(ids, scores, strict=True):
                line = line[near_ids != i]
                floor.append(int(np.partition(line, -k)[-k]) if len(line) >= k else np.iinfo(np.int64).min)
            yield pd.DataFrame({"id": ids, "v": list(batch["v"]), "floor": floor})

    def cell(key_: tuple, docs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(asks):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64")
        q, d, s = search(
            asks["id"].to_numpy(np.int64), whole_numbers(list(asks["v"]), width, scale), asks["floor"].to_numpy(np.int64),
            docs["id"].to_numpy(np.int64), whole_numbers(list(docs["v"]), width, scale), shared.value[1][:PIVOTS], k,
        )
        return pd.DataFrame({"query_id": q, "id": d, "score": s})

    doc_groups = max(1, -(-n // CELL_DOCS), min(spark_hash_partitions(spark), -(-n // CELL_DOCS_LEAST)))
    query_groups = max(1, -(-asked // CELL_QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    docs = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(doc_groups)).cast("int").alias("dg"), every(query_groups).alias("qg"))
    asks = rows.filter("asks").select("id", "v").dropDuplicates(["id"]).mapInPandas(start, "id bigint, v array<double>, floor bigint")
    asks = asks.select("id", "v", "floor", F.pmod(F.xxhash64("id"), F.lit(query_groups)).cast("int").alias("qg"), every(doc_groups).alias("dg"))
    found = docs.groupBy("dg", "qg").cogroup(asks.groupBy("dg", "qg")).applyInPandas(cell, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
