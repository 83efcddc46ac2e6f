"""Hard negatives of anchors, by angular triangle filtering.

Vectors are whole numbers; a score is their exact inner product.  Each vector
keeps its norm and its angles to a few reference directions.  The angle between
two vectors lies between the difference and the sum of their angles to any
reference, so a run of vectors with neighbouring angles ("window") has an
interval of cosines with an anchor, and with the norms an interval of scores,
widened for rounding.  Only windows whose interval overlaps what is asked for
get integer scoring: first those that can still hold one of an anchor's best
positives, then those that can reach the score range of one of its positives.

Anchors and vectors meet in cells of a bounded number of each.  Reference
directions come from a bounded sample and affect speed only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import short_batches, spark_hash_partitions, stored
from faultline.llm.vectors import LEAST as _LEAST
from faultline.llm.vectors import MOST as _MOST
from faultline.llm.vectors import complete, exact_products, norms_of, whole_numbers

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# hundredths of the positive's score between which a negative lies
LOW, HIGH = 50, 95
REFERENCES = 16
SAMPLE = 512
# vectors of one window; vectors and anchors of one cell at most, and their numbers
WINDOW = 64
CELL_ROWS = 16_384
CELL_ROWS_LEAST = 512
CELL_ANCHORS = 4_096
CELL_NUMBERS = 1 << 21
# found scores kept before all but the best go
PENDING = 1 << 20
# widening of angles (radians) and, relative to the norms, of scores
_ANGLE, _SCORE = 1e-6, 1e-9


@dataclass
class Vectors:
    """Rows of one cell: ids, labels, whole numbers in float64, norms, angles to the references."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    def take(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.values[at], self.norms[at], self.angles[at])


def angles_to(values: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to reference directions; a zero vector's are 0."""
    most = np.abs(values).max(axis=1, initial=0.0)
    unit = values / np.where(most > 0, most, 1.0)[:, None]
    size = np.linalg.norm(unit, axis=1)
    cosine = (unit @ references.T) / np.where(size > 0, size, 1.0)[:, None]
    return np.where(size[:, None] > 0, np.arccos(np.clip(cosine, -1.0, 1.0)), 0.0)


def directions(values: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other: each next the row whose largest cosine to those before is smallest."""
    size = norms_of(values)
    rows = values[(size > 0) & np.isfinite(size)]
    rows = rows / norms_of(rows)[:, None] if len(rows) else rows
    picked: list[np.ndarray] = []
    closest = np.full(len(rows), -np.inf)
    while len(rows) and len(picked) < count:
        at = int(np.argmin(closest)) if picked else 0
        if picked and closest[at] >= 1 - 1e-9:
            break
        picked.append(rows[at])
        closest = np.maximum(closest, rows @ rows[at])
    return np.array(picked) if picked else np.zeros((0, values.shape[1]))


def scores(a: Vectors, b: Vectors) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``, those beyond a long as the nearest long."""
    return exact_products(a.values, b.values, a.norms, b.norms)


class Windows:
    """The vectors of a cell in runs of neighbouring angles, with the range of angles and norms of each run."""

    def __init__(self, rows: Vectors, size: int = WINDOW):
        references = rows.angles.shape[1]
        near = np.argmin(rows.angles, axis=1) if references else np.zeros(len(rows.ids), np.int64)
        angle = rows.angles[np.arange(len(rows.ids)), near] if references else np.zeros(len(rows.ids))
        self.rows = rows.take(np.lexsort((rows.ids, angle, near)))
        self.starts = np.arange(0, len(rows.ids), size)
        self.size = size
        reduce = lambda f, x: f.reduceat(x, self.starts, axis=0)
        self.angle_low, self.angle_high = reduce(np.minimum, self.rows.angles), reduce(np.maximum, self.rows.angles)
        self.norm_low, self.norm_high = reduce(np.minimum, self.rows.norms), reduce(np.maximum, self.rows.norms)

    def bounds(self, anchors: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score an anchor can have in each window."""
        shape = (len(anchors.ids), len(self.starts))
        least, most = np.zeros(shape), np.full(shape, np.pi)
        for r in range(anchors.angles.shape[1]):
            own, low, high = anchors.angles[:, r, None], self.angle_low[None, :, r], self.angle_high[None, :, r]
            least = np.maximum(least, np.maximum(low - own, own - high))
            # the sum of two angles, or what it leaves of the full circle
            most = np.minimum(most, np.where(own + high <= np.pi, own + high, np.where(own + low >= np.pi, 2 * np.pi - own - low, np.pi)))
        top, bottom = np.cos(np.maximum(least - _ANGLE, 0)), np.cos(np.minimum(most + _ANGLE, np.pi))
        with np.errstate(invalid="ignore", over="ignore"):
            small, large = anchors.norms[:, None] * self.norm_low[None, :], anchors.norms[:, None] * self.norm_high[None, :]
            slack = large * _SCORE + 1
            high = np.where(top >= 0, top * large, top * small) + slack
            low = np.where(bottom >= 0, bottom * small, bottom * large) - slack
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def window(self, k: int) -> Vectors:
        return self.rows.take(slice(int(self.starts[k]), int(self.starts[k]) + self.size))


class _Best:
    """The ``k`` highest scores of each of several lists, ties to the smaller id; ``floor`` is what a score must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((at, score, ids))
        self.size += len(at)
        if self.size > PENDING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        empty = np.zeros(0, np.int64)
        at, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (empty, empty, empty)
        # ~score turns the order round without overflow
        order = np.lexsort((ids, ~score, at))
        at, score, ids = at[order], score[order], ids[order]
        begins = np.searchsorted(at, at, side="left")
        place = np.arange(len(at)) - begins
        keep = place < self.k
        last = place == self.k - 1
        self.floor[at[last]] = np.maximum(self.floor[at[last]], score[last])
        at, score, ids = at[keep], score[keep], ids[keep]
        self.parts, self.size = [(at, score, ids)], len(at)
        return at, score, ids


def _at_least(bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a bound (float) can reach a floor (long); the floor is rounded down to a float first."""
    return bound >= np.nextafter(floor.astype(np.float64), -np.inf)


def best_positives(anchors: Vectors, rows: Vectors, k: int = POSITIVES, counter: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, score, id) of the ``k`` best other rows of the anchor's label in this cell."""
    best = _Best(np.full(len(anchors.ids), _LEAST, np.int64), k)
    windows = Windows(rows)
    _, high = windows.bounds(anchors)
    # from the windows with the highest bounds down, all anchors together
    for turn, w in enumerate(np.argsort(-high.max(axis=0), kind="stable")):
        part = windows.window(int(w))
        go = np.flatnonzero(_at_least(high[:, w], best.floor) & np.isin(anchors.labels, part.labels))
        if not len(go):
            continue
        own = anchors.take(go)
        found = scores(own, part)
        if counter is not None:
            counter.append(found.size)
        good = (own.labels[:, None] == part.labels[None, :]) & (own.ids[:, None] != part.ids[None, :]) & (found >= best.floor[go][:, None])
        i, j = np.nonzero(good)
        best.add(go[i], found[i, j], part.ids[j])
        if turn % 8 == 0:
            best.settle()
    return best.settle()


def score_range(positive: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with low * positive <= 100 * s <= high * positive; no value is multiplied beyond a long."""
    share = lambda p, x: p // 100 * x + p % 100 * x // 100
    return -share(-positive, low) if len(positive) else positive, share(positive, high)


def best_negatives(
    anchors: Vectors, positive_scores: np.ndarray, given: np.ndarray, rows: Vectors, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, counter: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, score, id) of the ``k`` best rows of other labels in each positive's score range in this cell.

    ``positive_scores`` has a row per anchor; ``given`` tells which exist; list
    number = place of the anchor * positives + place of the positive.
    """
    count = positive_scores.shape[1]
    least, most = score_range(positive_scores.reshape(-1), low, high)
    asked = given.reshape(-1) & (least <= most)
    best = _Best(np.where(asked, least, _MOST), k)
    windows = Windows(rows)
    low_bound, high_bound = windows.bounds(anchors)
    most, asked = most.reshape(-1, count), asked.reshape(-1, count)
    for turn, w in enumerate(np.argsort(-high_bound.max(axis=0), kind="stable")):
        floor = best.floor.reshape(-1, count)
        overlap = asked & _at_least(high_bound[:, w, None], floor) & (low_bound[:, w, None] <= np.nextafter(most.astype(np.float64), np.inf))
        go = np.flatnonzero(overlap.any(axis=1))
        if not len(go):
            continue
        part, own = windows.window(int(w)), anchors.take(go)
        found = scores(own, part)
        if counter is not None:
            counter.append(found.size)
        other = own.labels[:, None] != part.labels[None, :]
        for p in range(count):
            good = other & overlap[go, p, None] & (found >= floor[go, p, None]) & (found <= most[go, p, None])
            i, j = np.nonzero(good)
            best.add(go[i] * count + p, found[i, j], part.ids[j])
        if turn % 8 == 0:
            best.settle()
    return best.settle()


def _vectors(frame: pd.DataFrame, width: int, scale: int, references: int) -> Vectors:
    values = whole_numbers(list(frame["v"]), width, scale)
    angles = np.array(frame["angles"].tolist(), dtype=np.float64).reshape(len(frame), references)
    return Vectors(frame["id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), values, frame["norm"].to_numpy(np.float64), angles)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    An anchor's positives are the ``positives`` best other rows of its label;
    for each, the ``negatives`` best rows of other labels whose score lies
    between ``low`` and ``high`` hundredths of the positive's.  Ties go to the
    smaller key; fewer rows are returned where fewer exist.

    Rows with a null key or label, a null vector, or a null or non-finite
    component take no part.  Shorter vectors count as zero beyond their end,
    empty ones score 0.  Scores beyond a long count as the nearest long, in
    ranking, too.  Rows repeated with one key are candidates each, none of them
    for the anchor of that key, which asks once (by its smallest label and
    vector).  An empty table gives no rows; other columns take no part.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    label = F.col(label) if isinstance(label, str) else label
    usable = F.col(key).isNotNull() & label.isNotNull() & complete(F.col(vector))
    plain = vectors.filter(usable).select(
        F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    sizes = plain.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = sizes["n"], sizes["width"] or 0
    sample = plain.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    references = directions(whole_numbers([r["v"] for r in sample], width, scale))
    shared, count = spark.sparkContext.broadcast(references), len(references)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = whole_numbers(list(batch["v"]), width, scale)
            yield batch.assign(norm=norms_of(values), angles=list(angles_to(values, shared.value)))

    measured = plain.mapInPandas(measure, "id bigint, label bigint, v array<double>, asks boolean, norm double, angles array<double>")
    rows = stored(measured, "negatives-vectors")
    askers = rows.filter("asks").groupBy("id").agg(F.min(F.struct("label", "v", "norm", "angles")).alias("r")).select("id", "r.*")
    askers = stored(askers, "negatives-anchors")
    asked = askers.count()

    at_most = max(1, CELL_NUMBERS // max(1, width))
    cell_rows, cell_anchors = max(1, min(CELL_ROWS, at_most)), max(1, min(CELL_ANCHORS, at_most))
    row_groups = max(1, -(-n // cell_rows), min(spark_hash_partitions(spark), -(-n // CELL_ROWS_LEAST)))
    anchor_groups = max(1, -(-asked // cell_anchors))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    field = rows.select("id", "label", "v", "norm", "angles", F.pmod(F.xxhash64("id", "v"), F.lit(row_groups)).cast("int").alias("rg"), every(anchor_groups).alias("ag"))
    field = field.groupBy("rg", "ag")

    def in_cells(anchors: DataFrame):
        placed = anchors.withColumn("ag", F.pmod(F.xxhash64("id"), F.lit(anchor_groups)).cast("int")).withColumn("rg", every(row_groups))
        return field.cogroup(placed.groupBy("rg", "ag"))

    def positive_cell(_: tuple, docs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(asks):
            return pd.DataFrame({"anchor": [], "id": [], "score": []}, dtype="int64")
        anchors = _vectors(asks, width, scale, count)
        at, score, ids = best_positives(anchors, _vectors(docs, width, scale, count), positives)
        return pd.DataFrame({"anchor": anchors.ids[at], "id": ids, "score": score})

    found = in_cells(askers).applyInPandas(positive_cell, "anchor bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    chosen = found.withColumn("place", place).filter(F.col("place") <= positives)
    listed = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    pairs = askers.join(listed, F.col("id") == F.col("anchor")).drop("anchor")
    pairs = pairs.withColumn("positive_ids", F.col("positives.id")).withColumn("positive_scores", F.col("positives.score")).drop("positives")
    pairs = stored(pairs, "negatives-positives")

    def negative_cell(_: tuple, docs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", "positive_place", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not len(docs) or not len(asks):
            return pd.DataFrame({c: [] for c in names}, dtype="int64")
        anchors = _vectors(asks, width, scale, count)
        ids, own = np.zeros((len(asks), positives), np.int64), np.zeros((len(asks), positives), np.int64)
        given = np.zeros((len(asks), positives), bool)
        for i, (p, s) in enumerate(zip(asks["positive_ids"], asks["positive_scores"], strict=True)):
            ids[i, : len(p)], own[i, : len(p)], given[i, : len(p)] = p, s, True
        at, score, negative = best_negatives(anchors, own, given, _vectors(docs, width, scale, count), negatives, low, high)
        return pd.DataFrame({
            "anchor_id": anchors.ids[at // positives], "positive_place": at % positives, "positive_id": ids.reshape(-1)[at], "positive_score": own.reshape(-1)[at],
            "negative_id": negative, "negative_score": score,
        })

    schema = "anchor_id bigint, positive_place bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    met = in_cells(pairs).applyInPandas(negative_cell, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_place").orderBy(F.desc("negative_score"), "negative_id"))
    best = met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
