"""Toxicity by compression distance: two zstandard dictionaries, one window at a time.

A window (a word with its borders) is compressed behind a fixed stretch of
ordinary text once with the toxic and once with the ordinary dictionary; the
difference of the two lengths says which text it is closer to.  Both
dictionaries start with the same ordinary background, so common windows cost
the same in both and differences come from what the classes have of their own:
the ordinary one ends with segments that zstandard's builder picks from
ordinary windows, the toxic one with the segments of toxic windows that mark
the class most strongly (the builder alone picks what is frequent, which is
mostly what both classes share).  A document's windows are counted by
thresholds of the difference, and a logistic curve over these counts, fitted on
rows that did not choose the segments, gives the score.

Training reads a bounded sample of labelled rows; scoring reads every window of
every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import short_batches, stored, whole_text

# labelled rows that training reads, by class
TRAIN_TOXIC = 3_000
TRAIN_ORDINARY = 6_000
SEGMENTS = 400
LEAST_G = 15.0
LONGEST = 9
BACKGROUND_WINDOWS = 128
WINDOW_WORDS = 32
ORDINARY_WINDOWS = 4_000
LEVEL = 12
THRESHOLDS = (2, 4, 6)
MEMO_WORDS = 300_000
WORD = re.compile(r"\w+")
_JAVA_SPLIT = r"[^\p{L}\p{N}_]+"


class Distance:
    """Difference of compressed lengths (ordinary - toxic) of a window."""

    def __init__(self, background: bytes, toxic: bytes, ordinary: bytes) -> None:
        self.before, self.behind = background[:60], background[120:152]
        # the last bytes of a dictionary aren't searched, so background closes both
        self._toxic, self._ordinary = (self._compressor(background + own + background[60:92]) for own in (toxic, ordinary))
        self._zero = 0
        self._new: dict[str, int] = {}
        self._old: dict[str, int] = {}
        self._zero = self._raw("")

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content), source_size=128, write_checksum=False, write_content_size=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=settings)

    def _raw(self, window: str) -> int:
        whole = self.before + window.encode("utf-8", "replace") + self.behind
        return len(self._ordinary.compress(whole)) - len(self._toxic.compress(whole))

    def __call__(self, word: str) -> int:
        known = self._new.get(word)
        if known is None:
            known = self._old.get(word)
            if known is None:
                known = self._raw(f" {word} ") - self._zero
            if len(self._new) >= MEMO_WORDS:
                self._old, self._new = self._new, {}
            self._new[word] = known
        return known

    def features(self, text: str) -> list[float]:
        found = np.array([self(w) for w in WORD.findall(text.lower())] or [0])
        n = len(found)
        out = [float(min(found.max(), 12)), float(found.mean())]
        for t in THRESHOLDS:
            over = int((found >= t).sum())
            out += [math.log1p(over), over / math.sqrt(n)]
        return out


@dataclass
class Model:
    background: bytes
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # constant first

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale]) @ self.weights
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _fit(features: np.ndarray, labels: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - labels) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, toxic: int, ordinary: int) -> DataFrame:
    """At most about the given number of labelled rows of each class: (text, y, choosing)."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    rows = rows.groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(toxic / max(1, sizes.get(1, 0)))).otherwise(F.lit(ordinary / max(1, sizes.get(0, 0))))
    place = F.pmod(F.xxhash64("k"), F.lit(1_000_000))
    chosen = rows.filter(place < share * 1_000_000)
    # few toxic rows: all of them choose the segments and fit the curve
    few = sizes.get(1, 0) < 60
    choosing = F.lit(True) if few else F.pmod(F.xxhash64("k", F.lit(1)), F.lit(3)) < 2
    fitting = F.lit(True) if few else F.pmod(F.xxhash64("k", F.lit(1)), F.lit(3)) == 2
    chosen = chosen.select("k", "y", choosing.alias("choosing"), fitting.alias("fitting"))
    texts = docs.select(F.col(key).alias("d"), whole_text(text).alias("t"))
    return stored(texts.join(F.broadcast(chosen), F.col("d") == F.col("k")).select("t", "y", "choosing", "fitting"), "toxicity-sample")


def _segments(sample: DataFrame, most: int) -> list[str]:
    """Word beginnings and whole words that toxic rows have and others lack, strongest first (G statistic)."""
    rows = sample.filter("choosing").withColumn("id", F.monotonically_increasing_id())
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    if not n1 or not n0:
        return []
    words = rows.select("id", "y", F.explode(F.array_distinct(F.split(F.lower("t"), _JAVA_SPLIT))).alias("w")).filter("w <> ''")
    whole = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    starts = F.transform(F.sequence(F.lit(4), F.lit(LONGEST)), lambda n: F.substring(whole, F.lit(1), n))
    grams = words.select("id", "y", F.explode(F.array_distinct(F.concat(starts, F.array(whole)))).alias("g")).distinct()
    counts = grams.groupBy("g").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b")).filter(f"a >= 3 AND a / {n1} > b / {n0}")
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    part = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    fit = lambda k, n, p: part(k, p) + part(F.lit(n) - k, 1 - p)
    own = fit(F.col("a"), n1, F.col("a") / n1) + fit(F.col("b"), n0, F.col("b") / n0)
    both = fit(F.col("a"), n1, share) + fit(F.col("b"), n0, share)
    best = counts.withColumn("strength", 2 * (own - both)).filter(F.col("strength") >= LEAST_G).orderBy(F.desc("strength"), F.desc(F.length("g")), "g").limit(4 * most)
    out: list[str] = []
    for r in best.collect():
        if len(out) < most and not any(r["g"] in o for o in out):
            out.append(r["g"])
    return out


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    toxic: int = TRAIN_TOXIC, ordinary: int = TRAIN_ORDINARY, segments: int = SEGMENTS,
) -> Model:
    """Fit on labelled rows of ``docs``; a null text counts as empty, rows with a null label are left out.

    A key with several labels counts as toxic if one says so.  With only one
    class, or none, every score is that class's share (0.5 without any rows).
    """
    spark = docs.sparkSession
    short_batches(spark)
    sample = _sample(docs, labels, key, text, label, toxic, ordinary)
    marks = _segments(sample, segments)
    ordinary_words = sample.filter("y = 0").select(F.split(F.lower("t"), r"\s+").alias("ws"))
    cut = F.transform(F.sequence(F.lit(0), F.size("ws") - 1, F.lit(WINDOW_WORDS)), lambda i: F.array_join(F.slice("ws", i + 1, WINDOW_WORDS), " "))
    pieces = ordinary_words.filter(F.size("ws") > 0).select(F.explode(cut).alias("w")).filter("length(w) > 60")
    windows = [r["w"].strip() for r in pieces.orderBy(F.xxhash64("w"), "w").limit(ORDINARY_WINDOWS).select(F.substring("w", 1, 400).alias("w")).collect()]
    background = " ".join(windows[:BACKGROUND_WINDOWS]).encode() or b" " * 200
    background = background.ljust(200, b" ")
    own_toxic = "".join(reversed(marks)).encode()
    own_ordinary = b""
    if own_toxic and windows:
        try:
            own_ordinary = zstandard.train_dictionary(max(1024, len(own_toxic)), [w.encode() for w in windows]).as_bytes()[-len(own_toxic) :]
        except zstandard.ZstdError:  # too little text for the builder
            own_ordinary = " ".join(windows[::-1]).encode()[-len(own_toxic) :]
    model = Model(background, own_toxic, own_ordinary, np.zeros(0), np.zeros(0), np.zeros(0))
    spread = sample.filter("fitting").select("t", "y").repartition(spark.sparkContext.defaultParallelism)
    found = spread.select("y", featurer(spark, model)(F.col("t")).alias("f")).toPandas()
    width = 2 + 2 * len(THRESHOLDS)
    x, y = np.array(found["f"].tolist(), float).reshape(len(found), width), found["y"].to_numpy(float)
    if len(found) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(found) else 0.5
        model.mean, model.scale, model.weights = np.zeros(width), np.ones(width), np.r_[math.log(share / (1 - share)), np.zeros(width)]
    else:
        model.mean, model.scale, model.weights = _fit(x, y)
    return model


def featurer(spark: SparkSession, model: Model):
    """A column function from a text to its window counts."""
    shared = spark.sparkContext.broadcast((model.background, model.toxic, model.ordinary))

    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = Distance(*shared.value)
        for batch in texts:
            yield pd.Series([distance.features(t if isinstance(t, str) else "") for t in batch])

    return features


def scorer(spark: SparkSession, model: Model):
    """A column function from a text (null counts as empty) to a score from 0 to 1, higher: more likely toxic."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        distance = Distance(own.background, own.toxic, own.ordinary)
        for batch in texts:
            features = np.array([distance.features(t if isinstance(t, str) else "") for t in batch], float)
            yield pd.Series(own.score(features) if len(features) else np.zeros(0))

    return score


def training_rows(key: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds != 0, F.lit(False))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted (1 if score >= 0.5) of every row; repeated rows repeat, an empty table gives none."""
    scored = docs.select(F.col(key), scorer(docs.sparkSession, model)(F.col(text)).alias("score"))
    return scored.select(key, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
