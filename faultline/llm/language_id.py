"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in a bounded hash space; the matrix of
log probabilities (languages x buckets) is broadcast, and batches of texts are
scored in numpy through their sparse n-gram rows.  The matrix has a proven
size: ``buckets`` times the number of languages, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import short_batches, whole_text

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
# documents per language that training reads, chosen by a hash of the key
TRAIN_PER_LANGUAGE = 4_000
MAX_LANGUAGES = 512
UNDETERMINED = "und"
# characters scored at a time; longer texts are summed over several blocks
BLOCK_CHARS = 1 << 18
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (buckets, languages), float32
    log_prior: np.ndarray


def ngram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of a text, lower-cased, with a space at both ends, in one array or more.

    A long text is read in blocks that start max(ORDERS) - 1 characters early; an
    n-gram counts in the block where it ends.
    """
    padded = f" {text.lower()} "
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for at in range(0, len(padded), BLOCK_CHARS):
        own = min(at, max(ORDERS) - 1)
        codes = np.frombuffer(padded[at - own : at + BLOCK_CHARS].encode("utf-32-le", "replace"), dtype=np.uint32)
        out, value = [], np.zeros(len(codes), dtype=np.uint32)
        for n in ORDERS:
            if len(codes) < n:
                break
            value = (value[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MIX[(n - 1) % 3]
            value ^= value >> np.uint32(15)
            out.append((value[max(0, own - n + 1) :] * np.uint32(0x27D4EB2F) + np.uint32(n)) * _MIX[0] >> shift)
        yield np.concatenate(out).astype(np.int64)


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE, buckets: int = BUCKETS
) -> Model:
    """Fit on the rows of ``docs`` whose language is not null.

    ``per_language`` bounds the sample: where a language has more rows, those
    whose key hashes lowest are read, in the share that gives about that many.
    Null texts count as empty.  Without any labelled row the model knows no
    language and answers ``und``.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(key).alias("k"), whole_text(text).alias("t"), F.col(lang).alias("l")).filter("l IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if the matrix may be that large")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for pair in ((n, int(min(1.0, per_language / sizes[n]) * 1_000_000)) for n in languages) for x in pair])
    sample = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share[F.col("l")]).select("t", "l")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, l in zip(batch["t"], batch["l"], strict=True):
                own = totals.setdefault(l, np.zeros(buckets, np.int64))
                for block in ngram_buckets(t, buckets):
                    own += np.bincount(block, minlength=buckets)
        for l, own in totals.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"l": l, "bucket": at, "n": own[at]})

    counts = sample.mapInPandas(count, "l string, bucket bigint, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((buckets, len(languages)))
    where = {n: i for i, n in enumerate(languages)}
    table[counts["bucket"].to_numpy(int), counts["l"].map(where).to_numpy(int)] = counts["n"].to_numpy(float)
    smoothed = table + 0.5
    log_prob = np.log(smoothed / smoothed.sum(axis=0))
    prior = np.array([sizes[n] for n in languages], float)
    return Model(languages, np.ascontiguousarray(log_prob.astype(np.float32)), np.log(prior / prior.sum()))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Most probable language and its posterior for each text of a batch."""
    names, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text or not model.languages or not any(map(str.isalpha, text)):
            names.append(UNDETERMINED)
            continue
        total = model.log_prior.copy()
        for block in ngram_buckets(text, len(model.log_prob)):
            # the sparse row of the text: how often each bucket occurs
            at, n = np.unique(block, return_counts=True)
            total += n.astype(np.float32) @ model.log_prob[at]
        best = int(np.argmax(total))
        names.append(model.languages[best])
        scores[i] = 1.0 / np.exp(total - total[best]).sum()
    return names, scores


def predictor(spark: SparkSession, model: Model):
    """A column function from a text to struct(lang_pred, score).

    ``und`` with score 0 where the text is null or has no letter.  Ties go to
    the language that sorts first.
    """
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, scores = classify(shared.value, [t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def language_columns(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name`` of (lang_pred, score)."""
    return docs.withColumn(name, predictor(docs.sparkSession, model)(F.col(text)))


def training_rows(docs: DataFrame, key: str = "doc_id", folds: int = 4, held_out: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds != held_out, F.lit(False))
