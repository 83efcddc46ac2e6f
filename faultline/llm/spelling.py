"""Spelling variants: words that are one insertion, deletion or replacement apart.

Words are counted over all texts first, so whatever follows grows with the
vocabulary alone.  Two words that are one edit apart agree in the first or the
last half of the longer one's length, so words are laid side by side by that
half.  There they are compared in dense tiles: two blocks of words become padded
matrices of code points, from the left and from the right, and a pair is one
edit apart when the common prefix and the common suffix together reach the
longer length less one.  Where one half is shared by more words than a task
compares, its blocks meet pair by pair in tasks of their own.  Each pair counts
where it is met first (by the first half if they agree in it), so none counts
twice, and a tile gives one row per word, not one per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import spark_hash_partitions, stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 6
LEAST_COUNT = 5
# a word's form is at least so many times as frequent
TIMES = 5
# words of one side of a tile, and of one half that one task compares
TILE = 64
BLOCK = 2_048
BIN_ROWS = 100_000
# code points compared at once
_CELLS = 1 << 22
_TILE_ROW = "word string, near bigint, best_n bigint, best string"


def misspelt(key: str, run, every: int):
    """``run``, with one code point deleted where crc32('<key>:<run>') is divisible by ``every``; a null key is empty."""
    h = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT, noise: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters in all texts, A-Z lower-cased, that are long and frequent enough.

    ``noise``: one run in so many loses a code point first (see ``misspelt``).
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.translate(F.col(text), upper, upper.lower()), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_chars)
    word = F.col("run") if noise is None else misspelt("key", F.col("run"), noise)
    counted = runs.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least)


def _codes(words: list[str], from_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points, zero beyond the word's end, and lengths."""
    rows = [w[::-1] for w in words] if from_right else words
    table = np.array(rows, dtype=np.str_)
    return table.view(np.uint32).reshape(len(words), -1), np.array([len(w) for w in words])


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Length of the common beginning of every pair of rows."""
    width = min(a[0].shape[1], b[0].shape[1])
    same = a[0][:, None, :width] == b[0][None, :, :width]
    run = np.logical_and.accumulate(same, axis=2).sum(axis=2, dtype=np.int32)
    return np.minimum(run, np.minimum(a[1][:, None], b[1][None, :]))


def single_edits(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(near, prefix) of every pair: whether exactly one edit lies between them, and their common prefix's length."""
    a, b = _codes(left, False), _codes(right, False)
    prefix = _common(a, b)
    suffix = _common(_codes(left, True), _codes(right, True))
    longer, apart = np.maximum(a[1][:, None], b[1][None, :]), np.abs(a[1][:, None] - b[1][None, :])
    same = (apart == 0) & (prefix == longer)
    return (prefix + suffix >= longer - 1) & (apart <= 1) & ~same, prefix


def _best(words: list[str], other: list[str], n: np.ndarray, at: np.ndarray, to: np.ndarray) -> list[tuple]:
    """Of pairs (at, to): per word their number and the other word of largest n, ties to the first in order."""
    place = np.argsort(np.argsort(np.array(other, dtype=object)))
    order = np.lexsort((place[to], -n[to], at))
    at, to = at[order], to[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    counts = np.diff(np.concatenate([first, [len(at)]]))
    return [(words[i], int(k), int(n[j]), other[j]) for i, j, k in zip(at[first], to[first], counts, strict=True)]


def _tile(keys, words: list[str], n: np.ndarray, rows: range, cols: range) -> list[tuple]:
    """One tile: rows against columns (the same range: each pair once)."""
    left, right = [words[i] for i in rows], [words[j] for j in cols]
    near, prefix = single_edits(left, right)
    i, j = np.nonzero(near if rows != cols else np.triu(near, 1))
    if not len(i):
        return []
    longer = np.maximum(np.array([len(w) for w in left])[i], np.array([len(w) for w in right])[j])
    half, at, to = keys[0][rows.start + i], keys[1][rows.start + i], keys[1][cols.start + j]
    # in the same half of this length; by the last half only what the first half doesn't show
    good = (at == to) & (longer == keys[2][rows.start + i]) & (half | (prefix[i, j] < (longer + 1) // 2))
    i, j = i[good], j[good]
    if not len(i):
        return []
    n_left, n_right = n[rows.start : rows.stop], n[cols.start : cols.stop]
    return _best(left, right, n_right, i, j) + _best(right, left, n_left, j, i)


def _cut(lengths: np.ndarray, begin: int, end: int) -> list[range]:
    """Blocks of at most TILE neighbours, fewer where words are so long that a tile would be large."""
    out, at = [], begin
    while at < end:
        size = int(max(1, min(TILE, math.isqrt(_CELLS // max(1, int(lengths[at]) + 1)))))
        out.append(range(at, min(end, at + size)))
        at += size
    return out


def _sorted(group: pd.DataFrame) -> tuple:
    group = group.sort_values(["m", "first", "half", "word"], kind="stable")
    part = pd.factorize(group["half"] + group["m"].astype(str) + group["first"].astype(str))[0]
    keys = (group["first"].to_numpy(bool), part, group["m"].to_numpy(np.int64))
    return keys, group["word"].tolist(), group["n"].to_numpy(np.int64), group["m"].to_numpy(np.int64)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["word", "near", "best_n", "best"]).astype({"near": "int64", "best_n": "int64"})


def _compare_bin(group: pd.DataFrame) -> pd.DataFrame:
    """All halves of a bin: neighbouring blocks, as far as they share a half."""
    keys, words, n, lengths = _sorted(group)
    blocks, out = _cut(lengths, 0, len(words)), []
    for k, rows in enumerate(blocks):
        for cols in blocks[k:]:
            if keys[1][cols.start] != keys[1][rows.stop - 1] and cols != rows:
                break
            out += _tile(keys, words, n, rows, cols)
    return _frame(out)


def _compare_cell(group: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of one half (or one with itself): every tile across."""
    if group["low"].iloc[0] == group["high"].iloc[0]:
        return _compare_bin(group)
    keys, words, n, lengths = _sorted(group.sort_values("block", kind="stable"))
    side = group.set_index("word")["block"].to_dict()
    order = np.argsort([side[w] for w in words], kind="stable")
    keys, words, n, lengths = tuple(k[order] for k in keys), [words[i] for i in order], n[order], lengths[order]
    cut = int(sum(side[w] == group["low"].iloc[0] for w in words))
    out = []
    for rows in _cut(lengths, 0, cut):
        for cols in _cut(lengths, cut, len(words)):
            out += _tile(keys, words, n, rows, cols)
    return _frame(out)


def _halves(words: DataFrame) -> DataFrame:
    """(m, first, half, word, n): each word by its beginning and its end, as the longer (m) or the shorter of a pair."""
    size = F.length("word")
    long = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    begin, end = F.ceil(F.col("m") / 2).cast("int"), F.floor(F.col("m") / 2).cast("int")
    half = F.array(
        F.struct(F.lit(True).alias("first"), F.substring("word", F.lit(1), begin).alias("half")),
        F.struct(F.lit(False).alias("first"), F.substring("word", size - end + 1, end).alias("half")),
    )
    return long.select("m", "word", "n", F.explode(half).alias("h")).select("m", "h.first", "h.half", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of words (word, n) that have a near word; ``best`` is the most frequent, ties to the first in order."""
    spark = words.sparkSession
    key = ["m", "first", "half"]
    rows = _halves(words)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    large = stored(sizes.filter(F.col("k") > BLOCK).withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("bigint")).drop("k"), "spelling-large")
    bins = max(spark_hash_partitions(spark), -(-4 * words.count() // BIN_ROWS))
    no_large = large.isEmpty()
    one_task = (rows if no_large else rows.join(large, key, "left_anti")).withColumn("bin", F.pmod(F.xxhash64(*key), F.lit(bins)))
    tiles = one_task.groupBy("bin").applyInPandas(_compare_bin, _TILE_ROW)
    if not no_large:
        parts = rows.join(large, key).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        parts = parts.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        tiles = tiles.unionByName(parts.groupBy(*key, "low", "high").applyInPandas(_compare_cell, _TILE_ROW))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    return tiles.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n); words are distinct and not null.

    ``form`` is the near word of largest n, ties to the smallest in code-point
    order, if its n is at least ``times`` (2 or more) the word's; else null.  ``root`` follows
    forms to the last and is the word itself where it has no form.  A word
    without near words has n_near 0; an empty table gives no rows.
    """
    words = stored(words, "spelling-words")
    near = near_words(words).select(F.col("word").alias("w"), "n_near", "best_n", "best")
    good = F.col("best_n") >= times * F.col("n")
    known = words.join(near.hint("merge"), F.col("word") == F.col("w"), "left").select(
        "word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")
    )
    known = stored(known, "spelling-forms")
    # each step multiplies n, so the longest way to a root is known; every round doubles the way covered
    most = known.filter("form IS NOT NULL").agg(F.max(F.col("form_n").cast("double") / F.col("n"))).first()[0]
    top = known.agg(F.max("n")).first()[0] or 1
    steps = 0 if most is None else max(1, math.floor(math.log(top, times)) + 1)
    ways = known.filter("form IS NOT NULL").select(F.col("word").alias("from"), F.col("form").alias("to"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = ways.select(F.col("from").alias("at"), F.col("to").alias("beyond"))
        ways = stored(ways.join(onward, F.col("to") == F.col("at"), "left").select("from", F.coalesce("beyond", "to").alias("to")), "spelling-ways")
    rooted = known.join(ways, F.col("word") == F.col("from"), "left")
    return rooted.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT, times: int = TIMES, noise: int | None = None
) -> DataFrame:
    """The variants among the words of all texts of ``docs`` (see ``word_counts`` and ``variants``).

    Null and empty texts hold no words; repeated rows count as often as they
    stand; words of any length take part, in smaller tiles; an empty table
    gives no rows; other columns take no part.
    """
    return variants(word_counts(docs, key, text, least_chars, least, noise), times)
