"""Content-hash manifests: what changed between two snapshots of metadata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8


def content_hashes(files: DataFrame, path: str, content: str) -> DataFrame:
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("hash"))


def unit_hashes(files: DataFrame, unit: str, path: str, content: str) -> DataFrame:
    """One hash per multi-file unit, over its contents in path order.

    SHA-256 of a concatenation is sequential, so files are sorted within their
    partition and fed to the digest one by one; no unit is ever assembled.
    """
    rows = files.select(
        F.col(unit).cast("string").alias("unit"), F.col(path).alias("path"), F.col(content).alias("content")
    ).repartition("unit").sortWithinPartitions("unit", "path")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, n = None, hashlib.sha256(), 0
        for pdf in batches:
            out = []
            for key, text in zip(pdf["unit"], pdf["content"]):
                if key != current:
                    if current is not None:
                        out.append((current, state.hexdigest(), n))
                    current, state, n = key, hashlib.sha256(), 0
                state.update((text or "").encode("utf-8"))
                n += 1
            yield pd.DataFrame(out, columns=["unit", "hash", "files"])
        if current is not None:
            yield pd.DataFrame([(current, state.hexdigest(), n)], columns=["unit", "hash", "files"])

    return rows.mapInPandas(digest, "unit string, hash string, files bigint")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every path of either snapshot with what became of it."""
    b = before.select(F.col("path").alias("b_path"), F.col("hash").alias("b_hash"))
    a = after.select(F.col("path").alias("a_path"), F.col("hash").alias("a_hash"))
    status = (
        F.when(F.col("b_path").isNull(), "added").when(F.col("a_path").isNull(), "removed")
        .when(F.col("a_hash").eqNullSafe(F.col("b_hash")), "unchanged").otherwise("changed")
    )
    return a.join(b, F.col("a_path") == F.col("b_path"), "full").select(
        F.coalesce("a_path", "b_path").alias("path"), status.alias("status")
    )


def by_kind(diff: DataFrame) -> DataFrame:
    """Counts per kind, the kind being the first part of the path."""
    kind = F.substring_index("path", "/", 1)
    statuses = ("added", "changed", "removed", "unchanged")
    return diff.groupBy(kind.alias("kind")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def totals(kinds: DataFrame) -> DataFrame:
    sums = kinds.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("added", "changed", "removed", "unchanged")])
    seen_before = F.col("changed") + F.col("removed") + F.col("unchanged")
    return sums.withColumn("total", F.col("added") + F.col("changed") + F.col("unchanged")).withColumn(
        "first_connection", seen_before == 0
    )


def samples(diff: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The first few paths of each kind of change."""
    place = F.row_number().over(Window.partitionBy("status").orderBy("path"))
    return diff.filter("status <> 'unchanged'").withColumn("place", place).filter(F.col("place") <= n)


def merged(before: DataFrame, after: DataFrame, today: str) -> DataFrame:
    """The new manifest: an unchanged entry is kept as it was, else only first_seen survives."""
    b = before.select(
        F.col("path").alias("b_path"), F.col("hash").alias("b_hash"), F.col("first_seen").alias("b_first"), F.col("last_changed").alias("b_last")
    )
    same = F.coalesce(F.col("hash") == F.col("b_hash"), F.lit(False))
    return after.join(b, F.col("path") == F.col("b_path"), "left").select(
        "path", "hash", F.coalesce("b_first", F.lit(today)).alias("first_seen"),
        F.when(same, F.col("b_last")).otherwise(F.lit(today)).alias("last_changed"),
    )


def to_extract(after: DataFrame, done: DataFrame) -> DataFrame:
    """Sources not yet extracted in this content by this extractor version."""
    return after.join(done, ["path", "hash", "extractor_version"], "left_anti")


def run_record(diff: DataFrame, run_id: str, at: str | None = None) -> DataFrame:
    """One changelog row of an extraction run, with the time it ran; what it removed is a table (``removed_paths``)."""
    return totals(by_kind(diff)).withColumn("run_id", F.lit(run_id)).withColumn("run_at", F.lit(at).cast("string"))


def removed_paths(diff: DataFrame, run_id: str) -> DataFrame:
    """The paths that an extraction run found gone."""
    return diff.filter("status = 'removed'").select(F.lit(run_id).alias("run_id"), "path")
