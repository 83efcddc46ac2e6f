"""Ledgers and incidents as streams.

Aggregates that only add up are kept as increments: each micro-batch commits
its partial result once, a replay of a committed batch changes nothing, and
increments are merged level by level, so that their number grows with the
logarithm of the batches.  That is exactly-once without keyed state, and the
result equals the batch job's.  Rules that look back at earlier events of a key
(caps, burst windows) keep a few numbers per key, no longer than they matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from faultline.operators.catalogue import UI_ACTIONS, UI_HOURLY_MAX
from faultline.session import scratch_path
from faultline.sources import snapshots

# as many increments of one level become one of the next
FAN = 8
# what is told of the first incident of a signature
SAMPLED = ["kind", "exc_type", "message"]
TABLE = "increments"


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    reader = spark.readStream.schema(schema)
    if status.isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything there is and stop; the query, for its progress."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _span(part: tuple[str, str, str]) -> tuple[int, int]:
    """First and last batch of an increment."""
    first, last = part[2].removeprefix("span=").split("-")
    return int(first), int(last)


def _full_level(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The last FAN increments if they are of one level, that is, of one number of batches."""
    last = spans[-FAN:]
    return last if len(last) == FAN and len({b - a for a, b in last}) == 1 else []


def keep_increment(rows: DataFrame, number: int, folder: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Commit the partial result of one micro-batch, and merge full levels.

    Batches arrive in order, so one at or before the last committed is a replay
    whose rows are in already.  Merged increments replace theirs in a commit.
    """
    spark = rows.sparkSession
    state = snapshots.current(spark, folder)
    if state.parts and number <= max(_span(p)[1] for p in state.parts):
        return
    # a batch without rows still has its place
    empty = [(TABLE, "none", f"span={number}-{number}")]
    parts = state.parts + (snapshots.add(state, TABLE, rows.withColumn("span", F.lit(f"{number}-{number}")), folder, "span") or empty)
    snapshots.commit(spark, state, parts, folder)
    while group := _full_level(sorted(_span(p) for p in parts)):
        state = snapshots.current(spark, folder)
        old = [p for p in state.parts if _span(p) in group]
        name = f"{group[0][0]}-{group[-1][1]}"
        held = _read(spark, folder, state, old)
        merged = snapshots.add(state, TABLE, merge(held).withColumn("span", F.lit(name)), folder, "span") or [(TABLE, "none", f"span={name}")]
        parts = [p for p in state.parts if p not in old] + merged
        snapshots.commit(spark, state, parts, folder)


def _read(spark: SparkSession, folder: str, state: snapshots.State, parts: list[tuple[str, str, str]]) -> DataFrame:
    shown = snapshots.State(state.number, state.schemas, [p for p in parts if p[1] != "none"])
    return snapshots.read(spark, folder, TABLE, shown).drop("span")


def increments(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append"
) -> DataFrame:
    """Drain a stream into increments and read them merged.

    ``partial`` makes a micro-batch's result; ``merge`` makes one result of
    several and keeps the columns.
    """
    spark = stream.sparkSession
    drain(stream, lambda batch, number: keep_increment(partial(batch), number, f"{folder}/increments", merge), f"{folder}/checkpoint", mode)
    state = snapshots.current(spark, f"{folder}/increments")
    return merge(_read(spark, f"{folder}/increments", state, state.parts))


def to_ledger(stream: DataFrame, folder: str) -> DataFrame:
    """Append conformed rows to day partitions, with the file sink's own exactly-once log."""
    query = (
        stream.writeStream.format("parquet").partitionBy("day").option("path", f"{folder}/ledger")
        .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/ledger")


def daily_trend(stream: DataFrame, folder: str) -> DataFrame:
    """Events and distinct users per day; users are kept as distinct pairs, so the count stays exact."""
    pairs = increments(
        stream, lambda b: b.groupBy("day", "username").agg(F.count_if(F.col("kind") == "action").alias("actions")),
        lambda parts: parts.groupBy("day", "username").agg(F.sum("actions").alias("actions")), folder,
    )
    return pairs.groupBy("day").agg(F.sum("actions").alias("actions"), F.countDistinct("username").alias("active_users"))


def daily_tokens(stream: DataFrame, folder: str) -> DataFrame:
    """Tokens per user and day, from which any rolling window is summed."""
    return increments(
        stream, lambda b: b.filter(F.col("username").isNotNull()).groupBy("username", "day").agg(F.sum("total_tokens").alias("tokens")),
        lambda parts: parts.groupBy("username", "day").agg(F.sum("tokens").alias("tokens")), folder,
    )


def rolling_tokens(per_day: DataFrame, as_of: str, window_days: int) -> DataFrame:
    first = F.date_sub(F.lit(as_of).cast("date"), window_days - 1)
    return per_day.groupBy("username").agg(
        F.coalesce(F.sum(F.when(F.col("day") == F.lit(as_of).cast("date"), F.col("tokens"))), F.lit(0)).alias("today"),
        F.coalesce(F.sum(F.when(F.col("day") >= first, F.col("tokens"))), F.lit(0)).alias("window"),
    )


def recurrence(stream: DataFrame, folder: str) -> DataFrame:
    """Known issues kept up to date as signed incidents arrive."""
    order = F.struct("filed_at", "incident_id")
    keys = ["org_id", "signature"]
    merged = increments(
        stream,
        lambda b: b.filter(F.col("signature").isNotNull()).groupBy(*keys).agg(
            F.min_by(F.struct("filed_at", "incident_id", *SAMPLED), order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")
        ),
        lambda parts: parts.groupBy(*keys).agg(
            F.min_by("first", F.struct("first.filed_at", "first.incident_id")).alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
        ),
        folder,
    )
    return merged.select(
        *keys, F.col("first.filed_at").alias("first_seen"), F.col("last.filed_at").alias("last_seen"),
        F.col("last.incident_id").alias("latest_incident"), F.col("n").alias("occurrences"), *[F.col(f"first.{x}").alias(f"first_{x}") for x in SAMPLED],
    )


def with_resolutions(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Known issues of a stream with the latest resolution of their signature, from the table of resolved incidents.

    ``resolutions``: org_id, signature, incident_id, resolved_at, resolution.
    """
    fixed = resolutions.filter(F.col("resolution").isNotNull()).groupBy("org_id", "signature").agg(
        F.max_by("resolution", F.struct("resolved_at", "incident_id")).alias("resolution"), F.max("resolved_at").alias("resolution_recorded_at")
    )
    return issues.join(fixed, ["org_id", "signature"], "left")


def hourly_cap(reports: DataFrame, folder: str, cap: int = UI_HOURLY_MAX) -> DataFrame:
    """The first ``cap`` known browser events per user and hour of arrival, over any number of batches.

    Each micro-batch admits what the counts of the batches before it leave
    room for, and adds its own counts; both are written under the batch
    number, so a replay reads and writes the same.
    """
    names = [row.split("|")[0] for row in UI_ACTIONS.strip().splitlines()]
    rows = reports.filter(F.col("action").isin(names)).select(
        "user_id", "event_id", "arrived_at", F.date_trunc("hour", "arrived_at").alias("hour")
    )
    spark = reports.sparkSession
    counts, admitted = f"{folder}/counts", f"{folder}/admitted"

    def each(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy("user_id", "hour").orderBy("arrived_at", "event_id")
        first = batch.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap)
        if number > 0:
            # only the days at hand are read; a batch spans few
            days = [row["day"] for row in batch.select(F.to_date("hour").alias("day")).distinct().collect()]
            before = spark.read.parquet(counts).filter((F.col("batch") < number) & F.col("day").isin(days))
            used = before.groupBy("user_id", "hour").agg(F.sum("n").alias("used"))
            first = first.join(used, ["user_id", "hour"], "left").filter(F.col("r") + F.coalesce("used", F.lit(0)) <= cap)
        kept = first.select("user_id", "hour", "event_id")
        kept.write.mode("overwrite").parquet(f"{admitted}/batch={number}")
        done = spark.read.parquet(f"{admitted}/batch={number}")
        done.groupBy("user_id", "hour", F.to_date("hour").alias("day")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("day").parquet(f"{counts}/batch={number}")

    drain(rows, each, f"{folder}/checkpoint")
    return spark.read.parquet(admitted)


def burst_windows(events: DataFrame, key: str, ts: str, limit: int, window_seconds: int, folder: str) -> DataFrame:
    """Fixed windows opened by the first event of a key, as events arrive in time order by batch.

    State is the open window of a key: its start and how many events it saw.
    It ends when the watermark, one window behind the latest event, has passed
    the window's end, so keys that fall silent leave nothing behind.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    rows = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.timestamp_diff("SECOND", epoch, F.col(ts)).alias("sec"))
    rows = rows.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", f"{window_seconds} seconds")

    def walk(key_, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counts: dict[int, int] = {}
        for pdf in chunks:
            secs, n = np.unique(pdf["sec"].to_numpy(), return_counts=True)
            for s, k in zip(secs.tolist(), n.tolist()):
                counts[s] = counts.get(s, 0) + k
        start, seen = state.get if state.exists else (None, 0)
        out = []
        for s in sorted(counts):
            if start is None or s - start >= window_seconds:
                if start is not None:
                    out.append((start, seen))
                start, seen = s, 0
            seen += counts[s]
        out.append((start, seen))
        end = (start + window_seconds) * 1000
        if end > state.getCurrentWatermarkMs():
            state.update((start, seen))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key_[0], a, n) for a, n in out], columns=["key", "window_start", "events"])

    told = rows.groupBy("key").applyInPandasWithState(
        walk, "key string, window_start bigint, events bigint", "start bigint, seen bigint", "update", "EventTimeTimeout"
    )
    most = lambda df: df.groupBy("key", "window_start").agg(F.max("events").alias("events"))
    latest = increments(told, most, most, folder, "update")
    allowed = F.least("events", F.lit(limit)).cast("bigint")
    return latest.select("key", "window_start", "events", allowed.alias("allowed"), (F.col("events") - allowed).alias("denied"))


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    return scratch_path(spark, f"stream-{purpose}")
