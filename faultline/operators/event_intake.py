"""Turning requests and browser reports into ledger rows; caps and burst limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.columns import iso, safe_label
from faultline.operators.catalogue import (
    ANONYMOUS_OK, LABELLED, UI_BATCH_MAX, UI_CLOCK_SECONDS, UI_HOURLY_MAX, UI_META_KEYS, UI_SAFE_TOKEN, routes, ui_actions,
)

# fixed values: limiter bucket -> (events, seconds)
BUCKETS = {"login": (20, 60), "signup": (10, 3600), "signup_attempt": (30, 600)}
MUTATING = ("POST", "PUT", "PATCH", "DELETE")


def channel_of(header: Column, ident_kind: Column) -> Column:
    """Allowed header label, else web for a session or no identity, else api."""
    label = F.lower(F.trim(header))
    return (
        F.when(label.isin(*LABELLED), label)
        .when(ident_kind.isNull() | (ident_kind == "session"), "web")
        .otherwise("api")
    )


def classify(requests: DataFrame) -> DataFrame:
    """Requests that count as actions, under their catalogue names; noise is dropped."""
    known = routes(requests.sparkSession).drop("label")
    joined = requests.join(known, ["method", "route"], "left")
    mutating = F.col("method").isin(*MUTATING)
    events = joined.select(
        "event_id", "at_ts", F.coalesce("ident_user", "meta_user").alias("username"),
        channel_of(F.col("channel_header"), F.col("ident_kind")).alias("channel"),
        F.coalesce("action", F.concat_ws(" ", F.lower("method"), "route")).alias("action"),
        F.coalesce("category", F.lit("Other")).alias("category"),
        F.coalesce("mode", F.when(mutating, "always").otherwise("nonweb")).alias("mode"),
        safe_label(F.col("tool_header")).alias("tool"), "status",
        F.coalesce((F.col("status") != 0) & (F.col("status") < 400), F.lit(False)).alias("ok"), "ms",
    )
    kept = (
        (F.col("mode") != "never")
        & ~((F.col("mode") == "nonweb") & (F.col("channel") == "web"))
        & (F.col("username").isNotNull() | F.col("action").isin(*ANONYMOUS_OK))
        & ~((F.col("action") == "auth.login") & (F.coalesce("status", F.lit(0)) >= 400))
    )
    return events.filter(kept).drop("mode")


def _json_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def safe_meta(meta: Column) -> Column:
    """Allowed keys whose value is a safe token or a number that is not a boolean."""
    bag = F.try_parse_json(meta)

    def pick(key: str) -> Column:
        node = F.try_variant_get(bag, f"$.{key}", "variant")
        kind = _json_kind(node)
        text = F.try_variant_get(bag, f"$.{key}", "string")
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        fine = ((kind == "STRING") & text.rlike(UI_SAFE_TOKEN)) | is_number
        return F.when(F.coalesce(fine, F.lit(False)), text)

    entries = F.array(*[F.struct(F.lit(k).alias("k"), pick(k).alias("v")) for k in UI_META_KEYS])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def scalar_meta(meta: Column) -> Column:
    """Only scalars are kept: null, boolean, number, and text of at most 80 characters."""
    bag = F.try_parse_json(meta).cast("map<string,variant>")

    def keep(_key: Column, node: Column) -> Column:
        kind = F.schema_of_variant(node)
        text = F.try_variant_get(node, "$", "string")
        scalar = kind.isin("VOID", "BOOLEAN", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return scalar | ((kind == "STRING") & (F.length(text) <= 80))

    return F.map_filter(bag, keep)


def bounded_time(client_time: Column, arrived: Column) -> Column:
    """The client's clock where it is close to arrival, else arrival: late rows are re-stamped, not dropped."""
    gap = F.abs(F.timestamp_diff("SECOND", client_time, arrived))
    return F.when(gap < UI_CLOCK_SECONDS, client_time).otherwise(arrived)


def browser_intake(
    reports: DataFrame, batch_max: int = UI_BATCH_MAX, hourly_max: int = UI_HOURLY_MAX
) -> DataFrame:
    """Accepted browser events: first of each batch, known actions, then the hourly cap per user.

    Both caps are row-number filters with a literal bound, which Spark
    pushes below the shuffle as a per-partition group limit.
    """
    batch = Window.partitionBy("user_id", "batch").orderBy("arrived_at", "event_id")
    hour = Window.partitionBy("user_id", F.date_trunc("hour", "arrived_at")).orderBy("arrived_at", "event_id")
    known = ui_actions(reports.sparkSession).drop("label")
    first = reports.withColumn("r", F.row_number().over(batch)).filter(F.col("r") <= batch_max)
    accepted = (
        first.join(known, "action").withColumn("r", F.row_number().over(hour)).filter(F.col("r") <= hourly_max)
    )
    client = F.timestamp_add("SECOND", F.col("clock_offset"), F.col("arrived_at"))
    return accepted.select(
        "event_id", "user_id", "action", "category",
        F.when(F.col("clock_offset").isNull(), F.col("arrived_at")).otherwise(
            bounded_time(client, F.col("arrived_at"))
        ).alias("at"),
        "arrived_at", safe_meta(F.col("meta")).alias("meta"),
    )


def meta_text(meta: Column) -> Column:
    pairs = F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(",", F.array_sort(pairs))


def bursts(events: DataFrame, key: str, ts: str, limit: int, window_seconds: int) -> DataFrame:
    """Fixed windows that open at the first event of a key and admit ``limit`` events.

    Where a window opens depends on the one before, which no SQL window can
    say.  Time is whole seconds, so rows are first counted per (key, second):
    a key then has at most one row per second of the period however many
    events it has.  A key is further cut wherever it was quiet for a whole
    window, since the next event opens a new one in any case.  The rest is one
    pass over sorted partitions that keeps two numbers per key.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    per_second = (
        events.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("string").alias("key"), F.timestamp_diff("SECOND", epoch, F.col(ts)).alias("sec"))
        .groupBy("key", "sec").agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("key").orderBy("sec")
    parts = per_second.withColumn(
        "fresh", (F.coalesce(F.col("sec") - F.lag("sec").over(order), F.lit(window_seconds)) >= window_seconds).cast("int")
    ).withColumn("part", F.sum("fresh").over(order))

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, start, seen, told = None, 0, 0, 0
        for pdf in batches:
            out = []
            for k, part, sec, n in zip(pdf["key"], pdf["part"], pdf["sec"], pdf["n"]):
                if (k, part) != group or sec - start >= window_seconds:
                    if group is not None:
                        out.append((group[0], start, seen, told))
                    group, start, seen, told = (k, part), sec, 0, 0
                told += min(int(n), max(0, limit - seen))
                seen += int(n)
            yield pd.DataFrame(out, columns=["key", "window_start", "events", "allowed"])
        if group is not None:
            yield pd.DataFrame([(group[0], start, seen, told)], columns=["key", "window_start", "events", "allowed"])

    windows = (
        parts.repartition("key", "part").sortWithinPartitions("key", "part", "sec").select("key", "part", "sec", "n")
        .mapInPandas(admit, "key string, window_start bigint, events bigint, allowed bigint")
    )
    return windows.withColumn("denied", F.col("events") - F.col("allowed"))


def shown_time(seconds: Column) -> Column:
    return iso(F.timestamp_seconds(seconds))
