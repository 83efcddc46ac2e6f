"""Ledgers on storage: day files in, day partitions out, retention, removal of a user, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.columns import whole
from faultline.operators.activity import EXPORT_FIELDS, export_rows
from faultline.operators.token_usage import clamp_days, days_with_user, retained, without_user
from faultline.sources import snapshots

ACTIVITY_SCHEMA = """at string, kind string, username string, role string, channel string, action string, category string, org_id string,
tool string, client string, status int, ok boolean, ms bigint, token_kind string,
meta struct<exceptions:bigint,size_kb:double,has_log:boolean,stored:boolean,parse_ms:bigint>"""

USAGE_SCHEMA = """at string, username string, chat_id string, org_id string, model string, provider string, source string, prompt_tokens string,
completion_tokens string, reasoning_tokens string, total_tokens string, cost string, cost_reported boolean, tool_calls string, tool_rounds string,
duration_ms string, ok boolean, error_code string"""

COUNTS = "prompt_tokens completion_tokens reasoning_tokens total_tokens tool_calls tool_rounds duration_ms".split()


def _dated(rows: DataFrame) -> DataFrame:
    at = F.try_to_timestamp("at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")
    return rows.withColumn("at_ts", at).withColumn("day", at.cast("date"))


def conform_usage(raw: DataFrame) -> DataFrame:
    """Numbers that cannot be read count as 0; fractions are cut."""
    rows = _dated(raw)
    for name in COUNTS:
        rows = rows.withColumn(name, whole(F.col(name)))
    return rows.withColumn("cost", F.coalesce(F.col("cost").try_cast("double"), F.lit(0.0)))


def conform_activity(raw: DataFrame) -> DataFrame:
    rows = _dated(raw)
    for name in ("exceptions", "size_kb", "has_log", "stored", "parse_ms"):
        rows = rows.withColumn(f"meta_{name}", F.col(f"meta.{name}"))
    return rows.drop("meta")


def read_days(spark: SparkSession, folder: str, schema: str, as_of: str, days: int | None = None) -> DataFrame:
    """Day files ``YYYY-MM-DD.jsonl`` of the window; unreadable lines are skipped.

    The window is a filter on the file name, so other days' files are not opened.
    """
    n = clamp_days(days)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(folder)
    end = F.lit(as_of).cast("date")
    name = F.col("_metadata.file_name")
    first = F.concat(F.date_format(F.date_sub(end, n - 1), "yyyy-MM-dd"), F.lit(".jsonl"))
    return rows.filter((name >= first) & (name <= F.concat(F.date_format(end, "yyyy-MM-dd"), F.lit(".jsonl"))))


TABLE = "ledger"


def append(rows: DataFrame, folder: str) -> None:
    """Add rows to their day partitions."""
    spark = rows.sparkSession
    state = snapshots.current(spark, folder)
    snapshots.commit(spark, state, state.parts + snapshots.add(state, TABLE, rows, folder, "day"), folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.read(spark, folder, TABLE)


def forget_user(spark: SparkSession, folder: str, username: str) -> int:
    """Rewrite only the days on which the user appears; the number of days touched.

    The days kept and the days emptied change in one commit: a run that breaks
    off before it leaves the ledger as it was.
    """
    state = snapshots.current(spark, folder)
    ledger = snapshots.read(spark, folder, TABLE, state)
    # a ledger has a few hundred days at most
    touched = {f"day={r['day']}" for r in days_with_user(ledger, username).collect()}
    if touched:
        kept = without_user(snapshots.read(spark, folder, TABLE, state, touched), username)
        written = snapshots.add(state, TABLE, kept, folder, "day")
        snapshots.commit(spark, state, [p for p in state.parts if p[2] not in touched] + written, folder)
    return len(touched)


def prune(spark: SparkSession, folder: str, as_of: str, keep_days: int = 365) -> list[str]:
    """Drop day partitions older than the retention, in one commit; the days dropped."""
    state = snapshots.current(spark, folder)
    days = spark.createDataFrame([(p[2].removeprefix("day="),) for p in state.parts], "name string").distinct().select(F.col("name").cast("date").alias("day"))
    old = days.join(retained(days, as_of, keep_days), "day", "left_anti")
    gone = sorted(str(r["day"]) for r in old.collect())
    if gone:
        snapshots.commit(spark, state, [p for p in state.parts if p[2].removeprefix("day=") not in gone], folder)
    return gone


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete what was forgotten and pruned from storage; the partition folders deleted."""
    return snapshots.vacuum(spark, folder)


def export_csv(rows: DataFrame, folder: str) -> None:
    """The fixed export columns with a header, ready for a spreadsheet."""
    export_rows(rows).select(*EXPORT_FIELDS).write.mode("overwrite").option("header", True).csv(folder)


