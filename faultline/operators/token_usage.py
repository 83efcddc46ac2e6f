"""Token ledger: measures per user, organisation, model and day; quotas and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import day_text, ratio

DEFAULT_DAYS = 30

# fixed values: tokens per tier, and the length of the rolling window
TIERS = {
    "unverified": {"daily": 200_000, "monthly": 2_000_000},
    "verified": {"daily": 1_000_000, "monthly": 10_000_000},
}
WINDOW_DAYS = 30

SUMMED = (
    "prompt_tokens completion_tokens reasoning_tokens total_tokens tool_calls tool_rounds duration_ms"
).split()


def clamp_days(days: int | None) -> int:
    """Days asked for, at least one; a long period is honoured, never shortened."""
    return max(1, int(days or DEFAULT_DAYS))


def window(
    ledger: DataFrame, as_of: str, days: int | None = None, username: str | None = None,
    org_id: str | None = None, ts: str = "at_ts", skip: int = 0,
) -> DataFrame:
    """Rows of the last ``days`` UTC days, ``as_of`` included.

    The bounds are literals compared with the time column itself, so they
    reach the scan (and prune partitions where the ledger is split by day).
    """
    n = clamp_days(days)
    end = F.date_sub(F.lit(as_of).cast("date"), skip - 1).cast("timestamp_ntz")
    start = F.date_sub(F.lit(as_of).cast("date"), skip + n - 1).cast("timestamp_ntz")
    rows = ledger.filter((F.col(ts) >= start) & (F.col(ts) < end))
    if username is not None:
        rows = rows.filter(F.col("username") == username)
    if org_id is not None:
        rows = rows.filter(F.col("org_id") == org_id)
    return rows


def measures() -> list[Column]:
    out = [
        F.count(F.lit(1)).alias("turns"),
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed_turns"),
    ]
    out += [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMMED]
    out += [
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.coalesce("cost_reported", F.lit(False))).alias("cost_reported_turns"),
    ]
    return out


def finished(df: DataFrame) -> DataFrame:
    """Derived measures; ``cost_available`` tells "nothing spent" from "cannot say"."""
    return (
        df.withColumn("cost", F.bround("cost", 6))
        .withColumn("avg_tokens_per_turn", ratio(F.col("total_tokens"), F.col("turns"), 0).cast("bigint"))
        .withColumn("avg_seconds_per_turn", ratio(F.col("duration_ms"), F.col("turns"), 1, 1000.0))
        .withColumn("cost_available", F.col("cost_reported_turns") > 0)
    )


def report(ledger: DataFrame) -> DataFrame:
    """Totals and the user, organisation and model breakdowns from one pass."""
    rows = ledger.select(
        F.coalesce(F.nullif("username", F.lit("")), F.lit("(unknown)")).alias("username"),
        F.coalesce(F.nullif("org_id", F.lit("")), F.lit("(no org)")).alias("org_id"),
        F.coalesce(F.nullif("model", F.lit("")), F.lit("(unknown)")).alias("model"),
        *SUMMED, "cost", "cost_reported", "ok",
    )
    u, o, m = F.col("username"), F.col("org_id"), F.col("model")
    grouped = rows.groupingSets([[], [u], [o], [m]], u, o, m).agg(
        F.grouping_id().alias("gid"), *measures()
    )
    # grouping_id bits: username 4, org 2, model 1; set = rolled up
    dim = (
        F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "username")
        .when(F.col("gid") == 5, "org_id").otherwise("model")
    )
    return finished(
        grouped.withColumn("dimension", dim)
        .withColumn("member", F.coalesce("username", "org_id", "model", F.lit("all")))
        .drop("gid", "username", "org_id", "model")
    ).orderBy("dimension", F.desc("total_tokens"), "member")


def spine(df: DataFrame, as_of: str, days: int | None) -> DataFrame:
    """One row per day of the window, oldest first."""
    n = clamp_days(days)
    return df.sparkSession.range(n).select(
        F.date_sub(F.lit(as_of).cast("date"), F.lit(n - 1) - F.col("id").cast("int")).alias("day")
    )


def by_day(ledger: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    per_day = ledger.groupBy("day").agg(*measures())
    filled = spine(ledger, as_of, days).join(per_day, "day", "left").na.fill(0)
    return finished(filled).withColumn("day", day_text(F.col("day"))).orderBy("day")


def own_summaries(ledger: DataFrame) -> DataFrame:
    """Each user's own totals, days and models, in one pass."""
    rows = ledger.filter(F.col("username").isNotNull()).withColumn(
        "model", F.coalesce("model", F.lit("(unknown)"))
    )
    u, d, m = F.col("username"), F.col("day"), F.col("model")
    out = rows.groupingSets([[u], [u, d], [u, m]], u, d, m).agg(F.grouping_id().alias("gid"), *measures())
    part = F.when(F.col("gid") == 3, "totals").when(F.col("gid") == 1, "day").otherwise("model")
    return finished(
        out.withColumn("part", part)
        .withColumn("member", F.coalesce(day_text(F.col("day")), F.col("model"), F.lit("all")))
        .drop("gid", "day", "model")
    )


def effective_limits(users: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Caps that apply to each account; null means unlimited.

    An override that is present but blank or unreadable is unlimited too, so
    presence is a column of its own.
    """
    days = max(1, min(int(window_days), 90))
    admin = F.coalesce(F.col("role") == "admin", F.lit(False))
    vouched = F.col("created_by").isNotNull() & (F.col("created_by") != "self")
    old = F.col("created_by").isNull() & F.col("verified").isNull()
    tier = F.when(F.coalesce("verified", F.lit(False)) | vouched | old, "verified").otherwise("unverified")

    def cap(field: str) -> Column:
        number = F.col(f"{field}_override").try_cast("bigint")
        usual = F.when(F.col("tier") == "verified", TIERS["verified"][field]).otherwise(
            TIERS["unverified"][field]
        )
        value = F.when(F.col(f"has_{field}_override"), F.when(number > 0, number)).otherwise(usual)
        return F.when(~admin, value).cast("bigint")

    overridden = F.col("has_daily_override") | F.col("has_monthly_override")
    return users.withColumn("tier", tier).select(
        "username",
        F.when(admin, "admin").otherwise(F.col("tier")).alias("tier"),
        F.when(admin, "admin").when(overridden, "override").otherwise(F.col("tier")).alias("source"),
        cap("daily").alias("daily_limit"), cap("monthly").alias("window_limit"),
        F.lit(days).alias("window_days"),
    )


def quota_status(users: DataFrame, ledger: DataFrame, as_of: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Used, remaining and percent for both windows; failed turns count."""
    limits = effective_limits(users, window_days)
    days = max(1, min(int(window_days), 90))
    today = F.col("day") == F.lit(as_of).cast("date")
    used = (
        window(ledger, as_of, days).filter(F.col("username").isNotNull()).groupBy("username")
        .agg(
            F.sum(F.when(today, F.col("total_tokens")).otherwise(0)).alias("d"),
            F.sum("total_tokens").alias("w"),
        )
    )
    df = limits.join(used, "username", "left").na.fill(0, ["d", "w"])
    unlimited = F.col("daily_limit").isNull() & F.col("window_limit").isNull()
    for name, amount, cap in (("daily", "d", "daily_limit"), ("window", "w", "window_limit")):
        cap, amount = F.col(cap), F.col(amount)
        df = (
            df.withColumn(f"{name}_used", F.when(~unlimited, amount).cast("bigint"))
            .withColumn(f"{name}_remaining", F.greatest(F.lit(0), cap - amount).cast("bigint"))
            .withColumn(f"{name}_pct", F.bround(F.least(F.lit(100.0), amount * 100.0 / cap), 1))
            .withColumn(f"{name}_exceeded", F.coalesce(amount >= cap, F.lit(False)))
        )
    # greatest and remaining skip nulls, so a missing cap is put back
    df = df.withColumn("daily_remaining", F.when(F.col("daily_limit").isNotNull(), F.col("daily_remaining")))
    df = df.withColumn("window_remaining", F.when(F.col("window_limit").isNotNull(), F.col("window_remaining")))
    df = df.withColumn("daily_pct", F.when(F.col("daily_limit").isNotNull(), F.col("daily_pct")))
    df = df.withColumn("window_pct", F.when(F.col("window_limit").isNotNull(), F.col("window_pct")))
    tighter = F.when(F.col("daily_pct").isNull() & F.col("window_pct").isNull(), None).when(
        F.coalesce("window_pct", F.lit(-1.0)) > F.coalesce("daily_pct", F.lit(-1.0)), "window"
    ).otherwise("daily")
    return df.withColumn("unlimited", unlimited).withColumn("tighter", tighter).withColumn(
        "exceeded", F.col("daily_exceeded") | F.col("window_exceeded")
    ).drop("d", "w")


def turn_allowed(status: DataFrame) -> DataFrame:
    stopped = F.when(F.col("daily_exceeded"), "daily").when(F.col("window_exceeded"), "window")
    remedy = F.when(
        F.col("exceeded"),
        F.when(F.col("tier") == "unverified", "verify the account")
        .when(F.col("source") != "override", "raise the limit"),
    )
    return status.select(
        "username", (~F.col("exceeded")).alias("allowed"), stopped.alias("stopped_by"),
        remedy.alias("remedy"),
    )


def retained(ledger: DataFrame, as_of: str, keep_days: int = 365) -> DataFrame:
    """Rows that retention keeps; rows without a readable day are left alone."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), keep_days)
    return ledger.filter(F.col("day").isNull() | (F.col("day") >= cutoff))


def without_user(ledger: DataFrame, username: str) -> DataFrame:
    return ledger.filter(~F.col("username").eqNullSafe(F.lit(username)))


def days_with_user(ledger: DataFrame, username: str) -> DataFrame:
    return ledger.filter(F.col("username") == username).select("day").distinct()
