"""Conversations: roll-up, redaction for sharing, grading of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TITLE = 80
USAGE_KEYS = ("prompt_tokens", "completion_tokens", "total_tokens", "cost")
LOG_REQUEST = r"(?i)debug\s*log|provide (a|the) log|share (a|the) log"


def title_of(text: Column) -> Column:
    """First line, spaces squeezed, cut with an ellipsis."""
    line = F.regexp_replace(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\r\n|\r|\n")[0], r"\s+", " ")
    line = F.when(line == "", "New conversation").otherwise(line)
    return F.when(F.length(line) > MAX_TITLE, F.concat(F.substring(line, 1, MAX_TITLE - 1), F.lit("…"))).otherwise(line)


def rollup(messages: DataFrame) -> DataFrame:
    """Counters and title per conversation."""
    said = F.col("role").isin("user", "assistant")
    question = F.when(F.col("role") == "user", F.col("turn"))
    return messages.groupBy("conv_id").agg(
        F.count_if(said).alias("message_count"), F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("tool_call_count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.bround(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        title_of(F.min_by("text", question)).alias("title"), F.max("turn").alias("last_turn"),
    )


def redacted(messages: DataFrame, include_tools: bool = False) -> DataFrame:
    """What an anonymous reader may see: no system rows; tool rows and arguments only when opted in."""
    hidden = F.col("role") == "system"
    if not include_tools:
        hidden = hidden | (F.col("role") == "tool")
    calls = F.transform("calls", lambda x: F.struct(
        x["id"].alias("id"), x["name"].alias("name"), x["ok"].alias("ok"), x["ms"].alias("ms"),
        (x["args"] if include_tools else F.lit(None).cast("string")).alias("args"),
    ))
    return messages.filter(~hidden).withColumn("calls", calls)


def grade(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases joined with their answers.

    ``cases``: case_id, must_mention, should_mention, decoys, must_call (name,
    args_contains), forbid_log_request.  ``answers``: case_id, answer, calls
    (name, args).  A decoy fails only when something expected is missing.
    """
    rows = cases.join(answers, "case_id", "left").withColumn("text", F.lower(F.coalesce("answer", F.lit(""))))

    def absent(names: str) -> Column:
        return F.filter(names, lambda n: ~F.contains(F.col("text"), F.lower(n)))

    calls = F.coalesce("calls", F.array().cast("array<struct<name:string,args:string>>"))
    rows = rows.withColumn("missing", absent("must_mention")).withColumn("calls", calls)
    uncalled = F.filter("must_call", lambda r: ~F.exists(
        "calls", lambda x: (x["name"] == r["name"]) & F.contains(F.lower(x["args"]), F.lower(F.coalesce(r["args_contains"], F.lit(""))))
    ))
    named = F.filter("decoys", lambda d: F.contains(F.col("text"), F.lower(d)))
    asked = F.col("forbid_log_request") & (F.size("missing") > 0) & F.coalesce(F.col("answer").rlike(LOG_REQUEST), F.lit(False))
    failures = F.size("missing") + F.size(uncalled) + F.when(F.size("missing") > 0, F.size(named)).otherwise(0) + asked.cast("int")
    warnings = F.size(absent("should_mention")) + F.when(F.size("missing") > 0, 0).otherwise(F.size(named))
    return rows.select("case_id", failures.cast("bigint").alias("failures"), warnings.cast("bigint").alias("warnings"), (failures == 0).alias("passed"))


def pass_rate(graded: DataFrame) -> DataFrame:
    return graded.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.bround(F.avg(F.col("passed").cast("int")) * 100, 1).alias("pass_rate")
    )
