"""Executive summary: a window against the one before it, over both ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import day_text
from faultline.operators.activity import IS_MCP_CALL, IS_PARSE, conform, set_text
from faultline.operators.catalogue import action_label
from faultline.operators.token_usage import clamp_days, spine, window


def labelled(ledger: DataFrame, as_of: str, days: int, day: str = "day") -> DataFrame:
    """Both windows in one scan, each row told which one it is in."""
    n = clamp_days(days)
    rows = window(ledger, as_of, 2 * n) if "at_ts" in ledger.columns else ledger
    first = F.date_sub(F.lit(as_of).cast("date"), n - 1)
    return rows.withColumn("period", F.when(F.col(day) >= first, "current").otherwise("previous"))


def metrics(
    activity: DataFrame, usage: DataFrame, registry: DataFrame, users: DataFrame, as_of: str, days: int
) -> DataFrame:
    acts = conform(labelled(activity, as_of, days))
    llm = labelled(usage, as_of, days)
    act = F.col("kind") == "action"

    def good(condition: str) -> Column:
        return F.count_if(act & F.col("ok") & F.expr(condition))

    from_acts = acts.groupBy("period").agg(
        F.count_if(act).alias("actions"), F.count_if(act & ~F.col("ok")).alias("errors"),
        F.count_if(act & F.expr(IS_MCP_CALL)).alias("mcp_calls"),
        F.countDistinct(F.when(act & F.expr(IS_MCP_CALL), F.col("username"))).alias("mcp_users"),
        good("action LIKE 'kb.%'").alias("kb_lookups"), good(IS_PARSE).alias("logs_parsed"),
        F.coalesce(F.sum(F.when(act & F.col("ok") & F.expr(IS_PARSE), F.col("meta_exceptions"))), F.lit(0)).alias("exceptions_found"),
        good("action = 'incident.file'").alias("incidents_filed"),
        good("action = 'incident.resolve'").alias("resolutions"), good("action = 'org.refresh'").alias("org_refreshes"),
    )
    from_llm = llm.groupBy("period").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed_questions"),
        *[F.sum(c).alias(a) for c, a in (
            ("total_tokens", "tokens"), ("prompt_tokens", "prompt_tokens"), ("completion_tokens", "completion_tokens"),
            ("duration_ms", "duration"), ("tool_calls", "chat_tool_calls"))],
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.coalesce("cost_reported", F.lit(False))).alias("cost_turns"),
    )
    # users, days and orgs are unions over the two ledgers
    both = (
        acts.select("period", "username", "day", F.when(act, F.col("org_id")).alias("org_id"))
        .unionByName(llm.select("period", "username", "day", "org_id")).distinct()
    )
    accounts = registry.select("org_id", F.nullif("account", F.lit("")).alias("account"))
    unions = both.join(accounts, "org_id", "left").groupBy("period").agg(
        F.countDistinct("username").alias("active_users"), F.countDistinct("day").alias("active_days"),
        F.countDistinct("org_id").alias("orgs_worked_on"), F.countDistinct("account").alias("accounts_worked_on"),
    )

    def within(df: DataFrame, ago: str, name: str) -> DataFrame:
        n = clamp_days(days)
        period = F.when(F.col(ago) < n, "current").when(F.col(ago) < 2 * n, "previous")
        return df.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias(name))

    out = df_periods(activity)
    for part in (
        from_acts, from_llm, unions, within(registry, "onboarded_days_ago", "orgs_connected"),
        within(users, "created_days_ago", "new_users"),
    ):
        out = out.join(part, "period", "left")
    out = out.na.fill(0)
    q = F.nullif(F.col("questions"), F.lit(0))
    return out.select(
        "period", "questions", "failed_questions",
        F.bround((F.col("questions") - F.col("failed_questions")) / q * 100, 1).alias("answer_rate"),
        "tokens", "prompt_tokens", "completion_tokens",
        F.coalesce(F.bround(F.col("tokens") / q, 0), F.lit(0)).cast("bigint").alias("avg_tokens_per_question"),
        F.coalesce(F.bround(F.col("duration") / q / 1000, 1), F.lit(0.0)).alias("avg_answer_seconds"),
        "chat_tool_calls", F.bround("cost", 4).alias("cost"), (F.col("cost_turns") > 0).alias("cost_available"),
        "active_users", "active_days", "actions", "errors", "mcp_calls", "mcp_users", "kb_lookups", "logs_parsed",
        "exceptions_found", "incidents_filed", "resolutions", "orgs_worked_on", "accounts_worked_on",
        "orgs_connected", "org_refreshes", "new_users",
    )


def df_periods(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([("current",), ("previous",)], "period string")


DELTA_MEASURES = (
    "questions tokens active_users actions errors kb_lookups logs_parsed incidents_filed resolutions new_users"
).split()


def deltas(both: DataFrame, activity: DataFrame, usage: DataFrame, as_of: str, days: int) -> DataFrame:
    """Change against the window before; a window older than the ledgers is "no prior data", not zero."""
    prev_end = F.date_sub(F.lit(as_of).cast("date"), clamp_days(days))
    earliest = activity.select("day").unionByName(usage.select("day")).agg(F.min("day")).scalar()
    long = both.select(
        "period",
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in DELTA_MEASURES
        ])),
    )
    wide = long.groupBy("measure").agg(
        F.max(F.when(F.col("period") == "current", F.col("value"))).alias("current"),
        F.max(F.when(F.col("period") == "previous", F.col("value"))).alias("previous"),
    ).withColumn("previous_has_data", earliest <= prev_end)
    return wide.withColumn("pct", change_pct(F.col("current"), F.col("previous"))).select(
        "measure", "current", "previous", "previous_has_data",
        change_text(F.col("previous_has_data"), F.col("current"), F.col("previous"), F.col("pct")).alias("change"),
    )


def change_pct(cur: Column, prev: Column) -> Column:
    """Half-up percentage, as shown next to a figure."""
    return F.floor((cur - prev) / F.nullif(prev, F.lit(0.0)) * 100 + 0.5).cast("bigint")


def change_text(has_prev: Column, cur: Column, prev: Column, pct: Column) -> Column:
    return (
        F.when(~F.coalesce(has_prev, F.lit(False)), "no prior data")
        .when((cur == 0) & (prev == 0), "no change")
        .when(prev == 0, "new")
        .when(pct == 0, "no change")
        .when(pct > 0, F.concat(F.lit("up "), pct.cast("string"), F.lit("%")))
        .otherwise(F.concat(F.lit("down "), F.abs(pct).cast("string"), F.lit("%")))
    )


def inventory(registry: DataFrame, users: DataFrame) -> DataFrame:
    counts = F.aggregate(
        F.map_values("component_counts"), F.lit(0).cast("bigint"), lambda acc, v: acc + F.coalesce(v, F.lit(0))
    )
    account = F.nullif("account", F.lit(""))
    orgs = registry.agg(
        F.count(F.lit(1)).alias("orgs_total"), F.countDistinct(account).alias("accounts_total"),
        F.count_if(account.isNull()).alias("orgs_unassigned"), F.sum(counts).alias("components_indexed"),
    )
    enabled = ~F.coalesce(F.col("disabled"), F.lit(False))
    people = users.agg(
        F.count_if(enabled).alias("users_total"),
        F.count_if(enabled & F.coalesce("verified", F.lit(False))).alias("users_verified"),
    )
    return orgs.select(
        "*", people.select("users_total").scalar().alias("users_total"),
        people.select("users_verified").scalar().alias("users_verified"),
    )


def trend(activity: DataFrame, usage: DataFrame, as_of: str, days: int) -> DataFrame:
    acts = conform(window(activity, as_of, days))
    llm = window(usage, as_of, days)
    rows = acts.select(
        "day", "username", F.lit(0).alias("q"), F.lit(0).cast("bigint").alias("t"),
        (F.col("kind") == "action").cast("int").alias("a"),
    ).unionByName(llm.select("day", "username", F.lit(1).alias("q"), F.col("total_tokens").alias("t"), F.lit(0).alias("a")))
    per_day = rows.groupBy("day").agg(
        F.sum("q").alias("questions"), F.sum("t").alias("tokens"), F.sum("a").alias("actions"),
        F.countDistinct("username").alias("active_users"),
    )
    return spine(activity, as_of, days).join(per_day, "day", "left").na.fill(0).withColumn(
        "day", day_text(F.col("day"))
    ).orderBy("day")


def _combined(activity: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Rows of both ledgers on one layout, for per-org and per-person work."""
    acts = activity.filter(F.col(key).isNotNull()).select(
        key, *[c for c in ("username", "org_id") if c != key], "day", "shown_channel",
        F.lit(0).alias("q"), F.lit(0).cast("bigint").alias("t"),
        (F.col("kind") == "action").cast("int").alias("a"),
        ((F.col("kind") == "action") & F.col("ok") & (F.col("action") == "incident.file")).cast("int").alias("i"),
        ((F.col("kind") == "action") & F.col("ok") & F.expr(IS_PARSE)).cast("int").alias("l"),
        (F.col("kind") == "action").alias("is_action"),
    )
    llm = usage.filter(F.col(key).isNotNull()).select(
        key, *[c for c in ("username", "org_id") if c != key], "day", F.lit(None).cast("string").alias("shown_channel"),
        F.lit(1).alias("q"), F.col("total_tokens").alias("t"), F.lit(0).alias("a"), F.lit(0).alias("i"),
        F.lit(0).alias("l"), F.lit(False).alias("is_action"),
    )
    return acts.unionByName(llm)


def org_effort(activity: DataFrame, usage: DataFrame, registry: DataFrame) -> DataFrame:
    rows = _combined(activity.filter(F.col("kind") == "action"), usage, "org_id")
    out = rows.groupBy("org_id").agg(
        F.sum("q").alias("questions"), F.sum("t").alias("tokens"), F.sum("a").alias("actions"),
        F.sum("i").alias("incidents"), F.countDistinct("username").alias("users"),
    )
    return out.join(registry.select("org_id", F.col("name").alias("org_name"), "account"), "org_id", "left")


def top_orgs(effort: DataFrame, n: int = 8) -> DataFrame:
    return effort.orderBy(F.desc(F.col("questions") + F.col("actions")), F.desc("tokens"), "org_id").limit(n)


def top_accounts(effort: DataFrame, n: int = 8) -> DataFrame:
    """Rolled up from every org, not from the top ones."""
    rolled = effort.groupBy(F.coalesce(F.nullif("account", F.lit("")), F.lit("(unassigned)")).alias("account")).agg(
        F.count(F.lit(1)).alias("orgs"), *[F.sum(c).alias(c) for c in ("questions", "tokens", "actions", "incidents")]
    )
    return rolled.orderBy(F.desc(F.col("questions") + F.col("actions")), "account").limit(n)


def top_people(activity: DataFrame, usage: DataFrame, n: int = 10) -> DataFrame:
    rows = _combined(activity, usage, "username")
    best = rows.groupBy("username").agg(
        F.sum("q").alias("questions"), F.sum("t").alias("tokens"), F.sum("a").alias("actions"),
        F.sum("i").alias("incidents"), F.sum("l").alias("logs"), F.countDistinct("day").alias("active_days"),
    ).orderBy(F.desc(F.col("questions") + F.col("actions")), F.desc("tokens"), "username").limit(n)
    used = rows.filter("is_action").join(best.select("username"), "username", "left_semi")
    return best.join(set_text(used, ["username"], "shown_channel", "channels"), "username", "left").na.fill("", ["channels"])


def channel_mix(activity: DataFrame) -> DataFrame:
    return activity.filter(F.col("kind") == "action").groupBy(F.col("shown_channel").alias("channel")).agg(
        F.count(F.lit(1)).alias("events")
    )


def top_features(activity: DataFrame, n: int = 6) -> DataFrame:
    kept = activity.filter(
        (F.col("kind") == "action") & ~F.col("shown_action").startswith("auth.") & (F.col("shown_action") != "mcp.connect")
    )
    return kept.groupBy(F.col("shown_action").alias("action")).agg(F.count(F.lit(1)).alias("count")).withColumn(
        "label", action_label(F.col("action"))
    ).orderBy(F.desc("count"), "action").limit(n)


def top_models(usage: DataFrame, n: int = 5) -> DataFrame:
    return usage.groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(
        F.count(F.lit(1)).alias("questions"), F.sum("total_tokens").alias("tokens")
    ).orderBy(F.desc("tokens"), "model").limit(n)
