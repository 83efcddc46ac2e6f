"""Activity ledger: the breakdowns of the activity report.

Every breakdown takes conformed ledger rows or their ``grain``, the one
pre-aggregate that all breakdowns of a report roll up; percentiles take the
``latencies`` beside it.  Distinct users, days and organisations stay exact, as
they are part of the grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.columns import day_text, iso
from faultline.functions.scan import nearest_rank
from faultline.operators.catalogue import CHANNELS, LADDER, MCP, action_label, channel_label
from faultline.operators.token_usage import spine


def conform(ledger: DataFrame) -> DataFrame:
    """Defaults of older records, applied once: kind, ok and the shown channel."""
    return (
        ledger.withColumn("kind", F.coalesce("kind", F.lit("action")))
        .withColumn("ok", F.coalesce("ok", F.lit(True)))
        .withColumn("username", F.nullif("username", F.lit("")))
        .withColumn("shown_channel", F.coalesce(F.nullif("channel", F.lit("")), F.lit("web")))
        .withColumn("shown_action", F.coalesce(F.nullif("action", F.lit("")), F.lit("?")))
    )


GRAIN = (
    "day hour username role org_id kind ok channel shown_channel action shown_action category tool client status meta_has_log"
).split()


def grain(rows: DataFrame) -> DataFrame:
    """Conformed rows counted by everything a breakdown tells apart, with the first and last event of each."""
    own = F.struct("at_ts", "event_id")
    counted = rows.withColumn("hour", F.hour("at_ts").cast("bigint")).groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(own).alias("first"), F.max(own).alias("last")
    )
    return counted.select(*GRAIN, "n_events", "first", "last")


def latencies(rows: DataFrame) -> DataFrame:
    """Histogram of the durations of each action and tool."""
    told = rows.filter(F.col("ms").isNotNull())
    return told.groupBy("kind", "shown_action", "tool", F.col("ms").cast("bigint").alias("ms")).agg(F.count(F.lit(1)).alias("n_events"))


def parses(rows: DataFrame) -> DataFrame:
    """Log parses counted by outcome, channel, user and duration."""
    fine = F.col("ok")
    size = F.when(fine, F.col("meta_size_kb"))
    return actions(rows).filter(IS_PARSE).groupBy("kind", "ok", "shown_channel", "username", "action", "meta_parse_ms").agg(
        F.count(F.lit(1)).alias("n_events"), _rows(fine & F.coalesce("meta_stored", F.lit(False))).alias("n_stored"),
        F.sum(size).alias("size_kb"), F.count(size).alias("n_sized"), F.max(size).alias("max_kb"),
        F.sum(F.when(fine, F.col("meta_exceptions"))).alias("n_exceptions"),
        _rows(fine & (F.coalesce("meta_exceptions", F.lit(0)) != 0)).alias("n_raised"),
    )


def counted(rows: DataFrame) -> DataFrame:
    """Ledger rows in the shape of the grain, each of one event; the grain itself passes."""
    if "n_events" in rows.columns:
        return rows
    own = F.struct("at_ts", "event_id")
    return rows.withColumn("hour", F.hour("at_ts").cast("bigint")).withColumn("n_events", F.lit(1).cast("bigint")).withColumn("first", own).withColumn("last", own)


def actions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == "action")


IS_ACTION = "kind = 'action'"
IS_MCP_CALL = "channel IN ('mcp-remote', 'mcp-stdio') AND action <> 'mcp.connect'"
IS_PARSE = "action = 'log.parse' OR (action = 'incident.file' AND coalesce(meta_has_log, false))"


def _rows(condition: Column) -> Column:
    return F.count_if(condition)


def _events() -> Column:
    return F.sum("n_events")


def _count(condition: str | Column) -> Column:
    """Events of which the condition holds."""
    held = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(F.sum(F.when(held, F.col("n_events"))), F.lit(0))


def _users(name: str = "users") -> Column:
    return F.countDistinct("username").alias(name)


def counter_text(df: DataFrame, keys: list[str], item: str, name: str) -> DataFrame:
    """``item`` counts per key as sorted ``item=n`` text.

    Grouped by (key, item) first: what is collected is one entry per distinct
    item, and the items counted here (channels) are a handful.
    """
    weighted = df if "n_events" in df.columns else df.withColumn("n_events", F.lit(1))
    per_item = weighted.groupBy(*keys, item).agg(_events().alias("__n"))
    entry = F.concat(F.col(item), F.lit("="), F.col("__n").cast("string"))
    return per_item.groupBy(*keys).agg(
        F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias(name)
    )


def set_text(df: DataFrame, keys: list[str], item: str, name: str) -> DataFrame:
    """Distinct values per key as sorted text, for items from a small fixed domain."""
    distinct = df.filter(F.col(item).isNotNull()).select(*keys, item).distinct()
    return distinct.groupBy(*keys).agg(
        F.concat_ws(",", F.array_sort(F.collect_list(item))).alias(name)
    )


def top_action(df: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent action per key; ties go to the one seen first."""
    per_action = counted(df).groupBy(*keys, "shown_action").agg(
        _events().alias("__n"), F.min("first").alias("__first")
    )
    ranked = per_action.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), "__first"))
    )
    return ranked.filter("__r = 1").select(*keys, F.col("shown_action").alias("top_action"))


def by_day_channel(rows: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    counts = [
        _count((F.col("kind") == "action") & (F.col("shown_channel") == c)).alias(c.replace("-", "_"))
        for c in CHANNELS
    ]
    per_day = counted(rows).groupBy("day").agg(
        _count(IS_ACTION).alias("events"), _users("active_users"), *counts
    )
    return (
        spine(rows, as_of, days).join(per_day, "day", "left").na.fill(0)
        .withColumn("day", day_text(F.col("day"))).orderBy("day")
    )


def by_channel(rows: DataFrame) -> DataFrame:
    out = actions(counted(rows)).groupBy(F.col("shown_channel").alias("channel")).agg(
        _events().alias("events"), _users(), _count(~F.col("ok")).alias("errors")
    )
    total = out.agg(F.sum("events").alias("t"))
    return out.select(
        "*", channel_label(F.col("channel")).alias("label"),
        F.bround(F.col("events") * 100.0 / total.scalar(), 1).alias("share_pct"),
    ).orderBy(F.desc("events"), "channel")


def features(rows: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Breakdown by action; ``times`` are the latencies beside a grain."""
    times, rows = latencies(rows) if times is None else times, counted(rows)
    first = F.struct("kind_rank", "first")
    r = rows.withColumn("kind_rank", F.when(F.col("kind") == "action", 0).otherwise(1))
    base = r.groupBy("shown_action").agg(
        F.min_by(F.coalesce("category", F.lit("Other")), first).alias("category"),
        F.min_by("kind", first).alias("kind"), _events().alias("count"), _users(),
        _count(~F.col("ok")).alias("errors"),
    )
    ranks = nearest_rank(times, ["shown_action"], "ms", {"p50_ms": 50, "p95_ms": 95}, weight="n_events")
    channels = counter_text(rows, ["shown_action"], "shown_channel", "channels")
    return (
        base.join(ranks, "shown_action", "left").join(channels, "shown_action", "left")
        .withColumn("label", action_label(F.col("shown_action")))
        .withColumnRenamed("shown_action", "action").orderBy(F.desc("count"), "action")
    )


def categories(rows: DataFrame) -> DataFrame:
    """Events go to their action's first-seen category, users to each row's own."""
    own = F.coalesce("category", F.lit("Other"))
    rows = counted(rows)
    first = F.struct(F.when(F.col("kind") == "action", 0).otherwise(1).alias("rank"), "first")
    counts = (
        rows.groupBy("shown_action")
        .agg(F.min_by(own, first).alias("category"), _events().alias("n"))
        .groupBy("category").agg(F.sum("n").alias("count"))
    )
    people = rows.filter(F.col("username").isNotNull()).groupBy(own.alias("category")).agg(_users())
    return counts.join(people, "category", "full").na.fill(0).orderBy(F.desc("count"), "category")


def tools(rows: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Breakdown by tool; ``times`` as for ``features``."""
    with_tool = F.coalesce("tool", F.lit("")) != ""
    times = actions(latencies(rows) if times is None else times).filter(with_tool)
    used = actions(counted(rows)).filter(with_tool)
    used = used.withColumn("shown", F.coalesce("channel", F.lit("?")))
    base = used.groupBy("tool").agg(
        _events().alias("calls"), _users(), _count(~F.col("ok")).alias("errors")
    )
    ranks = nearest_rank(times, ["tool"], "ms", {"p50_ms": 50, "p95_ms": 95}, weight="n_events")
    return base.join(ranks, "tool", "left").join(
        counter_text(used, ["tool"], "shown", "channels"), "tool", "left"
    ).orderBy(F.desc("calls"), "tool")


def clients(rows: DataFrame) -> DataFrame:
    used = actions(counted(rows)).filter(F.col("channel").isin(*MCP)).withColumn(
        "client", F.coalesce(F.nullif("client", F.lit("")), F.lit("(unidentified client)"))
    )
    base = used.groupBy("client").agg(
        _count("action <> 'mcp.connect'").alias("calls"), _count("action = 'mcp.connect'").alias("connects"),
        _users(), iso(F.max("last.at_ts")).alias("last_seen"),
    )
    return base.join(set_text(used, ["client"], "channel", "channels"), "client", "left").orderBy(
        F.desc("calls"), "client"
    )


def log_parser(rows: DataFrame) -> DataFrame:
    """Totals of log parses, from ledger rows or their ``parses``."""
    done = rows if "n_stored" in rows.columns else parses(rows)  # all of one kind, which serves as the key
    base = done.groupBy("kind").agg(
        _events().alias("parses"), _count(~F.col("ok")).alias("failed"), _users(), F.sum("n_stored").alias("stored"),
        _count("action = 'incident.file'").alias("via_incident"),
        F.bround(F.sum("size_kb") / 1024.0, 2).alias("total_mb"), F.bround(F.sum("size_kb") / F.sum("n_sized"), 1).alias("avg_kb"),
        F.max("max_kb").alias("max_kb"), F.coalesce(F.sum("n_exceptions"), F.lit(0)).alias("exceptions_found"), F.sum("n_raised").alias("logs_with_exceptions"),
    )
    ranks = nearest_rank(done.filter("ok"), ["kind"], "meta_parse_ms", {"p50_parse_ms": 50, "p95_parse_ms": 95}, weight="n_events")
    channels = counter_text(done, ["kind"], "shown_channel", "by_channel")
    return base.join(ranks, "kind", "left").join(channels, "kind", "left").drop("kind")


def llm_by_user(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.coalesce("username", F.lit("(unknown)")).alias("username")).agg(
        F.count(F.lit(1)).alias("llm_turns"), F.sum("total_tokens").alias("llm_tokens")
    )


def segment(has_chat: Column, has_mcp: Column, has_api: Column, llm_turns: Column) -> Column:
    uses_llm = has_chat | (llm_turns > 0)
    return (
        F.when(uses_llm & has_mcp, "AI chat + MCP")
        .when(has_mcp, "MCP only (no in-app LLM)")
        .when(uses_llm, "In-app AI chat")
        .when(has_api, "API scripts")
        .otherwise("Web UI only (no AI)")
    )


def users(rows: DataFrame, usage: DataFrame) -> DataFrame:
    """Per-user table: activity joined with token use, users of either side kept."""
    named = counted(rows).filter(F.col("username").isNotNull())
    act = F.col("kind") == "action"
    ui = F.col("kind") == "ui"

    def acts(condition: str) -> Column:
        return _count(act & F.expr(condition))

    # actions are read before browser rows, so a browser row's role is the later one
    last = F.struct(F.when(act, 0).otherwise(1).alias("rank"), "last")
    base = named.groupBy("username").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), last)).alias("role"),
        _count(act).alias("events"), _count(ui).alias("ui_events"),
        F.countDistinct("day").alias("active_days"),
        F.bool_or(act & (F.col("shown_channel") == "chat")).alias("has_chat"),
        F.bool_or(act & F.col("shown_channel").isin(*MCP)).alias("has_mcp"),
        F.bool_or(act & (F.col("shown_channel") == "api")).alias("has_api"),
        acts(IS_MCP_CALL).alias("mcp_calls"), acts("channel = 'chat'").alias("chat_tool_calls"),
        acts("action LIKE 'kb.%'").alias("kb_lookups"), acts(IS_PARSE).alias("logs_parsed"),
        acts("action = 'incident.file'").alias("incidents_filed"),
        acts("action = 'incident.resolve'").alias("resolutions"), acts("NOT ok").alias("errors"),
        F.countDistinct("org_id").alias("orgs"),
        F.countDistinct(F.when(act, F.col("client"))).alias("clients"),
        iso(F.min("first.at_ts")).alias("first_seen"), iso(F.max("last.at_ts")).alias("last_seen"),
    )
    own = actions(named)
    base = base.join(set_text(own, ["username"], "shown_channel", "channels"), "username", "left")
    base = base.join(top_action(own, ["username"]), "username", "left")
    llm = llm_by_user(usage).filter(F.col("username") != "(unknown)")
    out = base.join(llm, "username", "full")
    out = out.na.fill(0).na.fill(False).na.fill("", ["channels"])
    return out.select(
        "username", "role", "events", "ui_events", "active_days", "channels",
        segment(F.col("has_chat"), F.col("has_mcp"), F.col("has_api"), F.col("llm_turns")).alias("segment"),
        "llm_turns", "llm_tokens", "mcp_calls", "chat_tool_calls", "kb_lookups", "logs_parsed",
        "incidents_filed", "resolutions", "errors", "top_action",
        action_label(F.col("top_action")).alias("top_action_label"), "clients", "orgs", "first_seen", "last_seen",
        "has_chat",
    )


def segments(user_rows: DataFrame) -> DataFrame:
    out = user_rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("users"), F.sum("events").alias("events")
    )
    total = out.agg(F.sum("users")).scalar()
    return out.withColumn("share_pct", F.bround(F.col("users") * 100.0 / total, 1)).orderBy(
        F.desc("users"), "segment"
    )


def ladder(rows: DataFrame) -> DataFrame:
    """Distinct users reaching each step; failed actions do not count, browser rows make a user active."""
    good = rows.filter(F.col("username").isNotNull() & ((F.col("kind") == "ui") | F.col("ok")))
    act = F.col("kind") == "action"
    flags = good.groupBy("username").agg(
        F.lit(True).alias("active"),
        F.bool_or(act & F.col("action").startswith("kb.")).alias("kb"),
        F.bool_or(act & (F.col("action") == "log.parse")).alias("log"),
        F.bool_or(act & (F.col("action") == "incident.file")).alias("incident"),
        F.bool_or(act & (F.col("action") == "incident.resolve")).alias("resolve"),
    )
    sums = flags.agg(*[F.count_if(s).alias(s) for s in LADDER])
    steps = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("step"), F.lit(label).alias("label"), F.col(s).alias("users"))
        for i, (s, label) in enumerate(LADDER.items(), 1)
    ])
    return sums.select(F.inline(steps)).orderBy("position")


def orgs(rows: DataFrame, registry: DataFrame) -> DataFrame:
    own = actions(counted(rows)).filter(F.col("org_id").isNotNull())
    base = own.groupBy("org_id").agg(
        _events().alias("events"), _users(), _count("action = 'incident.file'").alias("incidents"),
        iso(F.max("last.at_ts")).alias("last_seen"),
    )
    names = registry.select("org_id", F.col("name").alias("org_name"), "account")
    return (
        base.join(counter_text(own, ["org_id"], "shown_channel", "channels"), "org_id", "left")
        .join(top_action(own, ["org_id"]), "org_id", "left").join(names, "org_id", "left")
        .orderBy(F.desc("events"), "org_id")
    )


def accounts(org_rows: DataFrame) -> DataFrame:
    return org_rows.groupBy(F.coalesce(F.nullif("account", F.lit("")), F.lit("(unassigned)")).alias("account")).agg(
        F.sum("events").alias("events"), F.count(F.lit(1)).alias("orgs"), F.sum("incidents").alias("incidents")
    ).orderBy(F.desc("events"), "account")


def hours(rows: DataFrame) -> DataFrame:
    per_hour = actions(counted(rows)).groupBy("hour").agg(_events().alias("events"))
    clock = rows.sparkSession.range(24).withColumnRenamed("id", "hour")
    return clock.join(per_hour, "hour", "left").na.fill(0).orderBy("hour")


def errors(rows: DataFrame) -> DataFrame:
    bad = actions(counted(rows)).filter(~F.col("ok"))
    base = bad.groupBy("action", "status").agg(_events().alias("count"), _users())
    channels = counter_text(bad, ["action", "status"], "shown_channel", "channels")
    return (
        base.join(channels, ["action", "status"], "left")
        .withColumn("label", action_label(F.col("action"))).orderBy(F.desc("count"), "action", "status")
    )


def totals(rows: DataFrame, usage: DataFrame) -> DataFrame:
    rows = counted(rows)
    act = F.col("kind") == "action"

    def acts(condition: str) -> Column:
        return _count(act & F.expr(condition))

    base = rows.agg(
        _count(act).alias("actions"), _count(F.col("kind") == "ui").alias("ui_events"),
        _users("active_users"), F.countDistinct("day").alias("active_days"),
        acts("NOT ok").alias("errors"), acts(IS_MCP_CALL).alias("mcp_calls"),
        acts("channel = 'chat'").alias("chat_tool_calls"), acts(IS_PARSE).alias("logs_parsed"),
        acts("action = 'incident.file' AND ok").alias("incidents_filed"),
        acts("action = 'incident.resolve' AND ok").alias("resolutions"),
        acts("action LIKE 'kb.%'").alias("kb_lookups"),
    )
    # users who acted, without chat and without a turn of their own
    silent = rows.filter(act & F.col("username").isNotNull()).groupBy("username").agg(F.bool_or(F.col("shown_channel") == "chat").alias("has_chat"))
    quiet = silent.filter("NOT has_chat").join(usage.filter("username IS NOT NULL"), "username", "left_anti").agg(F.count(F.lit(1))).scalar()
    turns = usage.agg(F.count(F.lit(1))).scalar()
    return base.select("*", turns.alias("llm_turns"), quiet.alias("non_llm_users"))


def recent(rows: DataFrame, n: int = 100) -> DataFrame:
    return rows.orderBy(F.desc("at_ts"), F.desc("event_id")).limit(n).select(
        iso(F.col("at_ts")).alias("at"), "event_id", "username", "channel", "action",
        action_label(F.col("action")).alias("label"), "category", "org_id", "tool", "client", "ok", "status", "ms", "kind",
    )


def own_report(rows: DataFrame, usage: DataFrame, username: str) -> DataFrame:
    mine = rows.filter(F.col("username") == username)
    return users(mine, usage.filter(F.col("username") == username)).drop("has_chat")


EXPORT_FIELDS = (
    "at kind username role channel action category org_id tool client status ok ms token_kind meta"
).split()


def export_rows(rows: DataFrame) -> DataFrame:
    """Fixed columns as text; a leading formula sign gets a quote mark."""
    meta = F.to_json(
        F.struct(
            F.col("meta_exceptions").alias("exceptions"), F.col("meta_has_log").alias("has_log"),
            F.col("meta_stored").alias("stored"), F.col("meta_parse_ms").alias("parse_ms"),
        )
    )
    flat = rows.withColumn("at", iso(F.col("at_ts"))).withColumn("meta", meta)

    def guarded(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text).alias(name)

    return flat.select("event_id", *[guarded(c) for c in EXPORT_FIELDS])
