"""Token ledger queries."""

from pyspark.sql import functions as F

from faultline.functions.columns import day_text
from faultline.operators import token_usage as usage
from faultline.plans.registry import query
from faultline.sources.views import AS_OF, view

MEASURES = """
  count(*) AS turns, CAST(sum(CASE WHEN ok = FALSE THEN 1 ELSE 0 END) AS BIGINT) AS failed_turns,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(tool_rounds) AS BIGINT) AS tool_rounds,
  CAST(sum(duration_ms) AS BIGINT) AS duration_ms, round_even(coalesce(sum(cost), 0), 6) AS cost,
  CAST(sum(CASE WHEN cost_reported THEN 1 ELSE 0 END) AS BIGINT) AS cost_reported_turns,
  CAST(round_even(sum(total_tokens) / count(*), 0) AS BIGINT) AS avg_tokens_per_turn,
  round_even(sum(duration_ms) / count(*) / 1000, 1) AS avg_seconds_per_turn,
  sum(CASE WHEN cost_reported THEN 1 ELSE 0 END) > 0 AS cost_available
"""


@query("usage_report", f"""
SELECT 'total' AS dimension, 'all' AS member, {MEASURES} FROM <usage> u
UNION ALL SELECT 'username', coalesce(username, '(unknown)'), {MEASURES} FROM <usage> u GROUP BY 2
UNION ALL SELECT 'org_id', coalesce(org_id, '(no org)'), {MEASURES} FROM <usage> u GROUP BY 2
UNION ALL SELECT 'model', coalesce(model, '(unknown)'), {MEASURES} FROM <usage> u GROUP BY 2
""")
def usage_report(spark, root):
    return usage.report(usage.window(view(spark, root, "usage"), AS_OF))


@query("usage_by_day", f"""
WITH d AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '2023-12-27', DATE '2024-01-31', INTERVAL 1 DAY)),
m AS (SELECT day AS k, {MEASURES} FROM <usage> u GROUP BY day)
SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(turns, 0) AS turns, coalesce(failed_turns, 0) AS failed_turns,
  coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens,
  coalesce(reasoning_tokens, 0) AS reasoning_tokens, coalesce(total_tokens, 0) AS total_tokens,
  coalesce(tool_calls, 0) AS tool_calls, coalesce(tool_rounds, 0) AS tool_rounds, coalesce(duration_ms, 0) AS duration_ms,
  coalesce(cost, 0) AS cost, coalesce(cost_reported_turns, 0) AS cost_reported_turns,
  coalesce(avg_tokens_per_turn, 0) AS avg_tokens_per_turn, coalesce(avg_seconds_per_turn, 0) AS avg_seconds_per_turn,
  coalesce(cost_available, FALSE) AS cost_available
FROM d LEFT JOIN m ON d.day = m.k
""")
def usage_by_day(spark, root):
    # 35 days, so that the quiet days before the first event are seen to be filled
    return usage.by_day(usage.window(view(spark, root, "usage"), AS_OF, 35), AS_OF, 35)


@query("usage_own_summaries", f"""
SELECT username, 'totals' AS part, 'all' AS member, {MEASURES} FROM <usage> u WHERE username IS NOT NULL GROUP BY 1
UNION ALL SELECT username, 'day', strftime(day, '%Y-%m-%d'), {MEASURES} FROM <usage> u WHERE username IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT username, 'model', coalesce(model, '(unknown)'), {MEASURES} FROM <usage> u WHERE username IS NOT NULL GROUP BY 1, 3
""")
def usage_own_summaries(spark, root):
    return usage.own_summaries(usage.window(view(spark, root, "usage"), AS_OF))


LIMITS = """
SELECT username, role, CASE WHEN role = 'admin' THEN 'admin' ELSE t END AS tier,
  CASE WHEN role = 'admin' THEN 'admin' WHEN has_daily_override OR has_monthly_override THEN 'override' ELSE t END AS source,
  CAST(CASE WHEN role = 'admin' THEN NULL WHEN has_daily_override THEN TRY_CAST(daily_override AS BIGINT)
    WHEN t = 'verified' THEN 1000000 ELSE 200000 END AS BIGINT) AS daily_limit,
  CAST(CASE WHEN role = 'admin' THEN NULL WHEN has_monthly_override THEN TRY_CAST(monthly_override AS BIGINT)
    WHEN t = 'verified' THEN 10000000 ELSE 2000000 END AS BIGINT) AS window_limit
FROM (SELECT *, CASE WHEN coalesce(verified, FALSE) THEN 'verified' WHEN created_by <> 'self' THEN 'verified'
   WHEN created_by IS NULL AND verified IS NULL THEN 'verified' ELSE 'unverified' END AS t FROM <users> u) x
"""

STATUS = f"""
SELECT l.*, 30 AS window_days, daily_limit IS NULL AND window_limit IS NULL AS unlimited,
  CASE WHEN daily_limit IS NOT NULL OR window_limit IS NOT NULL THEN coalesce(d, 0) END AS daily_used,
  CASE WHEN daily_limit IS NOT NULL OR window_limit IS NOT NULL THEN coalesce(w, 0) END AS window_used,
  CASE WHEN daily_limit IS NOT NULL THEN greatest(0, daily_limit - coalesce(d, 0)) END AS daily_remaining,
  CASE WHEN window_limit IS NOT NULL THEN greatest(0, window_limit - coalesce(w, 0)) END AS window_remaining,
  CASE WHEN daily_limit IS NOT NULL THEN round_even(least(100.0::DOUBLE, coalesce(d, 0) * 100.0::DOUBLE / daily_limit), 1) END AS daily_pct,
  CASE WHEN window_limit IS NOT NULL THEN round_even(least(100.0::DOUBLE, coalesce(w, 0) * 100.0::DOUBLE / window_limit), 1) END AS window_pct,
  coalesce(coalesce(d, 0) >= daily_limit, FALSE) AS daily_exceeded, coalesce(coalesce(w, 0) >= window_limit, FALSE) AS window_exceeded
FROM ({LIMITS}) l LEFT JOIN (
  SELECT username AS un, CAST(sum(total_tokens) AS BIGINT) AS w,
    CAST(sum(CASE WHEN day = DATE '2024-01-30' THEN total_tokens ELSE 0 END) AS BIGINT) AS d
  FROM <usage> u GROUP BY 1) q ON l.username = q.un
"""


@query("quota_limits", f"SELECT username, tier, source, daily_limit, window_limit, 30 AS window_days FROM ({LIMITS}) l")
def quota_limits(spark, root):
    return usage.effective_limits(view(spark, root, "users"))


@query("quota_status", f"""
SELECT username, tier, source, daily_limit, window_limit, window_days, unlimited, daily_used, window_used, daily_remaining,
  window_remaining, daily_pct, window_pct, daily_exceeded, window_exceeded, daily_exceeded OR window_exceeded AS exceeded,
  CASE WHEN daily_pct IS NULL AND window_pct IS NULL THEN NULL WHEN coalesce(window_pct, -1) > coalesce(daily_pct, -1) THEN 'window' ELSE 'daily' END AS tighter
FROM ({STATUS}) s
""")
def quota_status(spark, root):
    return usage.quota_status(view(spark, root, "users"), view(spark, root, "usage"), AS_OF)


@query("turn_allowed", f"""
SELECT username, NOT (daily_exceeded OR window_exceeded) AS allowed,
  CASE WHEN daily_exceeded THEN 'daily' WHEN window_exceeded THEN 'window' END AS stopped_by,
  CASE WHEN daily_exceeded OR window_exceeded THEN CASE WHEN tier = 'unverified' THEN 'verify the account'
    WHEN source <> 'override' THEN 'raise the limit' END END AS remedy
FROM ({STATUS}) s
""")
def turn_allowed(spark, root):
    return usage.turn_allowed(quota_status(spark, root))


@query("ledger_window", """
SELECT coalesce(username, '-') AS username, coalesce(org_id, '-') AS org_id, count(*) AS n
FROM <usage> u WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1, 2
""")
def ledger_window(spark, root):
    rows = usage.window(view(spark, root, "usage"), AS_OF, 7)
    return rows.groupBy(
        F.coalesce("username", F.lit("-")).alias("username"), F.coalesce("org_id", F.lit("-")).alias("org_id")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("retention_keep", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS kept FROM <usage> u WHERE day >= DATE '2024-01-30' - 20 GROUP BY 1
""")
def retention_keep(spark, root):
    kept = usage.retained(view(spark, root, "usage"), AS_OF, 20)
    return kept.groupBy(day_text(F.col("day")).alias("day")).agg(F.count(F.lit(1)).alias("kept"))


@query("forget_user", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS kept, count(*) <> max(total) AS touched FROM (
  SELECT *, count(*) OVER (PARTITION BY day) AS total FROM <activity> a) x
WHERE username IS DISTINCT FROM 'user_7' GROUP BY 1
""")
def forget_user(spark, root):
    ledger = view(spark, root, "activity")
    touched = usage.days_with_user(ledger, "user_7").withColumn("touched", F.lit(True))
    kept = usage.without_user(ledger, "user_7").groupBy("day").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(touched, "day", "left").select(
        day_text(F.col("day")).alias("day"), "kept", F.coalesce("touched", F.lit(False)).alias("touched")
    )
