"""Event intake queries: classification, cleaning, caps, bursts."""

from pyspark.sql import functions as F

from faultline.functions.columns import iso, safe_label
from faultline.operators import event_intake as intake
from faultline.operators.catalogue import CATALOGUE, UI_ACTIONS
from faultline.plans.registry import query
from faultline.sources.views import view


def _values(text, n):
    rows = [r.split("|") for r in text.strip().splitlines()]
    cells = ["(" + ", ".join("'" + c.replace("'", "''") + "'" for c in r[:n]) + ")" for r in rows]
    return "(VALUES " + ", ".join(cells) + ")"


ROUTES = _values(CATALOGUE, 6) + " c(m, r, act, cat, lbl, md)"
UI = _values(UI_ACTIONS, 2) + " u(act, category)"
ISO = "'%Y-%m-%dT%H:%M:%SZ'"
CLEAN = "nullif(regexp_replace(substr(trim(tool_header), 1, 60), '[^A-Za-z0-9_.:/ ()@+-]', '', 'g'), '')"


@query("event_classification", f"""
SELECT * EXCLUDE (mode) FROM (SELECT event_id, strftime(at_ts, {ISO}) AS at, coalesce(ident_user, meta_user) AS username,
  CASE WHEN lower(trim(channel_header)) IN ('chat', 'mcp-remote', 'mcp-stdio') THEN lower(trim(channel_header))
       WHEN ident_kind IS NULL OR ident_kind = 'session' THEN 'web' ELSE 'api' END AS channel,
  coalesce(act, concat(lower(method), ' ', route)) AS action, coalesce(cat, 'Other') AS category,
  coalesce(md, CASE WHEN method IN ('POST', 'PUT', 'PATCH', 'DELETE') THEN 'always' ELSE 'nonweb' END) AS mode,
  {CLEAN} AS tool, status, coalesce(status < 400, FALSE) AS ok, ms FROM <requests> q LEFT JOIN {ROUTES} ON m = method AND r = route) e
WHERE mode <> 'never' AND NOT (mode = 'nonweb' AND channel = 'web') AND (username IS NOT NULL OR action = 'share.view')
  AND NOT (action = 'auth.login' AND coalesce(status, 0) >= 400)
""")
def event_classification(spark, root):
    out = intake.classify(view(spark, root, "requests"))
    return out.withColumn("at_ts", iso(F.col("at_ts"))).withColumnRenamed("at_ts", "at")


@query("label_cleaning", f"""
SELECT {CLEAN} AS label, count(*) AS n FROM <requests> q GROUP BY 1
""")
def label_cleaning(spark, root):
    return view(spark, root, "requests").groupBy(safe_label(F.col("tool_header")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("browser_intake", f"""
SELECT event_id, user_id, act AS action, category, strftime(CASE WHEN clock_offset IS NULL OR abs(clock_offset) >= 900 THEN arrived_at
    ELSE arrived_at + clock_offset * INTERVAL 1 SECOND END, {ISO}) AS at,
  concat_ws(',', CASE WHEN json_type(meta, '$.kind') = 'VARCHAR' THEN concat('kind=', meta ->> '$.kind') END,
    concat('value=', meta ->> '$.value'),
    CASE WHEN regexp_full_match(meta ->> '$.view', '[A-Za-z0-9_.:/ -]{{1,60}}') THEN concat('view=', meta ->> '$.view') END) AS meta
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY arrived_at, event_id) AS hr FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY arrived_at, event_id) AS br FROM <browser_events> b) x
  JOIN {UI} ON act = action WHERE br <= 50) y) z WHERE hr <= 600
""")
def browser_intake(spark, root):
    out = intake.browser_intake(view(spark, root, "browser_events"))
    return out.select(
        "event_id", "user_id", "action", "category", iso(F.col("at")).alias("at"), intake.meta_text(F.col("meta")).alias("meta")
    )


@query("browser_hourly_cap", f"""
SELECT user_id, strftime(batch, {ISO}) AS hour, count(*) AS accepted, max(total) AS reported FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY arrived_at, event_id) AS hr FROM (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, batch) AS total FROM <browser_events> b) x JOIN {UI} ON act = action) y) z WHERE hr <= 1 GROUP BY 1, 2
""")
def browser_hourly_cap(spark, root):
    # a cap of one, so that the rule is seen at work on events this sparse
    reports = view(spark, root, "browser_events")
    kept = intake.browser_intake(reports, hourly_max=1)
    hour = F.date_trunc("hour", "arrived_at")
    accepted = kept.groupBy("user_id", hour.alias("hour")).agg(F.count(F.lit(1)).alias("accepted"))
    reported = reports.groupBy("user_id", hour.alias("hour")).agg(F.count(F.lit(1)).alias("reported"))
    return accepted.join(reported, ["user_id", "hour"]).withColumn("hour", iso(F.col("hour")))


@query("scalar_meta", """
SELECT user_id, count(*) AS n, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS booleans, sum(len(json_keys(meta)))::BIGINT AS keys FROM <browser_events> b GROUP BY 1
""")
def scalar_meta(spark, root):
    kept = view(spark, root, "browser_events").withColumn("kept", intake.scalar_meta(F.col("meta")))
    is_bool = F.schema_of_variant(F.element_at("kept", "kind")) == "BOOLEAN"
    return kept.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_bool).alias("booleans"),
        F.sum(F.size(F.map_keys("kept"))).alias("keys"),
    )


@query("burst_windows", """
WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS key, floor(epoch(ts))::BIGINT AS sec, count(*) AS n FROM {events} GROUP BY 1, 2),
w AS (SELECT key, min(sec) AS a FROM s GROUP BY 1
  UNION ALL SELECT w.key, (SELECT min(s.sec) FROM s WHERE s.key = w.key AND s.sec >= w.a + 36000) FROM w WHERE w.a IS NOT NULL)
SELECT w.key, w.a AS window_start, sum(n)::BIGINT AS events, least(sum(n), 3)::BIGINT AS allowed, (sum(n) - least(sum(n), 3))::BIGINT AS denied
FROM w JOIN s ON s.key = w.key AND s.sec >= w.a AND s.sec < w.a + 36000 WHERE w.a IS NOT NULL GROUP BY 1, 2
""")
def burst_windows(spark, root):
    # three events in ten hours: the built-in buckets (20 a minute) never fill on events this sparse
    return intake.bursts(view(spark, root, "requests"), "user_id", "at_ts", 3, 36_000)
