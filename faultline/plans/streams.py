"""Streaming queries: the given tables arrive as streams; results equal the batch jobs'."""

from pyspark.sql import functions as F

from faultline.functions.columns import day_text, iso
from faultline.operators import activity, incidents
from faultline.operators.token_usage import WINDOW_DAYS
from faultline.plans.event_intake import UI
from faultline.plans.incidents import SIGNED
from faultline.plans.registry import query
from faultline.sources.views import AS_OF, VIEWS, _nest, _spark_text, view
from faultline.streaming import intake

ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def stream_view(spark, root, name, table):
    """A one-table view over the stream of its table."""
    return spark.sql(_spark_text(_nest(VIEWS[name])), **{table: intake.table_stream(spark, root, table)})


@query("stream_ledger", """
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(kind, 'action') AS kind, count(*) AS events, count(DISTINCT username) AS users FROM <activity> a GROUP BY 1, 2
""")
def stream_ledger(spark, root):
    rows = activity.conform(stream_view(spark, root, "activity", "events"))
    ledger = intake.to_ledger(rows, intake.fresh_folder(spark, "ledger"))
    return ledger.groupBy(day_text(F.col("day")).alias("day"), "kind").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("username").alias("users")
    )


@query("stream_daily_trend", """
SELECT strftime(day, '%Y-%m-%d') AS day, sum(CASE WHEN coalesce(kind, 'action') = 'action' THEN 1 ELSE 0 END)::BIGINT AS actions, count(DISTINCT username) AS active_users FROM <activity> a GROUP BY 1
""")
def stream_daily_trend(spark, root):
    rows = activity.conform(stream_view(spark, root, "activity", "events"))
    return intake.daily_trend(rows, intake.fresh_folder(spark, "trend")).withColumn("day", day_text(F.col("day")))


@query("stream_quota", """
SELECT username, coalesce(sum(CASE WHEN day = DATE '2024-01-30' THEN total_tokens END), 0)::BIGINT AS today, sum(total_tokens)::BIGINT AS window FROM <usage> u WHERE username IS NOT NULL GROUP BY 1
""")
def stream_quota(spark, root):
    per_day = intake.daily_tokens(stream_view(spark, root, "usage", "events"), intake.fresh_folder(spark, "quota"))
    return intake.rolling_tokens(per_day, AS_OF, WINDOW_DAYS)


@query("stream_recurrence", f"""
SELECT org_id, signature, strftime(min(filed_at), {ISO}) AS first_seen, strftime(max(filed_at), {ISO}) AS last_seen, arg_max(incident_id, (filed_at, incident_id)) AS latest_incident, count(*) AS occurrences,
  arg_min(struct_pack(k := kind), (filed_at, s.incident_id)).k AS first_kind, arg_min(struct_pack(k := exc_type), (filed_at, s.incident_id)).k AS first_exc_type, arg_min(struct_pack(k := message), (filed_at, s.incident_id)).k AS first_message,
  arg_max(resolution, (resolved_at, s.incident_id)) FILTER (resolution IS NOT NULL) AS resolution
FROM {SIGNED} s LEFT JOIN (SELECT incident_id AS rid, resolution, resolved_at FROM <resolutions> r0) r ON rid = s.incident_id WHERE signature IS NOT NULL GROUP BY 1, 2
""")
def stream_recurrence(spark, root):
    rows = incidents.signed(stream_view(spark, root, "incidents", "orders"))
    out = intake.recurrence(rows, intake.fresh_folder(spark, "recurrence"))
    resolved = incidents.signed(view(spark, root, "incidents")).join(view(spark, root, "resolutions"), "incident_id")
    out = intake.with_resolutions(out, resolved).drop("resolution_recorded_at")
    return out.withColumn("first_seen", iso(F.col("first_seen"))).withColumn("last_seen", iso(F.col("last_seen")))


@query("stream_hourly_cap", f"""
SELECT user_id, strftime(batch, {ISO}) AS hour, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY arrived_at, event_id) AS r
  FROM <browser_events> b JOIN {UI} ON act = action) x WHERE r <= 1
""")
def stream_hourly_cap(spark, root):
    rows = stream_view(spark, root, "browser_events", "events")
    out = intake.hourly_cap(rows, intake.fresh_folder(spark, "cap"), cap=1)
    return out.select("user_id", iso(F.col("hour")).alias("hour"), "event_id")


@query("stream_burst_windows", """
WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS key, floor(epoch(ts))::BIGINT AS sec, count(*) AS n FROM {events} GROUP BY 1, 2),
w AS (SELECT key, min(sec) AS a FROM s GROUP BY 1
  UNION ALL SELECT w.key, (SELECT min(s.sec) FROM s WHERE s.key = w.key AND s.sec >= w.a + 36000) FROM w WHERE w.a IS NOT NULL)
SELECT w.key, w.a AS window_start, sum(n)::BIGINT AS events, least(sum(n), 3)::BIGINT AS allowed, (sum(n) - least(sum(n), 3))::BIGINT AS denied
FROM w JOIN s ON s.key = w.key AND s.sec >= w.a AND s.sec < w.a + 36000 WHERE w.a IS NOT NULL GROUP BY 1, 2
""")
def stream_burst_windows(spark, root):
    events = intake.table_stream(spark, root, "events")
    return intake.burst_windows(events, "user_id", "ts", 3, 36_000, intake.fresh_folder(spark, "bursts"))
