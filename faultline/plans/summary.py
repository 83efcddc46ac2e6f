"""Executive summary queries: the last 15 days against the 15 before."""

from pyspark.sql import functions as F

from faultline.operators import summary as s
from faultline.operators.activity import conform
from faultline.operators.token_usage import window
from faultline.plans.activity import LABELS, MCP_CALL, PARSE
from faultline.plans.registry import query
from faultline.sources.views import AS_OF, view

DAYS = 15
PERIOD = "CASE WHEN day >= DATE '2024-01-16' THEN 'current' ELSE 'previous' END"
A = f"""(SELECT *, coalesce(channel, 'web') AS ch, coalesce(kind, 'action') AS k, coalesce(ok, TRUE) AS fine, {PERIOD} AS period
  FROM <activity> a0 WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30')"""
U = f"(SELECT *, coalesce(ok, TRUE) AS fine, {PERIOD} AS period FROM <usage> u0 WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30')"


def _views(spark, root):
    return view(spark, root, "activity"), view(spark, root, "usage")


def _current(spark, root):
    a, u = _views(spark, root)
    return conform(window(a, AS_OF, DAYS)), window(u, AS_OF, DAYS)


def _good(cond):
    return f"sum(CASE WHEN k = 'action' AND fine AND ({cond}) THEN 1 ELSE 0 END)::BIGINT"


METRICS = f"""
SELECT p.period, questions, failed_questions, round_even((questions - failed_questions) / questions * 100, 1) AS answer_rate,
  tokens, prompt_tokens, completion_tokens, round_even(tokens / questions, 0)::BIGINT AS avg_tokens_per_question,
  round_even(duration / questions / 1000, 1) AS avg_answer_seconds, chat_tool_calls, round_even(cost, 4) AS cost, cost_turns > 0 AS cost_available,
  active_users, active_days, actions, errors, mcp_calls, mcp_users, kb_lookups, logs_parsed, exceptions_found, incidents_filed, resolutions,
  orgs_worked_on, accounts_worked_on,
  (SELECT count(*) FROM <registry> r WHERE onboarded_days_ago >= lo AND onboarded_days_ago < lo + 15) AS orgs_connected, org_refreshes,
  (SELECT count(*) FROM <users> r WHERE created_days_ago >= lo AND created_days_ago < lo + 15) AS new_users
FROM (VALUES ('current', 0), ('previous', 15)) p(period, lo)
LEFT JOIN (SELECT period, sum(CASE WHEN k = 'action' THEN 1 ELSE 0 END)::BIGINT AS actions, sum(CASE WHEN k = 'action' AND NOT fine THEN 1 ELSE 0 END)::BIGINT AS errors,
  sum(CASE WHEN k = 'action' AND {MCP_CALL} THEN 1 ELSE 0 END)::BIGINT AS mcp_calls, count(DISTINCT CASE WHEN k = 'action' AND {MCP_CALL} THEN username END) AS mcp_users,
  {_good("action LIKE 'kb.%'")} AS kb_lookups, {_good(PARSE)} AS logs_parsed,
  sum(CASE WHEN k = 'action' AND fine AND {PARSE} THEN meta_exceptions ELSE 0 END)::BIGINT AS exceptions_found,
  {_good("action = 'incident.file'")} AS incidents_filed, {_good("action = 'incident.resolve'")} AS resolutions, {_good("action = 'org.refresh'")} AS org_refreshes
  FROM {A} a GROUP BY 1) a ON a.period = p.period
LEFT JOIN (SELECT period, count(*) AS questions, sum(CASE WHEN fine THEN 0 ELSE 1 END)::BIGINT AS failed_questions, sum(total_tokens)::BIGINT AS tokens,
  sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(duration_ms)::BIGINT AS duration,
  sum(tool_calls)::BIGINT AS chat_tool_calls, sum(cost) AS cost, sum(CASE WHEN cost_reported THEN 1 ELSE 0 END) AS cost_turns FROM {U} u GROUP BY 1) u ON u.period = p.period
LEFT JOIN (SELECT period, count(DISTINCT username) AS active_users, count(DISTINCT day) AS active_days, count(DISTINCT b.org_id) AS orgs_worked_on,
  count(DISTINCT account) AS accounts_worked_on FROM (
    SELECT period, username, day, CASE WHEN k = 'action' THEN org_id END AS org_id FROM {A} a UNION SELECT period, username, day, org_id FROM {U} u) b
  LEFT JOIN <registry> g ON g.org_id = b.org_id GROUP BY 1) b ON b.period = p.period
"""


def _metrics(spark, root):
    a, u = _views(spark, root)
    return s.metrics(a, u, view(spark, root, "registry"), view(spark, root, "users"), AS_OF, DAYS)


@query("summary_metrics", METRICS)
def summary_metrics(spark, root):
    return _metrics(spark, root)


UNPIVOT = " UNION ALL ".join(f"SELECT period, '{m}' AS measure, {m}::DOUBLE AS value FROM m" for m in s.DELTA_MEASURES)


@query("summary_deltas", f"""
WITH m AS ({METRICS}), w AS (SELECT measure, max(CASE WHEN period = 'current' THEN value END) AS current, max(CASE WHEN period = 'previous' THEN value END) AS previous
  FROM ({UNPIVOT}) l GROUP BY 1),
e AS (SELECT *, TRUE AS previous_has_data, floor((current - previous) / nullif(previous, 0) * 100 + 0.5)::BIGINT AS pct FROM w)
SELECT measure, current, previous, previous_has_data, CASE WHEN NOT previous_has_data THEN 'no prior data' WHEN current = 0 AND previous = 0 THEN 'no change'
  WHEN previous = 0 THEN 'new' WHEN pct = 0 THEN 'no change' WHEN pct > 0 THEN concat('up ', pct, '%') ELSE concat('down ', abs(pct), '%') END AS change FROM e
""")
def summary_deltas(spark, root):
    a, u = _views(spark, root)
    return s.deltas(_metrics(spark, root), a, u, AS_OF, DAYS)


@query("summary_inventory", """
SELECT count(*) AS orgs_total, count(DISTINCT account) AS accounts_total, sum(CASE WHEN account IS NULL THEN 1 ELSE 0 END)::BIGINT AS orgs_unassigned,
  sum(n_classes + n_flows)::BIGINT AS components_indexed, (SELECT count(*) FROM <users> u WHERE NOT disabled) AS users_total,
  (SELECT count(*) FROM <users> u WHERE NOT disabled AND verified) AS users_verified FROM <registry> r
""")
def summary_inventory(spark, root):
    registry = view(spark, root, "registry").withColumn(
        "component_counts", F.create_map(F.lit("classes"), "n_classes", F.lit("flows"), "n_flows")
    )
    return s.inventory(registry, view(spark, root, "users"))


@query("summary_trend", f"""
SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(sum(q), 0)::BIGINT AS questions, coalesce(sum(t), 0)::BIGINT AS tokens,
  coalesce(sum(a), 0)::BIGINT AS actions, count(DISTINCT username) AS active_users
FROM (SELECT CAST(range AS DATE) AS day FROM range(DATE '2024-01-16', DATE '2024-01-31', INTERVAL 1 DAY)) d
LEFT JOIN (SELECT day, username, 0 AS q, 0 AS t, CASE WHEN k = 'action' THEN 1 ELSE 0 END AS a FROM {A} a
  UNION ALL SELECT day, username, 1, total_tokens, 0 FROM {U} u) x ON x.day = d.day GROUP BY d.day
""")
def summary_trend(spark, root):
    a, u = _views(spark, root)
    return s.trend(a, u, AS_OF, DAYS)


EFFORT = f"""SELECT x.org_id, sum(q)::BIGINT AS questions, sum(t)::BIGINT AS tokens, sum(a)::BIGINT AS actions, sum(i)::BIGINT AS incidents,
  count(DISTINCT username) AS users, max(g.name) AS org_name, max(g.account) AS account FROM (
  SELECT org_id, username, 0 AS q, 0 AS t, 1 AS a, CASE WHEN fine AND action = 'incident.file' THEN 1 ELSE 0 END AS i FROM {A} a
    WHERE period = 'current' AND k = 'action' AND org_id IS NOT NULL
  UNION ALL SELECT org_id, username, 1, total_tokens, 0, 0 FROM {U} u WHERE period = 'current' AND org_id IS NOT NULL) x
  LEFT JOIN <registry> g ON g.org_id = x.org_id GROUP BY 1"""


def _effort(spark, root):
    a, u = _current(spark, root)
    return s.org_effort(a, u, view(spark, root, "registry"))


@query("summary_top_orgs", f"SELECT * FROM ({EFFORT}) e ORDER BY questions + actions DESC, tokens DESC, org_id LIMIT 8")
def summary_top_orgs(spark, root):
    return s.top_orgs(_effort(spark, root))


@query("summary_top_accounts", f"""
SELECT coalesce(account, '(unassigned)') AS account, count(*) AS orgs, sum(questions)::BIGINT AS questions, sum(tokens)::BIGINT AS tokens,
  sum(actions)::BIGINT AS actions, sum(incidents)::BIGINT AS incidents FROM ({EFFORT}) e GROUP BY 1 ORDER BY sum(questions) + sum(actions) DESC, account LIMIT 8
""")
def summary_top_accounts(spark, root):
    return s.top_accounts(_effort(spark, root))


@query("summary_top_people", f"""
SELECT username, sum(q)::BIGINT AS questions, sum(t)::BIGINT AS tokens, sum(a)::BIGINT AS actions, sum(i)::BIGINT AS incidents, sum(l)::BIGINT AS logs,
  count(DISTINCT day) AS active_days, coalesce(string_agg(DISTINCT ch, ',' ORDER BY ch), '') AS channels FROM (
  SELECT username, day, 0 AS q, 0 AS t, CASE WHEN k = 'action' THEN 1 ELSE 0 END AS a, CASE WHEN k = 'action' AND fine AND action = 'incident.file' THEN 1 ELSE 0 END AS i,
    CASE WHEN k = 'action' AND fine AND {PARSE} THEN 1 ELSE 0 END AS l, CASE WHEN k = 'action' THEN ch END AS ch FROM {A} a WHERE period = 'current' AND username IS NOT NULL
  UNION ALL SELECT username, day, 1, total_tokens, 0, 0, 0, NULL FROM {U} u WHERE period = 'current' AND username IS NOT NULL) x
GROUP BY 1 ORDER BY sum(q) + sum(a) DESC, sum(t) DESC, username LIMIT 10
""")
def summary_top_people(spark, root):
    a, u = _current(spark, root)
    return s.top_people(a, u)


@query("summary_channel_mix", f"SELECT ch AS channel, count(*) AS events FROM {A} a WHERE period = 'current' AND k = 'action' GROUP BY 1")
def summary_channel_mix(spark, root):
    return s.channel_mix(_current(spark, root)[0])


@query("summary_top_features", f"""
SELECT action, count, coalesce(lt, action) AS label FROM (SELECT action, count(*) AS count FROM {A} a WHERE period = 'current' AND k = 'action'
  AND action NOT LIKE 'auth.%' AND action <> 'mcp.connect' GROUP BY 1) f LEFT JOIN {LABELS} ON la = action ORDER BY count DESC, action LIMIT 6
""")
def summary_top_features(spark, root):
    return s.top_features(_current(spark, root)[0])


@query("summary_top_models", f"""
SELECT coalesce(model, '(unknown)') AS model, count(*) AS questions, sum(total_tokens)::BIGINT AS tokens FROM {U} u WHERE period = 'current'
GROUP BY 1 ORDER BY tokens DESC, model LIMIT 5
""")
def summary_top_models(spark, root):
    return s.top_models(_current(spark, root)[1])
