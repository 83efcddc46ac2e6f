"""Activity report queries."""

from pyspark.sql import functions as F

from faultline.operators import activity as act
from faultline.operators import token_usage
from faultline.operators.catalogue import CHANNELS, action_labels
from faultline.plans.registry import query
from faultline.session import cut_lineage
from faultline.sources.views import AS_OF, view

# the conformed ledger, for check SQL
A = """(SELECT *, coalesce(channel, 'web') AS ch, coalesce(kind, 'action') AS k, coalesce(ok, TRUE) AS fine FROM <activity> a0)"""


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


LABELS = "(VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(t)})" for a, t in action_labels().items()) + ") lab(la, lt)"
CHANNEL_LABELS = "(VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(t)})" for a, t in CHANNELS.items()) + ") cl(cc, ct)"
ISO = "'%Y-%m-%dT%H:%M:%SZ'"
MCP_CALL = "channel IN ('mcp-remote', 'mcp-stdio') AND action <> 'mcp.connect'"
PARSE = "(action = 'log.parse' OR (action = 'incident.file' AND meta_has_log))"


def rows(spark, root, days=None):
    return act.conform(token_usage.window(view(spark, root, "activity"), AS_OF, days))


def grain(spark, root):
    """The pre-aggregate that the breakdowns of more than one list roll up."""
    return cut_lineage(act.grain(rows(spark, root)))


def usage_rows(spark, root):
    return token_usage.window(view(spark, root, "usage"), AS_OF)


def counter(source, keys, item, where="TRUE"):
    """SQL for ``item=n`` text per key."""
    k = ", ".join(keys)
    return f"""(SELECT {k}, string_agg(e, ',' ORDER BY e) AS txt FROM (
      SELECT {k}, concat({item}, '=', count(*)) AS e FROM {source} s WHERE {where} GROUP BY {k}, {item}) q GROUP BY {k})"""


def ranks(source, key, value, where="TRUE"):
    return f"""(SELECT {key} AS pk, min(CASE WHEN i = i50 THEN v END) AS p50, min(CASE WHEN i = i95 THEN v END) AS p95 FROM (
      SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS i,
        CAST(round_even(0.5::DOUBLE * (count(*) OVER (PARTITION BY {key}) - 1), 0) AS BIGINT) AS i50,
        CAST(round_even(0.95::DOUBLE * (count(*) OVER (PARTITION BY {key}) - 1), 0) AS BIGINT) AS i95
      FROM {source} s WHERE {value} IS NOT NULL AND {where}) r GROUP BY {key})"""


def tops(source, key, where):
    return f"""(SELECT {key} AS tk, action AS top_action FROM (SELECT {key}, action, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, f1, f2) AS r FROM (
      SELECT {key}, action, count(*) AS n, min(at_ts) AS f1, arg_min(event_id, at_ts) AS f2 FROM {source} s WHERE {where} GROUP BY 1, 2) q) q2 WHERE r = 1)"""


CHANNEL_COUNTS = ", ".join(
    f"coalesce(sum(CASE WHEN k = 'action' AND ch = '{c}' THEN 1 ELSE 0 END), 0)::BIGINT AS {c.replace('-', '_')}" for c in CHANNELS
)


@query("activity_by_day", f"""
SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(sum(CASE WHEN k = 'action' THEN 1 ELSE 0 END), 0)::BIGINT AS events,
  count(DISTINCT username) AS active_users, {CHANNEL_COUNTS}
FROM (SELECT CAST(range AS DATE) AS day FROM range(DATE '2023-12-27', DATE '2024-01-31', INTERVAL 1 DAY)) d
LEFT JOIN {A} a ON a.day = d.day GROUP BY d.day
""")
def activity_by_day(spark, root):
    return act.by_day_channel(rows(spark, root, 35), AS_OF, 35)


@query("activity_by_channel", f"""
SELECT ch AS channel, count(*) AS events, count(DISTINCT username) AS users, sum(CASE WHEN fine THEN 0 ELSE 1 END)::BIGINT AS errors,
  max(ct) AS label, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share_pct
FROM {A} a LEFT JOIN {CHANNEL_LABELS} ON cc = ch WHERE k = 'action' GROUP BY ch
""")
def activity_by_channel(spark, root):
    return act.by_channel(rows(spark, root))


FIRST = "(CASE WHEN k = 'action' THEN 0 ELSE 1 END, at_ts, event_id)"


@query("activity_features", f"""
SELECT action, category, kind, count, users, errors, p50 AS p50_ms, p95 AS p95_ms, txt AS channels, coalesce(lt, action) AS label FROM (
  SELECT action, arg_min(coalesce(category, 'Other'), {FIRST}) AS category, arg_min(k, {FIRST}) AS kind, count(*) AS count,
    count(DISTINCT username) AS users, sum(CASE WHEN fine THEN 0 ELSE 1 END)::BIGINT AS errors FROM {A} a GROUP BY action) b
LEFT JOIN {ranks(A, 'action', 'ms')} r ON r.pk = b.action
LEFT JOIN {counter(A, ['action'], 'ch')} c USING (action)
LEFT JOIN {LABELS} ON la = action
""")
def activity_features(spark, root):
    return act.features(grain(spark, root), act.latencies(rows(spark, root)))


@query("activity_categories", f"""
SELECT coalesce(c.category, u.category) AS category, coalesce(count, 0)::BIGINT AS count, coalesce(users, 0) AS users FROM (
  SELECT category, sum(n) AS count FROM (SELECT action, arg_min(coalesce(category, 'Other'), {FIRST}) AS category, count(*) AS n FROM {A} a GROUP BY 1) q GROUP BY 1) c
FULL JOIN (SELECT coalesce(category, 'Other') AS category, count(DISTINCT username) AS users FROM {A} a WHERE username IS NOT NULL GROUP BY 1) u
ON c.category = u.category
""")
def activity_categories(spark, root):
    return act.categories(grain(spark, root))


TOOLS = f"(SELECT *, coalesce(channel, '?') AS shown FROM {A} a1 WHERE k = 'action' AND tool IS NOT NULL)"


@query("activity_tools", f"""
SELECT b.*, p50 AS p50_ms, p95 AS p95_ms, txt AS channels FROM (
  SELECT tool, count(*) AS calls, count(DISTINCT username) AS users, sum(CASE WHEN fine THEN 0 ELSE 1 END)::BIGINT AS errors FROM {TOOLS} a GROUP BY tool) b
LEFT JOIN {ranks(TOOLS, 'tool', 'ms')} r ON r.pk = b.tool LEFT JOIN {counter(TOOLS, ['tool'], 'shown')} c USING (tool)
""")
def activity_tools(spark, root):
    return act.tools(grain(spark, root), act.latencies(rows(spark, root)))


@query("activity_clients", f"""
SELECT coalesce(client, '(unidentified client)') AS client, sum(CASE WHEN action <> 'mcp.connect' THEN 1 ELSE 0 END)::BIGINT AS calls,
  sum(CASE WHEN action = 'mcp.connect' THEN 1 ELSE 0 END)::BIGINT AS connects, count(DISTINCT username) AS users,
  strftime(max(at_ts), {ISO}) AS last_seen, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels
FROM {A} a WHERE k = 'action' AND channel IN ('mcp-remote', 'mcp-stdio') GROUP BY 1
""")
def activity_clients(spark, root):
    return act.clients(grain(spark, root))


PARSES = f"(SELECT *, 1 AS one FROM {A} a1 WHERE k = 'action' AND {PARSE})"


@query("activity_log_parser", f"""
SELECT count(*) AS parses, sum(CASE WHEN fine THEN 0 ELSE 1 END)::BIGINT AS failed, count(DISTINCT username) AS users,
  sum(CASE WHEN fine AND meta_stored THEN 1 ELSE 0 END)::BIGINT AS stored, sum(CASE WHEN action = 'incident.file' THEN 1 ELSE 0 END)::BIGINT AS via_incident,
  round_even(sum(CASE WHEN fine THEN meta_size_kb END) / 1024, 2) AS total_mb, round_even(avg(CASE WHEN fine THEN meta_size_kb END), 1) AS avg_kb,
  max(CASE WHEN fine THEN meta_size_kb END) AS max_kb, sum(CASE WHEN fine THEN meta_exceptions ELSE 0 END)::BIGINT AS exceptions_found,
  sum(CASE WHEN fine AND meta_exceptions > 0 THEN 1 ELSE 0 END)::BIGINT AS logs_with_exceptions,
  max(p50) AS p50_parse_ms, max(p95) AS p95_parse_ms, max(txt) AS by_channel
FROM {PARSES} a LEFT JOIN {ranks(PARSES, 'one', 'meta_parse_ms', 'fine')} r ON TRUE LEFT JOIN {counter(PARSES, ['one'], 'ch')} c ON TRUE
""")
def activity_log_parser(spark, root):
    return act.log_parser(cut_lineage(act.parses(rows(spark, root))))


@query("activity_llm_by_user", """
SELECT coalesce(username, '(unknown)') AS username, count(*) AS llm_turns, sum(total_tokens)::BIGINT AS llm_tokens FROM <usage> u GROUP BY 1
""")
def activity_llm_by_user(spark, root):
    return act.llm_by_user(usage_rows(spark, root))


def users_sql(where="TRUE"):
    named = f"(SELECT * FROM {A} a1 WHERE username IS NOT NULL AND {where})"

    def n(cond):
        return f"coalesce(sum(CASE WHEN k = 'action' AND ({cond}) THEN 1 ELSE 0 END), 0)::BIGINT"

    return f"""
SELECT coalesce(b.username, l.username) AS username, role, coalesce(events, 0) AS events, coalesce(ui_events, 0) AS ui_events,
  coalesce(active_days, 0) AS active_days, coalesce(channels, '') AS channels,
  CASE WHEN (coalesce(has_chat, FALSE) OR coalesce(llm_turns, 0) > 0) AND coalesce(has_mcp, FALSE) THEN 'AI chat + MCP'
       WHEN coalesce(has_mcp, FALSE) THEN 'MCP only (no in-app LLM)'
       WHEN coalesce(has_chat, FALSE) OR coalesce(llm_turns, 0) > 0 THEN 'In-app AI chat'
       WHEN coalesce(has_api, FALSE) THEN 'API scripts' ELSE 'Web UI only (no AI)' END AS segment,
  coalesce(llm_turns, 0) AS llm_turns, coalesce(llm_tokens, 0) AS llm_tokens, coalesce(mcp_calls, 0) AS mcp_calls,
  coalesce(chat_tool_calls, 0) AS chat_tool_calls, coalesce(kb_lookups, 0) AS kb_lookups, coalesce(logs_parsed, 0) AS logs_parsed,
  coalesce(incidents_filed, 0) AS incidents_filed, coalesce(resolutions, 0) AS resolutions, coalesce(errors, 0) AS errors,
  top_action, coalesce(lt, top_action) AS top_action_label, coalesce(clients, 0) AS clients, coalesce(orgs, 0) AS orgs, first_seen, last_seen,
  coalesce(has_chat, FALSE) AS has_chat
FROM (SELECT username, arg_max(role, (CASE WHEN k = 'action' THEN 0 ELSE 1 END, at_ts, event_id)) FILTER (role IS NOT NULL) AS role,
    {n('TRUE')} AS events, sum(CASE WHEN k = 'ui' THEN 1 ELSE 0 END)::BIGINT AS ui_events, count(DISTINCT day) AS active_days,
    string_agg(DISTINCT CASE WHEN k = 'action' THEN ch END, ',' ORDER BY CASE WHEN k = 'action' THEN ch END) AS channels,
    bool_or(k = 'action' AND ch = 'chat') AS has_chat, bool_or(k = 'action' AND ch IN ('mcp-remote', 'mcp-stdio')) AS has_mcp,
    bool_or(k = 'action' AND ch = 'api') AS has_api, {n(MCP_CALL)} AS mcp_calls, {n("channel = 'chat'")} AS chat_tool_calls,
    {n("action LIKE 'kb.%'")} AS kb_lookups, {n(PARSE)} AS logs_parsed, {n("action = 'incident.file'")} AS incidents_filed,
    {n("action = 'incident.resolve'")} AS resolutions, {n('NOT fine')} AS errors, count(DISTINCT org_id) AS orgs,
    count(DISTINCT CASE WHEN k = 'action' THEN client END) AS clients,
    strftime(min(at_ts), {ISO}) AS first_seen, strftime(max(at_ts), {ISO}) AS last_seen FROM {named} a GROUP BY username) b
FULL JOIN (SELECT username, count(*) AS llm_turns, sum(total_tokens)::BIGINT AS llm_tokens FROM <usage> u
   WHERE username IS NOT NULL AND {where} GROUP BY 1) l ON b.username = l.username
LEFT JOIN {tops(named, 'username', "k = 'action'")} t ON t.tk = b.username
LEFT JOIN {LABELS} ON la = top_action
"""


@query("activity_users", f"SELECT * EXCLUDE (has_chat) FROM ({users_sql()}) x")
def activity_users(spark, root):
    return act.users(grain(spark, root), usage_rows(spark, root)).drop("has_chat")


@query("own_activity_report", f"SELECT * EXCLUDE (has_chat) FROM ({users_sql(chr(117) + 'sername = ' + chr(39) + 'user_7' + chr(39))}) x")
def own_activity_report(spark, root):
    return act.own_report(grain(spark, root), usage_rows(spark, root), "user_7")


@query("activity_segments", f"""
SELECT segment, count(*) AS users, sum(events)::BIGINT AS events, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share_pct
FROM ({users_sql()}) x GROUP BY segment
""")
def activity_segments(spark, root):
    return act.segments(act.users(grain(spark, root), usage_rows(spark, root)))


@query("adoption_ladder", f"""
WITH f AS (SELECT username, bool_or(k = 'action' AND action LIKE 'kb.%') AS kb, bool_or(k = 'action' AND action = 'log.parse') AS l,
  bool_or(k = 'action' AND action = 'incident.file') AS i, bool_or(k = 'action' AND action = 'incident.resolve') AS r
  FROM {A} a WHERE username IS NOT NULL AND (k = 'ui' OR fine) GROUP BY 1)
SELECT 1 AS position, 'active' AS step, 'Active' AS label, count(*) AS users FROM f
UNION ALL SELECT 2, 'kb', 'Looked up org metadata', count(*) FROM f WHERE kb
UNION ALL SELECT 3, 'log', 'Parsed a debug log', count(*) FROM f WHERE l
UNION ALL SELECT 4, 'incident', 'Filed an incident', count(*) FROM f WHERE i
UNION ALL SELECT 5, 'resolve', 'Recorded a resolution', count(*) FROM f WHERE r
""")
def adoption_ladder(spark, root):
    return act.ladder(rows(spark, root))


ORG_ROWS = f"(SELECT * FROM {A} a1 WHERE k = 'action' AND org_id IS NOT NULL)"
ORGS = f"""
SELECT b.*, txt AS channels, top_action, g.name AS org_name, g.account FROM (
  SELECT org_id, count(*) AS events, count(DISTINCT username) AS users, sum(CASE WHEN action = 'incident.file' THEN 1 ELSE 0 END)::BIGINT AS incidents,
    strftime(max(at_ts), {ISO}) AS last_seen FROM {ORG_ROWS} a GROUP BY 1) b
LEFT JOIN {counter(ORG_ROWS, ['org_id'], 'ch')} c USING (org_id) LEFT JOIN {tops(ORG_ROWS, 'org_id', 'TRUE')} t ON t.tk = b.org_id
LEFT JOIN <registry> g ON g.org_id = b.org_id
"""


@query("activity_orgs", ORGS)
def activity_orgs(spark, root):
    return act.orgs(grain(spark, root), view(spark, root, "registry"))


@query("activity_accounts", f"""
SELECT coalesce(account, '(unassigned)') AS account, sum(events)::BIGINT AS events, count(*) AS orgs, sum(incidents)::BIGINT AS incidents
FROM ({ORGS}) o GROUP BY 1
""")
def activity_accounts(spark, root):
    return act.accounts(act.orgs(grain(spark, root), view(spark, root, "registry")))


@query("activity_hours", f"""
SELECT h.range AS hour, count(a.event_id) AS events FROM range(24) h LEFT JOIN {A} a ON hour(a.at_ts) = h.range AND k = 'action' GROUP BY 1
""")
def activity_hours(spark, root):
    return act.hours(rows(spark, root))


BAD = f"(SELECT * FROM {A} a1 WHERE k = 'action' AND NOT fine)"


@query("activity_errors", f"""
SELECT b.*, txt AS channels, coalesce(lt, action) AS label FROM (
  SELECT action, status, count(*) AS count, count(DISTINCT username) AS users FROM {BAD} a GROUP BY 1, 2) b
LEFT JOIN {counter(BAD, ['action', 'status'], 'ch')} c USING (action, status) LEFT JOIN {LABELS} ON la = action
""")
def activity_errors(spark, root):
    return act.errors(grain(spark, root))


def _n(cond):
    return f"sum(CASE WHEN k = 'action' AND ({cond}) THEN 1 ELSE 0 END)::BIGINT"


@query("activity_totals", f"""
SELECT {_n('TRUE')} AS actions, sum(CASE WHEN k = 'ui' THEN 1 ELSE 0 END)::BIGINT AS ui_events, count(DISTINCT username) AS active_users,
  count(DISTINCT day) AS active_days, {_n('NOT fine')} AS errors, {_n(MCP_CALL)} AS mcp_calls, {_n("channel = 'chat'")} AS chat_tool_calls,
  {_n(PARSE)} AS logs_parsed, {_n("action = 'incident.file' AND fine")} AS incidents_filed, {_n("action = 'incident.resolve' AND fine")} AS resolutions,
  {_n("action LIKE 'kb.%'")} AS kb_lookups, (SELECT count(*) FROM <usage> u) AS llm_turns,
  (SELECT count(*) FROM ({users_sql()}) x WHERE llm_turns = 0 AND NOT has_chat AND events > 0) AS non_llm_users
FROM {A} a
""")
def activity_totals(spark, root):
    return act.totals(grain(spark, root), usage_rows(spark, root))


@query("activity_recent", f"""
SELECT strftime(at_ts, {ISO}) AS at, event_id, username, channel, action, coalesce(lt, action) AS label, category, org_id, tool, client, fine AS ok, status, ms, k AS kind
FROM {A} a LEFT JOIN {LABELS} ON la = action ORDER BY at_ts DESC, event_id DESC LIMIT 100
""")
def activity_recent(spark, root):
    return act.recent(rows(spark, root))


@query("activity_export", f"""
SELECT event_id, strftime(at_ts, {ISO}) AS at, k AS kind, username, role, channel, action, category, org_id, tool, client,
  CAST(status AS VARCHAR) AS status, CAST(fine AS VARCHAR) AS ok, CAST(ms AS VARCHAR) AS ms, token_kind,
  concat('{{"exceptions":', meta_exceptions, ',"has_log":', meta_has_log, ',"stored":', meta_stored, ',"parse_ms":', meta_parse_ms, '}}') AS meta
FROM {A} a
""")
def activity_export(spark, root):
    return act.export_rows(rows(spark, root))
