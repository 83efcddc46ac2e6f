"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run.

``{table}`` names a given table, ``<view>`` another view of this file.  Every
view maps rows to rows, so its size grows with its source.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.scan import number_rows
from faultline.sources.tables import NAMES, bind

# The last day of the given events; the end of every reporting window.
AS_OF = "2024-01-30"

VIEWS: dict[str, str] = {}

VIEWS["activity"] = """
SELECT event_id, ts AS at_ts, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('user_', CAST(user_id AS VARCHAR(20))) END AS username,
  CASE WHEN user_id % 9 = 0 THEN 'admin' WHEN event_id % 8 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'reader' ELSE 'user' END AS role,
  CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'ui' WHEN event_id % 5 = 0 THEN NULL ELSE 'action' END AS kind,
  CASE WHEN event_id % 31 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'chat' WHEN user_id % 5 = 1 THEN 'mcp-remote'
       WHEN user_id % 5 = 2 THEN 'mcp-stdio' WHEN user_id % 5 = 3 THEN 'api' ELSE 'web' END AS channel,
  CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'ui.view' WHEN event_type = 'view' THEN 'kb.component'
       WHEN event_type = 'click' AND event_id % 17 = 0 THEN 'auth.login'
       WHEN event_type = 'click' THEN 'kb.search' WHEN event_type = 'purchase' THEN 'log.parse'
       WHEN event_type = 'signup' AND event_id % 19 = 0 THEN 'org.refresh'
       WHEN event_type = 'signup' THEN 'incident.file'
       WHEN event_id % 2 = 0 THEN 'incident.resolve' ELSE 'mcp.connect' END AS action,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_type IN ('view', 'click') THEN 'Knowledgebase'
       WHEN event_type = 'purchase' THEN 'Logs' ELSE 'Incidents' END AS category,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('org_', CAST(event_id % 28 AS VARCHAR(20))) END AS org_id,
  CASE WHEN user_id % 5 IN (0, 1, 2) THEN concat('tool_', CAST(event_id % 6 AS VARCHAR(20))) END AS tool,
  CASE WHEN user_id % 5 IN (1, 2) AND event_id % 4 <> 0 THEN concat('client_', CAST(event_id % 3 AS VARCHAR(20))) END AS client,
  CASE WHEN event_id % 13 = 0 THEN FALSE WHEN event_id % 11 = 0 THEN NULL ELSE TRUE END AS ok,
  CASE WHEN event_id % 13 <> 0 THEN 200 WHEN event_id % 2 = 0 THEN 403 ELSE 500 END AS status,
  CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS ms,
  CASE WHEN event_id % 3 = 0 THEN 'session' ELSE 'token' END AS token_kind,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS meta_exceptions,
  value AS meta_size_kb, event_id % 3 = 0 AS meta_has_log, event_id % 5 = 0 AS meta_stored,
  CAST(floor(value * 7) AS BIGINT) AS meta_parse_ms
FROM {events}
"""

VIEWS["usage"] = """
SELECT event_id, ts AS at_ts, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('user_', CAST(user_id AS VARCHAR(20))) END AS username,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('org_', CAST(event_id % 28 AS VARCHAR(20))) END AS org_id,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('model_', CAST(user_id % 7 AS VARCHAR(20))) END AS model,
  CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, CAST(floor(value * 10) AS BIGINT) AS completion_tokens,
  CAST(floor(value * 3) AS BIGINT) AS reasoning_tokens,
  CAST(floor(value * 100) AS BIGINT) + CAST(floor(value * 10) AS BIGINT) AS total_tokens,
  CASE WHEN event_id % 3 = 0 THEN value / 1000 END AS cost, event_id % 3 = 0 AND user_id % 7 < 5 AS cost_reported,
  event_id % 5 AS tool_calls, event_id % 3 AS tool_rounds, CAST(floor(value * 50) AS BIGINT) AS duration_ms,
  CASE WHEN event_id % 11 = 0 THEN FALSE WHEN event_id % 14 = 0 THEN NULL ELSE TRUE END AS ok
FROM {events} WHERE event_type IN ('click', 'purchase', 'error')
"""

VIEWS["registry"] = """
SELECT concat('org_', CAST(n_nationkey AS VARCHAR(20))) AS org_id, n_name AS name,
  CASE WHEN n_nationkey % 8 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN concat(' ', lower(r_name), '  ') ELSE r_name END AS account,
  CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE concat('user_', CAST(n_nationkey AS VARCHAR(20))) END AS owner,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 'private' ELSE 'public' END AS visibility,
  CASE WHEN n_nationkey % 7 = 0 THEN concat('c', CAST(n_regionkey AS VARCHAR(20)), '--uat.sandbox.my.salesforce.com')
       WHEN n_nationkey % 7 = 1 THEN concat('https://C', CAST(n_regionkey AS VARCHAR(20)), '.my.salesforce.com/x?a=1')
       WHEN n_nationkey % 7 = 2 THEN concat('https://c', CAST(n_regionkey AS VARCHAR(20)), '-dev.develop.my.salesforce.com')
       WHEN n_nationkey % 7 = 3 THEN concat('https://c', CAST(n_regionkey AS VARCHAR(20)), '.scratch.my.salesforce.com')
       WHEN n_nationkey % 7 = 4 THEN concat('https://c', CAST(n_regionkey AS VARCHAR(20)), '.lightning.force.com')
       WHEN n_nationkey % 7 = 5 THEN NULL
       ELSE 'https://cs4.salesforce.com' END AS instance_url,
  CAST(n_nationkey AS BIGINT) AS onboarded_days_ago, CAST(n_nationkey AS BIGINT) * 2 AS extracted_days_ago,
  CAST(n_nationkey AS BIGINT) * 3 AS n_classes, CAST(n_nationkey AS BIGINT) + 1 AS n_flows
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

VIEWS["users"] = """
SELECT concat('user_', CAST(c_custkey AS VARCHAR(20))) AS username,
  CASE WHEN c_custkey % 9 = 0 THEN 'admin' WHEN c_custkey % 2 = 0 THEN 'reader' ELSE 'user' END AS role,
  CASE WHEN c_custkey % 4 = 0 THEN 'self' WHEN c_custkey % 4 = 1 THEN NULL ELSE 'user_0' END AS created_by,
  CASE WHEN c_custkey % 5 = 0 THEN TRUE WHEN c_custkey % 5 IN (1, 2) THEN FALSE END AS verified,
  c_custkey % 12 = 0 AS disabled, c_custkey % 40 AS created_days_ago,
  c_custkey % 6 = 0 AS has_daily_override,
  CASE WHEN c_custkey % 12 = 0 THEN NULL WHEN c_custkey % 18 = 0 THEN 'bad' WHEN c_custkey % 6 = 0 THEN '9000' END AS daily_override,
  c_custkey % 10 = 0 AS has_monthly_override,
  CASE WHEN c_custkey % 10 = 0 THEN '150000' END AS monthly_override,
  c_name AS display_name, md5(c_name) AS password_hash
FROM {customer}
"""

VIEWS["tokens"] = """
SELECT concat('tok_', CAST(s_suppkey AS VARCHAR(20))) AS token_id,
  concat('user_', CAST(s_suppkey % 40 AS VARCHAR(20))) AS username,
  CASE WHEN s_suppkey % 3 = 0 THEN 'session' ELSE 'api' END AS kind, s_name AS name,
  s_suppkey % 50 AS created_days_ago, md5(s_name) AS token_hash
FROM {supplier}
"""

VIEWS["log_library"] = """
SELECT concat('20240101T00000', CAST(c_custkey % 10 AS VARCHAR(20)), 'Z_log_', CAST(c_custkey AS VARCHAR(20))) AS log_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(c_mktsegment, ' Case ', CAST(c_custkey % 50 AS VARCHAR(20))) END AS label,
  concat('apex-', CAST(c_custkey AS VARCHAR(20)), '.log') AS source_log,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('org_', CAST(c_custkey % 30 AS VARCHAR(20))) END AS org_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'Asia ' WHEN c_custkey % 4 = 1 THEN 'EUROPE' END AS account,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('user_', CAST(c_custkey % 40 AS VARCHAR(20))) END AS owner,
  c_custkey % 7 = 0 AS archived,
  CASE WHEN c_custkey % 2 = 0 THEN concat('System.Err', CAST(c_custkey % 7 AS VARCHAR(20)), 'Exception') END AS top_exception,
  concat('Helper', CAST(c_custkey % 3 AS VARCHAR(20)), ' Part_', CAST(c_custkey AS VARCHAR(20))) AS components
FROM {customer}
"""

# one row per incident filed from a library log
VIEWS["log_links"] = """
SELECT concat('20240101T00000', CAST(o_custkey % 10 AS VARCHAR(20)), 'Z_log_', CAST(o_custkey AS VARCHAR(20))) AS log_id,
  concat('org_', CAST(o_orderkey % 28 AS VARCHAR(20))) AS org_id,
  o_orderkey AS incident_id, o_orderdate AS filed_at
FROM {orders}
"""

VIEWS["log_events"] = """
SELECT user_id AS log_id, ts, event_id,
  CASE event_id % 30
    WHEN 0 THEN concat('1|CODE_UNIT_STARTED|[EXTERNAL]|', CASE event_id % 4 WHEN 0 THEN 'OrderSyncJob' WHEN 1 THEN 'AccountBatch' WHEN 2 THEN '__sfdc_trigger/QueueTrigger' ELSE concat('Unit', CAST(event_id % 5 AS VARCHAR(20))) END)
    WHEN 1 THEN concat('1|SOQL_EXECUTE_BEGIN|[15]|Aggregations:0|SELECT Id FROM Obj', CAST(event_id % 4 AS VARCHAR(20)), '__c WHERE Id = ''', CAST(event_id AS VARCHAR(20)), '''')
    WHEN 2 THEN concat('1|SOQL_EXECUTE_END|[15]|Rows:', CAST(event_id % 9 AS VARCHAR(20)))
    WHEN 3 THEN concat('1|DML_BEGIN|[20]|', CASE WHEN event_id % 4 = 0 THEN 'Op:Odd' ELSE concat('Op:Update|Type:Obj', CAST(event_id % 4 AS VARCHAR(20)), '__c|Rows:', CAST(event_id % 6 AS VARCHAR(20))) END)
    WHEN 4 THEN '1|DML_END|[20]'
    WHEN 5 THEN CASE WHEN event_id % 4 = 1 THEN concat('1|EXCEPTION_THROWN|[', CAST(event_id % 3 AS VARCHAR(20)), ']|System.LimitException: Too many queueable jobs added to the queue: 2')
                     ELSE concat('1|EXCEPTION_THROWN|[62]|System.Err', CAST(event_id % 3 AS VARCHAR(20)), 'Exception: bad value in Helper', CAST(event_id % 3 AS VARCHAR(20))) END
    WHEN 6 THEN '1|FATAL_ERROR|System.ErrException: bad'
    WHEN 7 THEN concat('  Class.Helper', CAST(event_id % 3 AS VARCHAR(20)), '.run: line 42, column 1')
    WHEN 8 THEN 'Trigger.OrderTrigger: line 3, column 1'
    WHEN 9 THEN concat('1|LIMIT_USAGE_FOR_NS|', CASE WHEN event_id % 4 = 1 THEN 'Pkg' ELSE '(default)' END, '|')
    WHEN 10 THEN concat('  Number of SOQL queries: ', CAST(event_id % 101 AS VARCHAR(20)), ' out of 100', CASE WHEN event_id % 101 > 90 THEN ' ******* CLOSE TO LIMIT' ELSE '' END)
    WHEN 11 THEN concat('  Maximum CPU time: ', CAST(event_id % 9000 AS VARCHAR(20)), ' out of 10000')
    WHEN 12 THEN concat('1|USER_DEBUG|[5]|DEBUG|note   ', CAST(event_id % 50 AS VARCHAR(20)))
    WHEN 13 THEN '1|CODE_UNIT_FINISHED|Unit'
    WHEN 14 THEN concat('1|METHOD_ENTRY|[12]|01p|Helper', CAST(event_id % 3 AS VARCHAR(20)), '.run(Integer, List<Id>)')
    WHEN 15 THEN concat('1|METHOD_EXIT|[12]|Helper', CAST(event_id % 3 AS VARCHAR(20)), '.run(Integer, List<Id>)')
    WHEN 16 THEN concat('1|CONSTRUCTOR_ENTRY|[', CAST(event_id % 3 AS VARCHAR(20)), ']|01p|', CASE event_id % 4 WHEN 0 THEN '<init>()' WHEN 1 THEN 'Plain' ELSE concat('SyncJob', CAST(event_id % 2 AS VARCHAR(20))) END)
    WHEN 17 THEN concat('1|SYSTEM_METHOD_ENTRY|[', CAST(event_id % 3 AS VARCHAR(20)), ']|', CASE event_id % 4 WHEN 0 THEN 'Database.executeBatch(Object)' WHEN 1 THEN 'String.valueOf(Object)' ELSE 'System.enqueueJob(Queueable)' END)
    WHEN 18 THEN '1|ENTERING_MANAGED_PKG|Pkg'
    WHEN 19 THEN concat('1|CALLOUT_REQUEST|[9]|System.HttpRequest[Endpoint=https://h', CAST(event_id % 5 AS VARCHAR(20)), '.example.com, Method=GET]')
    WHEN 20 THEN '1|VALIDATION_RULE|03d|Amount_Required'
    WHEN 21 THEN '1|VALIDATION_PASS'
    WHEN 22 THEN concat('1|FLOW_START_INTERVIEW_BEGIN|f', CAST(event_id % 4 AS VARCHAR(20)))
    WHEN 23 THEN '1|FLOW_ELEMENT_BEGIN|x'
    WHEN 24 THEN '   '
    WHEN 25 THEN concat('1|EXCEPTION_THROWN|[7]|System.SObjectException: SObject row was retrieved via SOQL without querying the requested field: Obj', CAST(event_id % 4 AS VARCHAR(20)), '__c.Field_', CAST(event_id % 3 AS VARCHAR(20)), '__c')
    WHEN 26 THEN concat('1|SOQL_EXECUTE_BEGIN|[16]|Aggregations:0|SELECT Id, Field_1__c FROM Obj', CAST(event_id % 4 AS VARCHAR(20)), '__c WHERE Name = :name LIMIT 5')
    WHEN 27 THEN concat('1|CODE_UNIT_STARTED|[EXTERNAL]|Unit', CAST(event_id % 5 AS VARCHAR(20)))
    WHEN 28 THEN concat('1|SOQL_EXECUTE_END|[15]|Rows:', CAST(event_id % 9 AS VARCHAR(20)))
    ELSE '1|CODE_UNIT_FINISHED|Unit' END AS raw
FROM {events}
"""

VIEWS["log_lines"] = """
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY ts, event_id) AS line_no, raw FROM <log_events>
"""

VIEWS["log_headers"] = """
SELECT user_id AS log_id,
  CASE WHEN user_id % 10 = 0 THEN '' WHEN user_id % 10 = 1 THEN 'APEX_CODE,DEBUG' ELSE
  concat('59.0 APEX_CODE,', CASE user_id % 3 WHEN 0 THEN 'FINE' WHEN 1 THEN 'debug' ELSE 'FINEST' END, ';APEX_PROFILING,NONE; SYSTEM,',
         CASE user_id % 2 WHEN 0 THEN 'DEBUG' ELSE 'FINER' END, ';broken') END AS header,
  min(ts) AS started_at, count(*) AS n_events
FROM {events} GROUP BY user_id
"""

VIEWS["log_components"] = """
SELECT concat('Helper', CAST(r_regionkey AS VARCHAR(20))) AS component_id FROM {region}
UNION ALL SELECT concat('Unit', CAST(n_nationkey * 2 AS VARCHAR(20))) FROM {nation}
UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'OrderSyncJob' WHEN 1 THEN 'AccountBatch' WHEN 2 THEN 'System' WHEN 3 THEN 'QueueTrigger' ELSE 'Obj2__c' END FROM {region}
"""

VIEWS["cards"] = """
SELECT concat('org_', CAST(p_partkey % 5 AS VARCHAR(20))) AS org_id,
  concat('Part_', CAST(p_partkey AS VARCHAR(20))) AS component_id,
  CASE WHEN p_size % 8 = 0 THEN 'ApexTrigger' WHEN p_size % 8 = 1 THEN 'Flow' WHEN p_size % 8 = 2 THEN 'LWC'
       WHEN p_size % 8 = 3 THEN 'WorkflowFieldUpdate' WHEN p_size % 8 = 4 THEN 'ApexInterface' ELSE 'ApexClass' END AS type,
  CASE WHEN p_partkey % 9 = 0 THEN 'Pkg' WHEN p_partkey % 9 = 1 THEN 'Own' END AS namespace,
  CASE WHEN p_partkey % 11 = 0 THEN TRUE WHEN p_partkey % 11 < 6 THEN FALSE END AS is_test_flag,
  CASE WHEN p_partkey % 3 = 0 THEN '3.1.0' WHEN p_partkey % 3 = 1 THEN '3.2.0' ELSE '3.10.0' END AS extractor_version,
  CASE WHEN p_partkey % 4 <> 3 THEN concat('Obj', CAST(p_size % 20 AS VARCHAR(20)), '__c') END AS object,
  CASE WHEN p_partkey % 6 = 0 THEN concat(p_name, 'Test') ELSE p_name END AS label,
  p_size AS loc, p_partkey % 30 AS changed_days_ago, p_brand AS section_a, p_type AS section_b
FROM {part}
"""

VIEWS["call_edges"] = """
SELECT DISTINCT concat('org_', CAST(l_partkey % 5 AS VARCHAR(20))) AS org_id,
  concat('Part_', CAST(l_partkey AS VARCHAR(20))) AS src,
  concat(CASE WHEN l_suppkey % 2 = 0 THEN 'Part_' ELSE 'part_' END, CAST(l_suppkey * 5 + l_partkey % 5 AS VARCHAR(20))) AS dst,
  CASE l_linenumber % 4 WHEN 0 THEN 'method_call' WHEN 1 THEN 'constructor' WHEN 2 THEN 'System.enqueueJob' ELSE 'Type.forName' END AS via
FROM {lineitem}
"""

VIEWS["call_sites"] = """
SELECT concat('org_', CAST(l_partkey % 5 AS VARCHAR(20))) AS org_id, l_orderkey AS site_no, l_linenumber AS line,
  concat('Part_', CAST(l_partkey AS VARCHAR(20))) AS caller,
  concat(CASE WHEN l_quantity > 25 THEN 'Part_' ELSE 'part_' END, CAST(l_suppkey * 5 + l_partkey % 5 AS VARCHAR(20))) AS target,
  concat('run', CAST(l_linenumber AS VARCHAR(20))) AS method_called, concat('do', CAST(l_orderkey % 9 AS VARCHAR(20))) AS caller_method,
  CASE WHEN l_tax > 0.07 THEN 'same_class' WHEN l_tax > 0.04 THEN 'namespaced_class' ELSE 'org_class' END AS kind,
  l_discount > 0.08 AS in_loop
FROM {lineitem}
"""

VIEWS["field_writes"] = """
SELECT concat('org_', CAST(l_partkey % 5 AS VARCHAR(20))) AS org_id, l_orderkey AS write_id, l_linenumber AS seq,
  concat('Part_', CAST(l_partkey AS VARCHAR(20))) AS component,
  concat(CASE WHEN l_suppkey % 3 = 0 THEN 'Pkg__' ELSE '' END, 'Field_', CAST(l_suppkey AS VARCHAR(20)), '__c') AS field,
  CASE WHEN l_linestatus = 'F' THEN 'declarative' WHEN l_returnflag = 'R' THEN 'high' WHEN l_returnflag = 'A' THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN l_linestatus = 'O' THEN 'Apex' WHEN l_returnflag = 'N' THEN 'Process Builder' ELSE 'Flow' END AS mechanism,
  CASE WHEN l_quantity > 25 THEN 'cache' END AS source_map,
  CASE WHEN l_discount > 0.05 THEN 'persisted' ELSE 'unpersisted_or_unresolved' END AS persistence,
  l_tax > 0.06 AS in_filter
FROM {lineitem}
"""

VIEWS["manifest_before"] = """
SELECT concat(source, '/', CAST(d.doc_id AS VARCHAR(20))) AS path, <sha>(text) AS hash, n_chars % 30 AS age_days
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0
"""

VIEWS["manifest_after"] = """
SELECT concat(source, '/', CAST(d.doc_id AS VARCHAR(20))) AS path,
  <sha>(CASE WHEN n_chars > 2000 THEN concat(text, '!') ELSE text END) AS hash
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 1) = 1
"""

VIEWS["incidents"] = """
SELECT o_orderkey AS incident_id, concat('org_', CAST(o_custkey % 28 AS VARCHAR(20))) AS org_id, o_orderdate AS filed_at,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('System.Err', CAST(o_custkey % 7 AS VARCHAR(20)), 'Exception') END AS exc_type,
  concat('bad value ', CAST(o_orderkey AS VARCHAR(20)), ' in ''', o_orderpriority, ''' for :acct on Obj', CAST(o_custkey % 4 AS VARCHAR(20)), '__c') AS message,
  concat('Class.Helper', CAST(o_custkey % 3 AS VARCHAR(20)), '.run: line ', CAST(o_orderkey % 99 AS VARCHAR(20)), ', column 1') AS frame_line,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('Field_', CAST(o_custkey % 40 AS VARCHAR(20)), '__c') END AS suspect_field
FROM {orders}
"""

# resolutions recorded for an incident's signature
VIEWS["resolutions"] = """
SELECT o_orderkey AS incident_id, o_orderdate AS resolved_at, concat('fix ', CAST(o_orderkey AS VARCHAR(20))) AS resolution
FROM {orders} WHERE o_totalprice > 495000
"""


# one row per finished web request; braces of route templates are doubled
VIEWS["requests"] = """
SELECT event_id, ts AS at_ts, user_id,
  CASE event_id % 10 WHEN 1 THEN 'GET' WHEN 2 THEN 'GET' WHEN 3 THEN 'GET' WHEN 4 THEN 'GET' WHEN 6 THEN 'DELETE' WHEN 7 THEN 'GET' WHEN 9 THEN 'PATCH' ELSE 'POST' END AS method,
  CASE event_id % 10 WHEN 0 THEN '/api/auth/login' WHEN 1 THEN '/api/orgs' WHEN 2 THEN '/api/orgs/{{org_id}}/search' WHEN 3 THEN '/api/home'
    WHEN 4 THEN '/api/shared/{{token}}' WHEN 5 THEN '/api/orgs/{{org_id}}/incidents' WHEN 6 THEN '/api/unknown/{{x}}' WHEN 7 THEN '/api/unknown'
    WHEN 8 THEN '/api/logs/normalize' ELSE '/api/orgs/{{org_id}}/visibility' END AS route,
  CASE user_id % 6 WHEN 0 THEN ' Chat ' WHEN 1 THEN 'MCP-Remote' WHEN 2 THEN 'mcp-stdio' WHEN 3 THEN 'weird' END AS channel_header,
  CASE WHEN event_id % 23 <> 0 THEN concat('user_', CAST(user_id AS VARCHAR(20))) END AS ident_user,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'session' ELSE 'token' END AS ident_kind,
  CASE WHEN event_id % 46 = 0 THEN concat('user_', CAST(user_id AS VARCHAR(20))) END AS meta_user,
  CASE WHEN event_id % 3 = 0 THEN concat('  tool<', event_type, '> #', CAST(event_id % 7 AS VARCHAR(20)), ' ') WHEN event_id % 3 = 1 THEN '<>' END AS tool_header,
  CASE WHEN event_id % 13 = 0 THEN 403 WHEN event_id % 17 = 0 THEN NULL ELSE 200 END AS status,
  CAST(floor(value * 10) AS BIGINT) AS ms
FROM {events}
"""

# browser events as they arrive, in batches of one user and hour
VIEWS["browser_events"] = """
SELECT event_id, user_id, ts AS arrived_at, date_trunc('hour', ts) AS batch,
  CASE event_id % 4 WHEN 0 THEN 'ui.view' WHEN 1 THEN 'ui.copy' WHEN 2 THEN 'ui.palette_run' ELSE 'ui.retired' END AS action,
  concat('{{"view":"', CASE WHEN event_id % 5 = 0 THEN '<b>' ELSE concat('tab ', event_type) END, '","value":', CAST(event_id % 9 AS VARCHAR(20)),
    ',"kind":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '"k"' END, ',"secret":"x"}}') AS meta,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST((event_id % 7) * 300 - 900 AS BIGINT) END AS clock_offset
FROM {events}
"""


def _spark_text(sql: str) -> str:
    sql = re.sub(r"<sha>\((.*?)\) AS hash", r"sha2(\1, 256) AS hash", sql, flags=re.S)
    return sql.replace("VARCHAR(20)", "STRING")


def _nest(sql: str) -> str:
    """Replace ``<view>`` by the view's text until none is left."""
    pattern = re.compile(r"<([a-z_]+)>(?!\()")
    while True:
        found = [m for m in pattern.findall(sql) if m in VIEWS]
        if not found:
            return sql
        for name in set(found):
            sql = sql.replace(f"<{name}>", f"({VIEWS[name]}) ")


def expand(sql: str) -> str:
    """Check SQL for DuckDB: views nested, tables by their own names."""
    sql = _nest(sql).replace("<sha>", "sha256")
    for name in NAMES:
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{{", "{").replace("}}", "}")


def view(spark: SparkSession, root: str, name: str, wide: bool = False) -> DataFrame:
    if name == "log_lines":
        lines = view(spark, root, "log_events")
        return number_rows(
            lines, ["log_id"], F.date_trunc("minute", "ts"), [F.col("ts"), F.col("event_id")], "line_no", wide
        ).select("log_id", "line_no", "raw")
    rows = bind(spark, root, _spark_text(_nest(VIEWS[name])))
    if name == "log_events":
        # stands for a stored text column: filters on it must not repeat its long expression
        rows = rows.select("log_id", "ts", "event_id", F.explode(F.array("raw")).alias("raw"))
    return rows
