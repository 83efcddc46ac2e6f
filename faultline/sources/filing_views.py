"""Reports filed from logs, and an installation whose components the logs name; columns as in ``views``."""

from faultline.sources.views import VIEWS

# one report per log, two of which in three name no field, and one per customer without a log
VIEWS["filings"] = """
SELECT -(2 * user_id + 1) AS incident_id, concat('org_', CAST(user_id % 5 AS VARCHAR(20))) AS org_id, CAST(max(ts) AS DATE) AS filed_at, user_id AS log_id,
  CASE WHEN user_id % 3 = 0 THEN concat('Field_', CAST(user_id % 100 AS VARCHAR(20)), '__c') END AS suspect_field
FROM {events} GROUP BY user_id
UNION ALL SELECT -(2 * c_custkey + 2), concat('org_', CAST(c_custkey % 28 AS VARCHAR(20))), DATE '2024-01-30', CAST(NULL AS BIGINT), concat('Field_', CAST(c_custkey % 40 AS VARCHAR(20)), '__c')
FROM {customer}
"""

# of the units that logs name, every organisation lacks one
VIEWS["filing_cards"] = """
SELECT org_id, component_id, type, namespace, is_test_flag, object, loc FROM <cards>
UNION ALL SELECT DISTINCT concat('org_', CAST(user_id % 5 AS VARCHAR(20))), concat('Unit', CAST(event_id % 5 AS VARCHAR(20))), 'ApexClass', CAST(NULL AS VARCHAR(20)), CAST(NULL AS BOOLEAN),
  concat('Obj', CAST(event_id % 5 AS VARCHAR(20)), '__c'), 20 FROM {events} WHERE user_id % 5 <> event_id % 5
"""

VIEWS["filing_edges"] = """
SELECT org_id, src, dst, via FROM <call_edges>
UNION ALL SELECT concat('org_', CAST(s_suppkey % 5 AS VARCHAR(20))), concat('Unit', CAST(CAST(floor(s_suppkey / 5) AS BIGINT) % 5 AS VARCHAR(20))),
  concat('Part_', CAST(s_suppkey AS VARCHAR(20))), 'method_call' FROM {supplier}
UNION ALL SELECT concat('org_', CAST(s_suppkey % 5 AS VARCHAR(20))), concat('Part_', CAST(s_suppkey AS VARCHAR(20))),
  concat('Unit', CAST(s_nationkey % 5 AS VARCHAR(20))), 'method_call' FROM {supplier}
"""

VIEWS["filing_links"] = """
SELECT o_custkey AS log_id, concat('org_', CAST(o_custkey % 5 AS VARCHAR(20))) AS org_id, o_orderkey AS incident_id, o_orderdate AS filed_at FROM {orders}
"""
