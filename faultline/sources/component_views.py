"""Component inputs derived from the given tables; see ``views`` for the conventions."""

from __future__ import annotations

from faultline.sources.views import VIEWS

VIEWS["entry_point_rows"] = """
SELECT concat('org_', CAST(p_partkey % 5 AS VARCHAR(20))) AS org_id, concat('Part_', CAST(p_partkey AS VARCHAR(20))) AS component_id,
  CASE p_partkey % 7 WHEN 0 THEN 'InvocableMethod' WHEN 1 THEN 'Queueable' WHEN 2 THEN 'Batchable' WHEN 3 THEN 'Schedulable' WHEN 4 THEN 'future'
    WHEN 5 THEN 'AuraEnabled' ELSE 'RestResource' END AS kind,
  concat('m', CAST(p_size AS VARCHAR(20)), '()') AS detail, p_size > 30 AS is_inner FROM {part}
UNION ALL
SELECT concat('org_', CAST(p_partkey % 5 AS VARCHAR(20))), concat('Part_', CAST(p_partkey AS VARCHAR(20))), 'InvocableMethod', 'second()', FALSE FROM {part} WHERE p_size > 40
"""

VIEWS["flow_action_rows"] = """
SELECT concat('org_', CAST(l_partkey % 5 AS VARCHAR(20))) AS org_id, concat('Part_', CAST(l_partkey AS VARCHAR(20))) AS flow_id,
  l_orderkey AS element_no, l_linenumber AS element_pos, CASE WHEN l_quantity > 10 THEN 'apex' ELSE 'emailAlert' END AS action_type,
  CASE WHEN l_tax > 0.01 THEN concat('Part_', CAST(l_suppkey * 5 + l_partkey % 5 AS VARCHAR(20))) ELSE 'GoneClass' END AS action_name
FROM {lineitem} WHERE l_returnflag = 'N'
"""

VIEWS["ui_imports"] = """
SELECT concat('org_', CAST(l_partkey % 5 AS VARCHAR(20))) AS org_id, concat('Part_', CAST(l_partkey AS VARCHAR(20))) AS bundle,
  concat('Part_', CAST(l_suppkey * 5 + l_partkey % 5 AS VARCHAR(20)), '.get', CAST(l_linenumber AS VARCHAR(20))) AS import_name
FROM {lineitem} WHERE l_returnflag = 'R'
"""

VIEWS["subflow_calls"] = """
SELECT DISTINCT concat('org_', CAST(l_partkey % 5 AS VARCHAR(20))) AS org_id, concat('Part_', CAST(l_partkey AS VARCHAR(20))) AS flow_id,
  concat('Part_', CAST(l_suppkey * 5 + l_partkey % 5 AS VARCHAR(20))) AS subflow FROM {lineitem} WHERE l_returnflag = 'A'
"""

VIEWS["id_requests"] = """
SELECT concat('org_', CAST(p_partkey % 5 AS VARCHAR(20))) AS org_id, p_partkey AS request_id,
  concat(CASE p_size % 8 WHEN 0 THEN 'Part_' WHEN 1 THEN 'PART_' WHEN 2 THEN 'Pkg.Part_' WHEN 3 THEN 'pkg.part_' WHEN 4 THEN 'Other.Part_' WHEN 5 THEN 'Part_' WHEN 6 THEN 'Nope' ELSE ' part_' END,
    CAST(p_partkey AS VARCHAR(20)), CASE p_size % 8 WHEN 2 THEN '.run' WHEN 5 THEN '.doIt' WHEN 7 THEN ' ' ELSE '' END) AS raw
FROM {part}
"""

VIEWS["named_components"] = """
SELECT DISTINCT concat('org_', CAST(o_custkey % 5 AS VARCHAR(20))) AS org_id, concat('Part_', CAST(o_custkey AS VARCHAR(20))) AS component_id
FROM {orders} WHERE o_orderpriority = '1-URGENT'
"""

VIEWS["component_manifest"] = """
SELECT concat('org_', CAST(p_partkey % 5 AS VARCHAR(20))) AS org_id,
  concat(CASE WHEN p_size % 8 = 0 THEN 'triggers/' WHEN p_size % 8 = 1 THEN 'flows/' WHEN p_size % 8 = 2 THEN 'lwc/' WHEN p_size % 8 = 3 THEN 'workflow/' ELSE 'classes/' END,
    'Part_', CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_size % 8 = 0 THEN '.trigger' WHEN p_size % 8 = 1 THEN '.flow' WHEN p_size % 8 IN (2, 3) THEN '' ELSE '.cls' END) AS path,
  CAST(p_partkey % 30 AS BIGINT) * 86400 + p_size * 1000 AS age_seconds
FROM {part} WHERE p_retailprice < 1000
"""

VIEWS["org_warnings"] = """
SELECT concat('org_', CAST(s_suppkey % 5 AS VARCHAR(20))) AS org_id,
  CASE s_suppkey % 10 WHEN 0 THEN concat('class ', s_name, ': time out') WHEN 1 THEN concat('Flow ', s_name, ' not readable') WHEN 7 THEN 'trigger listing cut' ELSE concat('note ', s_name) END AS warning
FROM {supplier}
"""
