"""Flow queries.  Their check SQL derives the expected rows from the keys of the document template."""

from pyspark.sql import functions as F

from faultline.operators import flows as fl
from faultline.operators import source_code as sc
from faultline.plans.registry import query
from faultline.sources import flow_views as fv
from faultline.sources import source_views as sv
from faultline.sources.views import view

O = """(SELECT *, o_orderkey AS k, o_custkey AS c, concat('org_', CAST(o_orderkey % 5 AS VARCHAR)) AS org_id, concat('Flow_', CAST(o_orderkey AS VARCHAR)) AS flow_id,
  concat('Obj', CAST(o_custkey % 4 AS VARCHAR), '__c') AS obj FROM {orders})"""


def documents(spark, root, schema=fl.SCHEMA):
    return fl.parsed(fv.flow_documents(spark, root), schema)


@query("flow_headers", f"""
SELECT org_id, flow_id, concat('Flow ', k) AS label, CASE WHEN k % 9 = 0 THEN 'Process Builder' ELSE 'Flow' END AS mechanism, CASE WHEN k % 10 = 3 THEN 'Draft' ELSE 'Active' END AS status, k % 10 <> 3 AS is_active,
  c % 60 AS version_number, obj AS start_object, CASE WHEN c % 2 = 0 THEN 'RecordAfterSave' ELSE 'RecordBeforeSave' END AS trigger_type, 'Update' AS record_trigger_type,
  CASE WHEN k % 2 = 0 THEN 'and' END AS filter_logic, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS filters, CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'not_present_in_metadata' END AS requires_change,
  CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END::BIGINT AS scheduled_paths, 'SystemMode' AS run_in_mode FROM {O} o
""")
def flow_headers(spark, root):
    return fl.headers(documents(spark, root))


ELEMENTS = f"""
SELECT org_id, flow_id, 'Check' AS name, 'Check it' AS label, 'decision' AS type, NULL::VARCHAR AS next, NULL::VARCHAR AS fault_target, NULL::VARCHAR AS target_object, NULL::VARCHAR AS target_reference FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Upd', 'Update', 'recordUpdate', 'Act', CASE WHEN k % 3 = 0 THEN 'Look' END, obj, '$Record' FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Cre', 'Make', 'recordCreate', NULL, NULL, 'Log__c', NULL FROM {O} o WHERE k % 6 = 0
UNION ALL SELECT org_id, flow_id, 'Look', 'Find', 'recordLookup', 'Loop1', NULL, 'Account', 'acc' FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Asg', 'Set', 'assignment', CASE WHEN k % 4 = 0 THEN 'Loop1' END, NULL, NULL, NULL FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Loop1', 'Each', 'loop', 'Asg', NULL, NULL, NULL FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Act', 'Run', 'actionCall', CASE WHEN k % 5 = 0 THEN 'Sub' END, NULL, NULL, concat('Cls_', c) FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Sub', 'More', 'subflow', NULL, NULL, NULL, concat('Flow_', c) FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Lost', 'Lost', 'screen', NULL, NULL, NULL, NULL FROM {O} o WHERE k % 7 = 0
"""


@query("flow_elements", ELEMENTS)
def flow_elements(spark, root):
    return fl.elements(documents(spark, root, fl.ELEMENT_SCHEMA))


@query("flow_edges", f"""
SELECT org_id, flow_id, unnest(['Check', 'Check', 'Upd', 'Look', 'Loop1', 'Loop1']) AS src, unnest(['Upd', 'Look', 'Act', 'Loop1', 'Asg', 'Act']) AS dst FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Upd', 'Look' FROM {O} o WHERE k % 3 = 0 UNION ALL SELECT org_id, flow_id, 'Asg', 'Loop1' FROM {O} o WHERE k % 4 = 0
UNION ALL SELECT org_id, flow_id, 'Act', 'Sub' FROM {O} o WHERE k % 5 = 0
""")
def flow_edges(spark, root):
    return fl.edges(documents(spark, root, fl.ELEMENT_SCHEMA))


UNREACHED = "concat_ws(',', CASE WHEN k % 6 = 0 THEN 'Cre' END, CASE WHEN k % 7 = 0 THEN 'Lost' END, CASE WHEN k % 5 <> 0 THEN 'Sub' END)"
NO_FAULT = "concat_ws(',', 'Act', CASE WHEN k % 6 = 0 THEN 'Cre' END, 'Look', CASE WHEN k % 3 <> 0 THEN 'Upd' END)"


@query("flow_graphs", f"""
SELECT org_id, flow_id, 'Check' AS start, k % 4 = 0 AS has_cycles, (7 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS elements, {UNREACHED} AS unreachable,
  {NO_FAULT} AS without_fault_path, CASE WHEN k % 4 <> 0 THEN (3 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) END::BIGINT AS max_depth,
  CASE WHEN k % 4 = 0 THEN '' ELSE concat_ws(',', 'Check', CASE WHEN k % 6 = 0 THEN 'Cre' END, CASE WHEN k % 7 = 0 THEN 'Lost' END, CASE WHEN k % 5 <> 0 THEN 'Sub' END,
    CASE WHEN k % 3 = 0 THEN 'Upd,Look' ELSE 'Look,Upd' END, 'Loop1', 'Act', 'Asg', CASE WHEN k % 5 = 0 THEN 'Sub' END) END AS topological_order FROM {O} o
""")
def flow_graphs(spark, root):
    return fl.graphs(documents(spark, root, fl.ELEMENT_SCHEMA))


@query("flow_conditions", f"""
SELECT org_id, flow_id, 'start' AS place, NULL::VARCHAR AS element, NULL::VARCHAR AS rule, 'and' AS logic, '1' AS postfix, 1::BIGINT AS position, 'Status__c' AS field, 'EqualTo' AS operator,
  'literal' AS value_kind, 'x' AS value FROM {O} o WHERE k % 2 = 0
UNION ALL SELECT org_id, flow_id, 'rule', 'Check', 'R1', 'and', '1', 1, '$Record.A__c', 'EqualTo', 'literal', 'true' FROM {O} o
UNION ALL SELECT org_id, flow_id, 'lookup', 'Look', NULL, 'and', '1', 1, 'Name', 'EqualTo', 'reference', '$Record.Name' FROM {O} o
""")
def flow_conditions(spark, root):
    return fl.conditions(documents(spark, root))


@query("flow_scheduled_paths", f"""
SELECT org_id, flow_id, 'Later' AS name, 2::BIGINT AS offset_number, 'Days' AS offset_unit, NULL::VARCHAR AS base_field, 'RecordField' AS time_source FROM {O} o WHERE k % 8 = 0
""")
def flow_scheduled_paths(spark, root):
    return fl.scheduled_paths(documents(spark, root))


@query("flow_assignments", f"""
SELECT org_id, flow_id, 'Asg' AS element, unnest([1, 2, 3, 4])::BIGINT AS position, unnest(['$Record.Amount__c', 'acc.Pkg__Name__c', 'loose.Other__c', 'plain']) AS target,
  unnest(['Assign', 'Assign', 'Assign', 'Add']) AS operator, unnest(['global', 'formula', 'unparsed', 'literal']) AS value_kind, unnest(['$User.Id', '1+1', 'unparsed', '5']) AS value FROM {O} o
""")
def flow_assignments(spark, root):
    return fl.assignments(documents(spark, root))


@query("flow_actions", f"""
SELECT org_id, flow_id, 'Act' AS element, CASE WHEN c % 3 = 0 THEN 'emailAlert' ELSE 'apex' END AS action_type, concat('Cls_', c) AS action_name, 'id=$Record.Id' AS inputs, 'out' AS outputs,
  CASE WHEN c % 3 = 0 THEN 'standard_action' ELSE 'pending' END AS resolution FROM {O} o
""")
def flow_actions(spark, root):
    return fl.actions(documents(spark, root))


@query("flow_subflows", f"SELECT org_id, flow_id, 'Sub' AS element, concat('Flow_', c) AS subflow FROM {O} o")
def flow_subflows(spark, root):
    return fl.subflows(documents(spark, root))


@query("flow_field_writes", f"""
SELECT org_id, flow_id, 'Status__c' AS field, obj AS object, 'recordUpdate' AS element_type, 'Upd' AS element, 'high' AS confidence, 'literal' AS value_kind,
  CASE WHEN k % 5 = 0 THEN '(blank)' ELSE 'done' END AS value, k % 5 = 0 AS is_blank FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Amount__c', obj, 'assignment', 'Asg', 'high', 'global', '$User.Id', FALSE FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Pkg__Name__c', NULL, 'assignment', 'Asg', 'medium', 'formula', '1+1', FALSE FROM {O} o WHERE k % 6 = 0
""")
def flow_field_writes(spark, root):
    return fl.field_writes(documents(spark, root))


@query("flow_objects", f"""
SELECT org_id, flow_id, obj AS object, TRUE AS reads, TRUE AS writes FROM {O} o UNION ALL SELECT org_id, flow_id, 'Account', TRUE, FALSE FROM {O} o
UNION ALL SELECT org_id, flow_id, 'Log__c', FALSE, TRUE FROM {O} o WHERE k % 6 = 0
""")
def flow_objects(spark, root):
    return fl.objects(documents(spark, root))


@query("flow_value_nodes", f"""
SELECT org_id, flow_id, (7 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + 2 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END)::BIGINT AS values_total, 1::BIGINT AS values_unparsed FROM {O} o
""")
def flow_value_nodes(spark, root):
    return fl.value_nodes(documents(spark, root))


GUARDED = "(k % 2 = 0 AND k % 5 = 0)"
FLAGS = f"""
SELECT org_id, flow_id, 'self_referential_update' AS flag FROM {O} o WHERE c % 2 = 0
UNION ALL SELECT org_id, flow_id, 'loop_guard_detected' FROM {O} o WHERE {GUARDED}
UNION ALL SELECT org_id, flow_id, 'loop_guard_missing' FROM {O} o WHERE c % 2 = 0 AND NOT {GUARDED} AND k % 3 = 1
UNION ALL SELECT org_id, flow_id, 'writes_managed_package_fields' FROM {O} o WHERE k % 6 = 0 AND k % 11 <> 0
UNION ALL SELECT org_id, flow_id, 'no_fault_path' FROM {O} o UNION ALL SELECT org_id, flow_id, 'unreachable_elements' FROM {O} o WHERE {UNREACHED} <> ''
"""


@query("flow_flags", FLAGS)
def flow_flags(spark, root):
    return fl.flags(documents(spark, root))


UPDATES = """(SELECT CASE WHEN c_custkey % 5 = 0 THEN concat('Update', c_custkey) ELSE concat('Obj', c_custkey % 4, '__c.Update', c_custkey) END AS component_id, concat('Obj', c_custkey % 4, '__c') AS object,
  concat('Field_', c_custkey % 10, '__c') AS field, concat(CASE WHEN c_custkey % 3 = 0 THEN 'Parent__r.' ELSE '' END, 'Field_', c_custkey % 10, '__c') AS field_path,
  CASE WHEN c_custkey % 2 = 0 THEN 'Formula' ELSE 'Null' END AS operation, CASE c_custkey % 4 WHEN 0 THEN 'formula' WHEN 1 THEN 'literal' ELSE 'operation' END AS value_kind,
  CASE c_custkey % 4 WHEN 0 THEN 'NOW()' WHEN 1 THEN 'L' WHEN 2 THEN 'Formula' ELSE 'Null' END AS value FROM {customer} WHERE c_custkey % 7 <> 0)"""


@query("field_updates", f"SELECT * FROM {UPDATES} u")
def field_updates(spark, root):
    return fl.field_updates(fv.field_update_documents(spark, root))


@query("object_entry_points", f"""
SELECT org_id, object, {', '.join(f"sum(CASE WHEN bucket = '{b}' THEN 1 ELSE 0 END)::BIGINT AS {b}" for b in ('before_save_flows', 'after_save_flows', 'apex_triggers', 'process_builder', 'workflow_field_updates', 'self_referential_automation'))} FROM (
  SELECT org_id, obj AS object, CASE WHEN k % 9 = 0 THEN 'process_builder' WHEN c % 2 = 0 THEN 'after_save_flows' ELSE 'before_save_flows' END AS bucket FROM {O} o
  UNION ALL SELECT org_id, obj, 'self_referential_automation' FROM {O} o WHERE c % 2 = 0
  UNION ALL SELECT concat('org_', s_suppkey % 5), CASE WHEN s_suppkey % 2 = 0 THEN 'Account' ELSE 'Order__c' END, 'apex_triggers' FROM {{supplier}}
  UNION ALL SELECT 'org_0', object, 'workflow_field_updates' FROM {UPDATES} u) b GROUP BY 1, 2
""")
def object_entry_points(spark, root):
    flows = documents(spark, root)
    trig = sc.triggers(sc.prepared(sv.trigger_sources(spark, root)))
    updates = field_updates(spark, root).withColumn("org_id", F.lit("org_0"))
    return fl.entry_point_counts(fl.entry_points(flows, trig, updates))
