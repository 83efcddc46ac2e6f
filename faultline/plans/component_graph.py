"""Component graph, field writer and lookup queries."""

from pyspark.sql import functions as F

from faultline.operators import component_graph as g
from faultline.plans.registry import query
from faultline.sources import component_views  # noqa: F401  registers its views
from faultline.sources.views import view

FIELD = "Field_7__c"

# ---- for check SQL ----------------------------------------------------------
CARDS = """(SELECT *, namespace IS NOT NULL AND namespace <> 'Own' AS is_managed, NOT (namespace IS NOT NULL AND namespace <> 'Own') AS is_customer_authored FROM <cards> c0)"""
ASYNC = "('System.enqueueJob', 'Database.executeBatch', 'System.schedule', 'System.scheduleBatch')"
PATH = """CASE type WHEN 'ApexClass' THEN concat('classes/', component_id, '.cls') WHEN 'ApexInterface' THEN concat('classes/', component_id, '.cls')
  WHEN 'ApexTrigger' THEN concat('triggers/', component_id, '.trigger') WHEN 'Flow' THEN concat('flows/', component_id, '.flow')
  WHEN 'LWC' THEN concat('lwc/', component_id) WHEN 'WorkflowFieldUpdate' THEN concat('workflow/', component_id) END"""
DML = "(SELECT DISTINCT org_id, component AS component_id FROM <field_writes> w0 WHERE persistence = 'persisted')"
TOUCH = f"""(SELECT DISTINCT * FROM (SELECT org_id, object, 'read' AS role, component_id FROM <cards> c WHERE type IN ('ApexClass', 'ApexTrigger') AND object IS NOT NULL
  UNION ALL SELECT org_id, object, 'write', component_id FROM <cards> c JOIN {DML} d USING (org_id, component_id) WHERE type IN ('ApexClass', 'ApexTrigger') AND object IS NOT NULL
  UNION ALL SELECT org_id, object, CASE type WHEN 'ApexTrigger' THEN 'trigger' WHEN 'Flow' THEN 'flow' ELSE 'workflow' END, component_id FROM <cards> c
    WHERE type IN ('ApexTrigger', 'Flow', 'WorkflowFieldUpdate') AND object IS NOT NULL) t)"""
COUNTS = f"""(SELECT org_id, object, {', '.join(f"sum(CASE WHEN role = '{r}' THEN 1 ELSE 0 END)::BIGINT AS n_{r}" for r in ('read', 'write', 'trigger', 'flow', 'workflow'))},
  count(*) AS touches FROM {TOUCH} t GROUP BY 1, 2)"""
PRIMARY = """(SELECT org_id, component_id, max(nm) = 1 AS is_named FROM (SELECT org_id, component_id, 1 AS nm FROM <named_components> n
  UNION ALL SELECT e.org_id, dst, 0 FROM <call_edges> e WHERE (org_id, src) IN (SELECT org_id, component_id FROM <named_components> n)
  UNION ALL SELECT e.org_id, src, 0 FROM <call_edges> e WHERE (org_id, dst) IN (SELECT org_id, component_id FROM <named_components> n)) r
  WHERE (org_id, component_id) IN (SELECT org_id, component_id FROM <cards> c) GROUP BY 1, 2)"""
RECENT = f"""(SELECT c.org_id, c.component_id, round_even(age_seconds / 86400.0::DOUBLE, 1) AS age_days FROM <cards> c JOIN {PRIMARY} p USING (org_id, component_id)
  JOIN <component_manifest> m ON m.org_id = c.org_id AND m.path = {PATH.replace('component_id', 'c.component_id')} WHERE age_seconds / 86400.0::DOUBLE <= 14)"""
FIELD_TOUCH = """(SELECT org_id, field, component, mechanism, risk, source_map, arg_min(persistence, (write_id, seq)) AS persistence, min(write_id) AS write_id,
  CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS risk_rank FROM <field_writes> w GROUP BY 1, 2, 3, 4, 5, 6)"""
HINT = "contains(lower(component_id), 'test') OR contains(lower(component_id), 'mock')"
WRITERS = f"""(SELECT t.org_id, field, component, mechanism, risk, source_map, persistence, type AS card_type, round_even(age_seconds / 86400.0::DOUBLE, 1) AS age_days,
  coalesce(is_test_flag, FALSE) AS is_test_class, CASE WHEN is_test_flag IS NOT NULL THEN 'isTest_annotation' ELSE 'no_annotation_recorded' END AS test_class_detected_by,
  coalesce(is_customer_authored, TRUE) AS is_customer_authored, namespace, CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'declarative' THEN 2 ELSE 3 END AS risk_rank
  FROM {FIELD_TOUCH} t LEFT JOIN {CARDS} c ON c.org_id = t.org_id AND c.component_id = t.component LEFT JOIN <component_manifest> m ON m.org_id = c.org_id AND m.path = {PATH.replace('component_id', 'c.component_id')})"""
WRITER_SUMMARY = f"""(SELECT org_id, field, count(*) AS total_writers, sum(CASE WHEN is_test_class THEN 0 ELSE 1 END)::BIGINT AS production_writers,
  sum(CASE WHEN is_test_class THEN 1 ELSE 0 END)::BIGINT AS test_class_writers, sum(CASE WHEN NOT is_test_class AND persistence = 'persisted' THEN 1 ELSE 0 END)::BIGINT AS production_writers_with_dml
  FROM {WRITERS} w GROUP BY 1, 2)"""
PRESENT = """(SELECT DISTINCT org_id, component AS component_id, 'field_writes' AS section FROM <field_writes> w
  UNION SELECT DISTINCT org_id, caller, 'call_sites' FROM <call_sites> s UNION SELECT DISTINCT org_id, component_id, 'entry_points' FROM <entry_point_rows> e)"""
# -----------------------------------------------------------------------------


def cards(spark, root):
    return g.with_ownership(view(spark, root, "cards"), "Own")


def present(spark, root):
    return (
        view(spark, root, "field_writes").select("org_id", F.col("component").alias("component_id"), F.lit("field_writes").alias("section"))
        .unionByName(view(spark, root, "call_sites").select("org_id", F.col("caller").alias("component_id"), F.lit("call_sites").alias("section")))
        .unionByName(view(spark, root, "entry_point_rows").select("org_id", "component_id", F.lit("entry_points").alias("section")))
        .distinct()
    )


def primary(spark, root):
    return g.expansion(view(spark, root, "named_components"), view(spark, root, "call_edges"), cards(spark, root))


@query("managed_cards", f"""
SELECT org_id, component_id, namespace, is_managed, is_customer_authored, coalesce(namespace = 'Own', FALSE) AS in_org_namespace,
  CASE WHEN is_managed THEN 'listed' WHEN type = 'Flow' AND NOT loc > 20 THEN 'skipped' ELSE 'parsed' END AS handling FROM {CARDS} c
""")
def managed_cards(spark, root):
    split = g.managed_split(cards(spark, root).withColumn("is_active", F.col("loc") > 20))
    return split.select("org_id", "component_id", "namespace", "is_managed", "is_customer_authored", "in_org_namespace", "handling")


@query("test_class_verdict", """
SELECT org_id, component_id, coalesce(is_test_flag, contains(lower(label), 'test') OR contains(lower(label), 'mock')) AS is_test,
  CASE WHEN is_test_flag IS NOT NULL THEN 'isTest_annotation' WHEN contains(lower(label), 'test') OR contains(lower(label), 'mock') THEN 'name_heuristic' ELSE 'no_annotation_recorded' END AS how FROM <cards> c
""")
def test_class_verdict(spark, root):
    is_test, how = g.test_verdict(F.col("label"), F.col("is_test_flag"))
    return cards(spark, root).select("org_id", "component_id", is_test.alias("is_test"), how.alias("how"))


@query("merged_index", """
SELECT coalesce(b.org_id, a.org_id) AS org_id, coalesce(b.component_id, a.component_id) AS component_id, coalesce(b.type, a.type) AS type
FROM <cards> a FULL JOIN (SELECT DISTINCT org_id, concat('Part_', CAST(s_suppkey AS VARCHAR)) AS component_id, 'WorkflowFieldUpdate' AS type FROM <org_warnings> w0
  JOIN {supplier} ON org_id = concat('org_', CAST(s_suppkey % 5 AS VARCHAR))) b ON b.org_id = a.org_id AND b.component_id = a.component_id
""")
def merged_index(spark, root):
    from faultline.sources.tables import bind

    updates = bind(spark, root, """SELECT concat('org_', CAST(s_suppkey % 5 AS STRING)) AS org_id,
      concat('Part_', CAST(s_suppkey AS STRING)) AS component_id, 'WorkflowFieldUpdate' AS type FROM {supplier}""")
    return g.merged_index(view(spark, root, "cards").select("org_id", "component_id", "type"), updates)


@query("call_graph", """
SELECT org_id, component_id, sum(o)::BIGINT AS calls, sum(i)::BIGINT AS called_by FROM (
  SELECT org_id, src AS component_id, 1 AS o, 0 AS i FROM (SELECT DISTINCT org_id, src, dst FROM <call_edges> e) a
  UNION ALL SELECT org_id, dst, 0, 1 FROM (SELECT DISTINCT org_id, src, dst FROM <call_edges> e) b) d GROUP BY 1, 2
""")
def call_graph(spark, root):
    return g.degrees(view(spark, root, "call_edges"))


@query("inbound_references", f"""
SELECT org_id, dst AS target, src AS caller, via, 'dispatch' AS source FROM <call_edges> e WHERE via IN {ASYNC} AND src <> dst
UNION ALL SELECT org_id, dst, src, string_agg(via, ',' ORDER BY via), 'call' FROM <call_edges> e WHERE via NOT IN {ASYNC}
  AND NOT (via = 'constructor' AND (org_id, src, dst) IN (SELECT org_id, src, dst FROM <call_edges> d WHERE via IN {ASYNC} AND src <> dst)) GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT org_id, split_part(import_name, '.', 1), bundle, 'lwc_apex_import', 'ui' FROM <ui_imports> u
UNION ALL SELECT org_id, action_name, flow_id, 'actionCall', 'flow' FROM <flow_action_rows> a WHERE action_type = 'apex'
UNION ALL SELECT org_id, subflow, flow_id, 'subflow', 'flow' FROM <subflow_calls> s
""")
def inbound_references(spark, root):
    return g.inbound(*[view(spark, root, v) for v in ("call_edges", "ui_imports", "flow_action_rows", "subflow_calls")])


@query("inbound_call_sites", """
SELECT org_id, lower_target, caller, position, method_called, caller_method, line, in_loop, kind, total FROM (
  SELECT *, lower(target) AS lower_target, row_number() OVER (PARTITION BY org_id, lower(target), caller ORDER BY site_no, line) AS position,
    count(*) OVER (PARTITION BY org_id, lower(target), caller) AS total FROM <call_sites> s WHERE kind <> 'same_class') x
""")
def inbound_call_sites(spark, root):
    return g.inbound_sites(view(spark, root, "call_sites"))


@query("inbound_of_method", """
SELECT DISTINCT org_id, lower(dst) AS lower_target, src AS caller, 'call_site' AS found_by FROM <call_edges> e WHERE (org_id, lower(dst), src) IN (
  SELECT org_id, lower(target), caller FROM <call_sites> s WHERE kind <> 'same_class' AND lower(method_called) = 'run3')
UNION ALL SELECT DISTINCT org_id, lower(split_part(import_name, '.', 1)), bundle, 'import' FROM <ui_imports> u WHERE lower(split_part(import_name, '.', 2)) = 'run3'
""")
def inbound_of_method(spark, root):
    return g.inbound_of_method(*[view(spark, root, v) for v in ("call_edges", "call_sites", "ui_imports")], "Run3")


@query("inbound_case_variants", """
SELECT org_id, lower(dst) AS lower_target, min(dst) AS target, count(DISTINCT dst) AS variants, count(DISTINCT src) AS callers FROM <call_edges> e GROUP BY 1, 2
""")
def inbound_case_variants(spark, root):
    return g.merged_case_variants(view(spark, root, "call_edges"))


@query("managed_call_targets", f"""
SELECT s.org_id, site_no, line, caller, target, CASE WHEN m.component_id IS NOT NULL AND kind <> 'same_class' THEN 'managed_package_class' ELSE kind END AS kind,
  CASE WHEN kind <> 'same_class' THEN namespace END AS namespace
FROM <call_sites> s LEFT JOIN (SELECT * FROM {CARDS} c WHERE is_managed) m ON m.org_id = s.org_id AND lower(m.component_id) = lower(target)
""")
def managed_call_targets(spark, root):
    return g.mark_managed(view(spark, root, "call_sites"), cards(spark, root))


@query("async_invocations", f"""
SELECT j.org_id, j.component_id, kind, src AS invoked_by, via FROM (SELECT * FROM <entry_point_rows> e WHERE kind IN ('Queueable', 'Batchable', 'Schedulable') AND NOT is_inner) j
LEFT JOIN (SELECT * FROM <call_edges> e WHERE via IN {ASYNC} AND src <> dst) a ON a.org_id = j.org_id AND a.dst = j.component_id
""")
def async_invocations(spark, root):
    return g.async_invocations(view(spark, root, "entry_point_rows"), view(spark, root, "call_edges"))


@query("flow_action_resolution", """
SELECT a.org_id, flow_id, element_no, element_pos, action_name, CASE WHEN action_type <> 'apex' THEN 'standard_action' WHEN c.component_id IS NULL THEN 'class_not_in_kb'
    WHEN n = 1 THEN 'unique_invocable_in_class' WHEN n > 1 THEN 'ambiguous' ELSE 'class_not_in_kb' END AS resolution,
  CASE WHEN action_type = 'apex' THEN CASE WHEN c.component_id IS NULL THEN 'class unknown' WHEN n IS NULL THEN 'no invocable method' END END AS note,
  CASE WHEN action_type = 'apex' AND n = 1 THEN replace(m, '()', '') END AS resolved_method
FROM <flow_action_rows> a LEFT JOIN <cards> c ON c.org_id = a.org_id AND c.component_id = action_name
LEFT JOIN (SELECT org_id, component_id, count(*) AS n, min(detail) AS m FROM <entry_point_rows> e WHERE kind = 'InvocableMethod' GROUP BY 1, 2) i ON i.org_id = c.org_id AND i.component_id = c.component_id
""")
def flow_action_resolution(spark, root):
    return g.resolve_actions(view(spark, root, "flow_action_rows"), view(spark, root, "entry_point_rows"), cards(spark, root))


@query("component_id_resolution", f"""
SELECT q.org_id, request_id, raw, CASE WHEN fits THEN c.component_id END AS component_id,
  CASE WHEN fits THEN CASE WHEN raw LIKE '%.run' THEN 'run' WHEN raw LIKE '%.doIt' THEN 'doIt' END END AS method,
  CASE WHEN fits THEN CASE WHEN contains(raw, '.') THEN 'qualified' WHEN trim(raw) = c.component_id THEN 'exact' ELSE 'any case' END END AS how
FROM (SELECT *, CASE WHEN lower(raw) LIKE 'pkg.%' THEN 'pkg' WHEN lower(raw) LIKE 'other.%' THEN 'other' END AS ns FROM <id_requests> r) q
LEFT JOIN (SELECT org_id, component_id, namespace, is_managed, CAST(split_part(component_id, '_', 2) AS BIGINT) AS no FROM {CARDS} c0) c ON c.org_id = q.org_id AND c.no = request_id
LEFT JOIN (SELECT org_id AS o2, request_id AS r2, NOT starts_with(trim(raw), 'Nope') AS known FROM <id_requests> r) k ON k.o2 = q.org_id AND k.r2 = request_id
CROSS JOIN LATERAL (SELECT known AND (ns IS NULL OR CASE WHEN namespace IS NOT NULL THEN ns = lower(namespace) ELSE is_managed END) AS fits) f
""")
def component_id_resolution(spark, root):
    return g.resolve_ids(view(spark, root, "id_requests"), cards(spark, root))


@query("context_expansion", f"SELECT * FROM {PRIMARY} p")
def context_expansion(spark, root):
    return primary(spark, root)


@query("object_touch", f"SELECT * FROM {COUNTS} c")
def object_touch(spark, root):
    return g.touch_counts(g.object_touch(cards(spark, root), view(spark, root, "field_writes")))


@query("most_referenced_objects", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY touches DESC, object) AS place FROM {COUNTS} c) x WHERE place <= 20
""")
def most_referenced_objects(spark, root):
    return g.most_referenced(object_touch(spark, root))


@query("incident_objects", f"""
SELECT o.org_id, o.object, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('n_read', 'n_write', 'n_trigger', 'n_flow', 'n_workflow', 'touches'))} FROM (
  SELECT org_id, object FROM <cards> c JOIN {PRIMARY} p USING (org_id, component_id) WHERE is_named AND object IS NOT NULL
  UNION SELECT org_id, concat('Obj', substr(warning, 6, 1), '__c') FROM <org_warnings> w WHERE warning LIKE 'note %') o LEFT JOIN {COUNTS} t ON t.org_id = o.org_id AND t.object = o.object
""")
def incident_objects(spark, root):
    extra = view(spark, root, "org_warnings").filter("warning LIKE 'note %'").select(
        "org_id", F.concat(F.lit("Obj"), F.substring("warning", 6, 1), F.lit("__c")).alias("object")
    )
    return g.incident_objects(primary(spark, root), cards(spark, root), object_touch(spark, root), extra)


@query("recently_changed", f"SELECT * FROM {RECENT} r")
def recently_changed(spark, root):
    return g.recently_changed(primary(spark, root), cards(spark, root), view(spark, root, "component_manifest"))


@query("suspect_ranking", f"""
SELECT p.org_id, p.component_id, type, age_days, round_even((CASE WHEN is_named THEN 50 ELSE 0 END + CASE WHEN age_days IS NOT NULL THEN greatest(5.0::DOUBLE, 40.0::DOUBLE - age_days) ELSE 0 END
  + CASE WHEN w.component_id IS NOT NULL THEN 35 ELSE 0 END + CASE type WHEN 'ApexTrigger' THEN 15 WHEN 'Flow' THEN 12 ELSE 0 END + CASE WHEN d.component_id IS NOT NULL THEN 8 ELSE 0 END
  + CASE WHEN loc > 25 THEN 8 ELSE 0 END - CASE WHEN coalesce(is_test_flag, {HINT.replace('component_id', 'p.component_id')}) THEN 40 ELSE 0 END - CASE WHEN is_managed THEN 25 ELSE 0 END)::DOUBLE, 1) AS score
FROM {PRIMARY} p JOIN {CARDS} c ON c.org_id = p.org_id AND c.component_id = p.component_id LEFT JOIN {RECENT} r ON r.org_id = p.org_id AND r.component_id = p.component_id
LEFT JOIN (SELECT DISTINCT org_id, component AS component_id FROM <field_writes> w0 WHERE field = '{FIELD}') w ON w.org_id = p.org_id AND w.component_id = p.component_id
LEFT JOIN {DML} d ON d.org_id = p.org_id AND d.component_id = p.component_id
""")
def suspect_ranking(spark, root):
    told = cards(spark, root).withColumn("has_callout", F.col("loc") > 25)
    return g.suspects(primary(spark, root), told, view(spark, root, "component_manifest"), view(spark, root, "field_writes"), FIELD)


@query("suspect_field_pack", f"""
SELECT org_id, component_id, bool_or(is_named) AS is_named, bool_or(writes) AS writes_field FROM (SELECT org_id, component_id, is_named, FALSE AS writes FROM {PRIMARY} p
  UNION ALL SELECT org_id, component, FALSE, TRUE FROM <field_writes> w WHERE field = '{FIELD}' AND (org_id, component) IN (SELECT org_id, component_id FROM <cards> c)) x GROUP BY 1, 2
""")
def suspect_field_pack(spark, root):
    return g.with_writers(primary(spark, root), field_touch_map(spark, root), cards(spark, root), FIELD)


@query("field_touch_map", f"SELECT * FROM {FIELD_TOUCH} t")
def field_touch_map(spark, root):
    return g.field_touch(view(spark, root, "field_writes"))


@query("entry_criteria_fields", "SELECT DISTINCT org_id, field, component AS used_by FROM <field_writes> w WHERE in_filter")
def entry_criteria_fields(spark, root):
    return g.entry_criteria(view(spark, root, "field_writes"))


@query("field_writers", f"SELECT * FROM {WRITERS} w")
def field_writers(spark, root):
    return g.field_writers(field_touch_map(spark, root), cards(spark, root), view(spark, root, "component_manifest"))


@query("field_writer_summary", f"SELECT * FROM {WRITER_SUMMARY} s")
def field_writer_summary(spark, root):
    return g.field_summary(field_writers(spark, root))


ASKED = "(SELECT DISTINCT org_id, suspect_field AS field FROM (SELECT concat('org_', CAST(incident_id % 5 AS VARCHAR(20))) AS org_id, suspect_field FROM <incidents> i) x WHERE suspect_field IS NOT NULL)"


@query("suspect_field_warnings", f"""
SELECT a.org_id, a.field, coalesce(total_writers, 0) AS total_writers, CASE WHEN total_writers IS NULL THEN 'no automation writes it' WHEN production_writers = 0 THEN 'only test classes write it' END AS warning
FROM {ASKED} a LEFT JOIN {WRITER_SUMMARY} s ON s.org_id = a.org_id AND s.field = a.field
""")
def suspect_field_warnings(spark, root):
    asked = view(spark, root, "incidents").filter("suspect_field IS NOT NULL").select(
        F.concat(F.lit("org_"), (F.col("incident_id") % 5).cast("string")).alias("org_id"), F.col("suspect_field").alias("field")
    ).distinct()
    return g.suspect_fields(asked, field_writer_summary(spark, root))


@query("writers_by_mechanism", f"""
SELECT org_id, field, mechanism, count(*) AS writers, CASE mechanism WHEN 'Apex' THEN 0 WHEN 'Flow' THEN 1 WHEN 'Process Builder' THEN 2 ELSE 3 END AS place FROM {FIELD_TOUCH} t GROUP BY 1, 2, 3
""")
def writers_by_mechanism(spark, root):
    return g.by_mechanism(field_touch_map(spark, root))


STAT_NAMES = "apex_classes apex_triggers flows lwc_components workflow_field_updates test_classes customer_flows customer_code queueable_classes batchable_classes schedulable_classes future_classes fields_with_high_risk_writes fields_written_declaratively".split()
STATS = f"""(SELECT c.*, j.* EXCLUDE (org_id), f.* EXCLUDE (org_id) FROM (SELECT org_id, {', '.join(f"sum(CASE WHEN type = '{t}' THEN 1 ELSE 0 END)::BIGINT AS {k}" for k, (t, _w) in g.KINDS.items())},
    sum(CASE WHEN is_test_flag THEN 1 ELSE 0 END)::BIGINT AS test_classes, sum(CASE WHEN is_customer_authored AND type = 'Flow' THEN 1 ELSE 0 END)::BIGINT AS customer_flows,
    sum(CASE WHEN is_customer_authored AND type IN ('ApexClass', 'ApexTrigger', 'ApexInterface') THEN 1 ELSE 0 END)::BIGINT AS customer_code FROM {CARDS} c GROUP BY 1) c
  JOIN (SELECT org_id, {', '.join(f"count(DISTINCT CASE WHEN kind = '{k}' THEN component_id END) AS {k.lower()}_classes" for k in (*g.JOB_KINDS, 'future'))} FROM <entry_point_rows> e GROUP BY 1) j ON j.org_id = c.org_id
  JOIN (SELECT org_id, count(DISTINCT CASE WHEN risk = 'high' THEN field END) AS fields_with_high_risk_writes, count(DISTINCT CASE WHEN risk = 'declarative' THEN field END) AS fields_written_declaratively
    FROM <field_writes> w GROUP BY 1) f ON f.org_id = c.org_id)"""


@query("org_statistics", " UNION ALL ".join(f"SELECT org_id, '{n}' AS statistic, {n} AS value FROM {STATS} s" for n in STAT_NAMES))
def org_statistics(spark, root):
    return g.org_statistics(cards(spark, root), view(spark, root, "entry_point_rows"), view(spark, root, "field_writes"))


COVER = " UNION ALL ".join(
    f"""SELECT c.org_id, '{k}' AS kind, TRUE AS attempted, CASE WHEN EXISTS (SELECT 1 FROM <org_warnings> w WHERE w.org_id = c.org_id AND contains(lower(warning), '{w}')) THEN 'partial' ELSE 'ok' END AS status,
  sum(CASE WHEN type = '{t}' THEN 1 ELSE 0 END)::BIGINT AS count FROM <cards> c GROUP BY 1""" for k, (t, w) in g.KINDS.items()
) + "".join(f" UNION ALL SELECT DISTINCT org_id, '{k}', FALSE, 'not_supported', NULL::BIGINT FROM <cards> c" for k in g.NOT_COLLECTED)


@query("coverage", COVER)
def coverage(spark, root):
    return g.coverage(view(spark, root, "cards"), view(spark, root, "org_warnings"))


@query("coverage_exceptions", f"SELECT * FROM ({COVER}) c WHERE NOT attempted OR status <> 'ok'")
def coverage_exceptions(spark, root):
    return g.coverage_exceptions(coverage(spark, root))


@query("knowledgebase_search", f"""
(SELECT DISTINCT 'components' AS section, component_id AS name FROM {CARDS} c WHERE is_customer_authored AND contains(lower(component_id), '_1') ORDER BY name LIMIT 25)
UNION ALL (SELECT DISTINCT 'objects', object FROM {TOUCH} t WHERE contains(lower(object), '_1') ORDER BY object LIMIT 25)
UNION ALL (SELECT DISTINCT 'fields', field FROM <field_writes> w WHERE contains(lower(field), '_1') ORDER BY field LIMIT 25)
""")
def knowledgebase_search(spark, root):
    writes = view(spark, root, "field_writes")
    return g.search(cards(spark, root), g.object_touch(cards(spark, root), writes), writes, "_1")


@query("card_sections", f"""
SELECT c.org_id, c.component_id, array_to_string(list_sort(list_filter(['call_sites', 'entry_points', 'field_writes', 'nope'], lambda x: NOT list_contains(coalesce(have, []), x))), ',') AS missing
FROM <cards> c LEFT JOIN (SELECT org_id, component_id, list(section) AS have FROM {PRESENT} p GROUP BY 1, 2) h ON h.org_id = c.org_id AND h.component_id = c.component_id
""")
def card_sections(spark, root):
    return g.missing_sections(present(spark, root), cards(spark, root), ["field_writes", "call_sites", "entry_points", "nope"])


@query("card_method_filter", """
SELECT org_id, caller, 'call_sites' AS part, site_no, line, target, method_called FROM <call_sites> s WHERE caller_method = 'do3'
UNION ALL SELECT org_id, caller, 'called_from_in_class', site_no, line, target, method_called FROM <call_sites> s WHERE kind = 'same_class' AND method_called = 'do3'
""")
def card_method_filter(spark, root):
    return g.method_filter(view(spark, root, "call_sites"), "DO3")


@query("card_method_items", """
SELECT org_id, component_id, 'entry_points' AS section, length(detail) AS item_no FROM <entry_point_rows> e WHERE starts_with(detail, 'm7(')
UNION ALL SELECT org_id, flow_id, 'flow_actions', element_no FROM <flow_action_rows> f WHERE lower(action_name) = 'm7' OR element_pos = 7
UNION ALL SELECT org_id, caller, 'dispatches', site_no FROM <call_sites> s WHERE method_called = 'run7' OR caller_method = 'do7' AND line = 2
""")
def card_method_items(spark, root):
    text, names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    entries = view(spark, root, "entry_point_rows").select(
        "org_id", "component_id", F.lit("entry_points").alias("section"), F.length("detail").cast("bigint").alias("item_no"),
        names.alias("names"), text.alias("method_called"), "detail", names.alias("methods_called"),
    )
    actions = view(spark, root, "flow_action_rows").select(
        "org_id", F.col("flow_id").alias("component_id"), F.lit("flow_actions").alias("section"), F.col("element_no").alias("item_no"),
        F.array("action_name").alias("names"), text.alias("method_called"), text.alias("detail"), F.array(F.concat(F.lit("M"), F.col("element_pos").cast("string"))).alias("methods_called"),
    )
    # a job is told by the method that starts it and by its own
    jobs = view(spark, root, "call_sites").select(
        "org_id", F.col("caller").alias("component_id"), F.lit("dispatches").alias("section"), F.col("site_no").alias("item_no"),
        F.array(F.when(F.col("line") == 2, F.regexp_replace("caller_method", "^do", "m"))).alias("names"), F.regexp_replace("method_called", "^run", "m").alias("method_called"),
        text.alias("detail"), names.alias("methods_called"),
    )
    return g.method_items(entries.unionByName(actions).unionByName(jobs), "M7")


@query("stale_cards", f"""
SELECT org_id, component_id, extractor_version, missing FROM (SELECT c.org_id, c.component_id, extractor_version,
  concat_ws(',', CASE WHEN extractor_version = '3.1.0' THEN 'async_dispatches' END, CASE WHEN extractor_version <> '3.10.0' AND h.section IS NULL THEN 'call_sites' END) AS missing
FROM <cards> c LEFT JOIN (SELECT * FROM {PRESENT} p WHERE section = 'call_sites') h ON h.org_id = c.org_id AND h.component_id = c.component_id WHERE type IN ('ApexClass', 'ApexTrigger')) x WHERE missing <> ''
""")
def stale_cards(spark, root):
    return g.stale_cards(cards(spark, root), present(spark, root))


@query("org_stale_note", """
SELECT org_id, CASE v WHEN 1 THEN '3.1.0' WHEN 2 THEN '3.2.0' ELSE '3.10.0' END AS oldest, CASE v WHEN 1 THEN 'async_dispatches,call_sites' WHEN 2 THEN 'call_sites' ELSE '' END AS missing FROM (
  SELECT org_id, min(CASE extractor_version WHEN '3.1.0' THEN 1 WHEN '3.2.0' THEN 2 ELSE 3 END) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY component_id) AS r FROM <cards> c WHERE type IN ('ApexClass', 'ApexTrigger')) x GROUP BY 1) y
""")
def org_stale_note(spark, root):
    return g.org_stale(cards(spark, root))
