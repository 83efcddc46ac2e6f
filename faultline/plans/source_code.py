"""Extraction queries.  Their check SQL derives the expected rows from the keys of the source templates."""

from pyspark.sql import functions as F

from faultline.operators import org_index
from faultline.operators import source_code as sc
from faultline.plans import flows as flow_plans
from faultline.plans.registry import ORACLES, query
from faultline.session import scratch_path, written
from faultline.sources import flow_views as fv
from faultline.sources import source_views as sv
from faultline.sources.tables import table

P = "(SELECT *, p_partkey AS k, p_size AS s, concat('org_', CAST(p_partkey % 5 AS VARCHAR)) AS org_id, concat('Cls_', CAST(p_partkey AS VARCHAR)) AS component_id FROM {part})"
T = "(SELECT *, s_suppkey AS k, concat('org_', CAST(s_suppkey % 5 AS VARCHAR)) AS org_id, concat('Trg_', CAST(s_suppkey AS VARCHAR)) AS component_id FROM {supplier})"
JOB_KNOWN = "((k % 9) % 5 = k % 5 AND k % 9 IN (SELECT s_suppkey FROM {supplier}))"
CLS_KNOWN = "((k % 11) % 5 = k % 5 AND k % 11 IN (SELECT p_partkey FROM {part}))"


def classes(spark, root, shared=False, marks=()):
    """Sources and their statements, written once for a job that reads them in several ways: all (``shared``), or those that hold one of the ``marks``."""
    prep = sc.prepared(sv.class_sources(spark, root))
    stmts = sc.statements(prep)
    if marks:
        return prep, written(sc.holding(stmts, *marks), "statements")
    return prep, written(stmts, "statements") if shared else stmts


def trigger_rows(spark, root, marks=()):
    prep = sc.prepared(sv.trigger_sources(spark, root))
    stmts = sc.statements(prep, with_methods=False)
    return prep, written(sc.holding(stmts, *marks), "statements") if marks else stmts


@query("class_cards", f"""
SELECT org_id, component_id, 'ApexClass' AS type, CASE s % 3 WHEN 0 THEN 'with sharing' WHEN 1 THEN 'without sharing' ELSE 'inherited' END AS sharing,
  CASE WHEN s % 4 = 1 THEN concat('Base_', k % 7) WHEN k % 12 = 0 THEN 'Exception' END AS extends,
  CASE k % 6 WHEN 0 THEN 'Database.AllowsCallouts;Queueable' WHEN 1 THEN 'Database.Batchable<Id>;Database.Stateful' ELSE 'Queueable' END AS implements,
  (41 + CASE WHEN s % 5 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END)::BIGINT AS loc, FALSE AS is_test_class FROM {P} p
""")
def class_cards(spark, root):
    return sc.components(sc.prepared(sv.class_sources(spark, root)))


@query("trigger_cards", f"""
SELECT org_id, component_id, CASE WHEN k % 2 = 0 THEN 'Account' ELSE 'Order__c' END AS object, CASE WHEN k % 3 = 0 THEN 'before insert, after update' ELSE 'before insert' END AS events FROM {T} t
""")
def trigger_cards(spark, root):
    return sc.triggers(sc.prepared(sv.trigger_sources(spark, root)))


@query("source_entry_points", f"""
SELECT org_id, component_id, 'Queueable' AS kind, 'Queueable' AS detail, NULL::VARCHAR AS inner_class FROM {P} p WHERE k % 6 = 0
UNION ALL SELECT org_id, component_id, 'Batchable', 'Database.Batchable', NULL FROM {P} p WHERE k % 6 = 1
UNION ALL SELECT org_id, component_id, 'Queueable', 'Queueable (inner class Inner_Job)', 'Inner_Job' FROM {P} p
UNION ALL SELECT org_id, component_id, 'AuraEnabled', 'fetch()', NULL FROM {P} p
UNION ALL SELECT org_id, component_id, 'InvocableMethod', 'act()', NULL FROM {P} p WHERE k % 5 = 0
UNION ALL SELECT org_id, component_id, 'Trigger', concat(CASE WHEN k % 2 = 0 THEN 'Account' ELSE 'Order__c' END, ' (before insert', CASE WHEN k % 3 = 0 THEN ', after update' ELSE '' END, ')'), NULL FROM {T} t
""")
def source_entry_points(spark, root):
    return sc.entry_points(*classes(spark, root)).unionByName(sc.trigger_entry_points(sc.prepared(sv.trigger_sources(spark, root))))


@query("source_methods", f"""
SELECT org_id, component_id, 'run' AS name, 'run(Integer a, List<Id> ids)' AS signature, 'public' AS visibility, TRUE AS is_static, 'void' AS returns, '' AS annotations, 17::BIGINT AS loc, 5::BIGINT AS complexity FROM {P} p
UNION ALL SELECT org_id, component_id, 'fetch', 'fetch(String q)', 'public', TRUE, 'String', 'AuraEnabled', 10 + CASE WHEN s % 5 = 1 THEN 1 ELSE 0 END, 2 + CASE WHEN s % 5 = 3 THEN 1 ELSE 0 END FROM {P} p
UNION ALL SELECT org_id, component_id, 'act', 'act(List<Id> recordIds)', 'public', TRUE, 'void', 'InvocableMethod', 2, 1 FROM {P} p WHERE k % 5 = 0
UNION ALL SELECT org_id, component_id, 'execute', 'execute(QueueableContext ctx)', 'public', FALSE, 'void', '', 1, 1 FROM {P} p
""")
def source_methods(spark, root):
    return sc.methods(*classes(spark, root)).drop("no")


@query("source_queries", f"""
SELECT org_id, component_id, 14::BIGINT AS line, 'run' AS method, TRUE AS in_loop, FALSE AS is_dynamic, 'Account' AS object, 'Id,Name' AS fields, 'Id = :a' AS where_text, 'Name DESC' AS order_by,
  5::BIGINT AS limit_rows, FALSE AS enforces_fls, 'Contacts' AS subqueries FROM {P} p WHERE s % 3 = 0
UNION ALL SELECT org_id, component_id, 25, 'fetch', FALSE, TRUE, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {P} p
""")
def source_queries(spark, root):
    return sc.queries(classes(spark, root, marks=sc.QUERY_MARKS)[1])


@query("source_dml", f"""
SELECT org_id, component_id, 15::BIGINT AS line, 'run' AS method, TRUE AS in_loop, 'update' AS op, 'accList' AS receiver, TRUE AS is_bulk, NULL::VARCHAR AS via FROM {P} p WHERE s % 2 = 0
UNION ALL SELECT org_id, component_id, 19, 'run', FALSE, 'update', 'rec', FALSE, NULL FROM {P} p WHERE s % 2 = 1
UNION ALL SELECT org_id, component_id, 26, 'fetch', FALSE, 'insert', NULL, TRUE, 'Database.insert' FROM {P} p
UNION ALL SELECT org_id, component_id, 4, NULL, TRUE, 'insert', 's', FALSE, NULL FROM {T} t WHERE k % 4 = 0
""")
def source_dml(spark, root):
    both = sc.dml(classes(spark, root, marks=sc.DML_MARKS)[1]).unionByName(sc.dml(trigger_rows(spark, root, marks=sc.DML_MARKS)[1]))
    return both.drop("no")


EFFECT = "CASE k % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'debug_only' WHEN 2 THEN 'rethrow' WHEN 3 THEN 'wrap_rethrow' WHEN 4 THEN 'add_error' WHEN 5 THEN 'publishes_event' ELSE 'swallow' END"


@query("source_catch_handlers", f"""
SELECT org_id, component_id, 27::BIGINT AS line, 'fetch' AS method, 'DmlException' AS type, k % 7 = 3 AS wraps_and_rethrows, k % 7 = 2 AS rethrows, k % 7 = 4 AS adds_error, k % 7 = 5 AS publishes_event,
  FALSE AS persists_log, FALSE AS sends_email, k % 7 = 1 AS debug_only, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS statements, {EFFECT} AS effect FROM {P} p
""")
def source_catch_handlers(spark, root):
    return sc.catch_handlers(*classes(spark, root))


@query("source_static_state", f"SELECT org_id, component_id, 'cache' AS name, FALSE AS is_final, 'Map' AS collection, k % 8 = 0 AS reset_elsewhere FROM {P} p WHERE k % 2 = 0")
def source_static_state(spark, root):
    return sc.static_state(sc.prepared(sv.class_sources(spark, root)))


PERSIST = "CASE WHEN s % 2 = 1 THEN 19 END::BIGINT AS persisted_by, CASE WHEN s % 2 = 0 THEN 'audit' END AS passed_to, CASE WHEN s % 2 = 1 THEN 'persisted' ELSE 'passed_to_callee' END AS persistence"


FIELD_WRITES = f"""
SELECT org_id, component_id, 17::BIGINT AS line, 'run' AS method, 'Status__c' AS field, 'rec' AS receiver, 'map_lookup' AS pattern, 'cache' AS source_map,
  CASE WHEN k % 2 = 0 AND k % 8 <> 0 THEN 'high' ELSE 'medium' END AS risk,
  concat('read from cache', CASE WHEN k % 2 = 1 THEN ', not computed for this record' WHEN k % 8 = 0 THEN ', a static collection; check that its reset covers this path'
    ELSE ', a static collection that is never reset: a value of another record may remain' END) AS reason, 'string' AS value_type, 'cache.get(''x'')' AS value, {PERSIST} FROM {P} p
UNION ALL SELECT org_id, component_id, 18, 'run', 'Amount__c', 'rec', 'direct', NULL, 'low', NULL, CASE k % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' WHEN 2 THEN 'string' ELSE 'reference' END,
  CASE k % 4 WHEN 0 THEN '5' WHEN 1 THEN 'true' WHEN 2 THEN '''txt''' ELSE 'other.Value__c' END, {PERSIST} FROM {P} p
"""


@query("source_field_writes", FIELD_WRITES)
def source_field_writes(spark, root):
    return sc.field_writes(*classes(spark, root, marks=sc.WRITE_MARKS))


def _dispatches(spark, root):
    prep, stmts = classes(spark, root)
    return sc.async_dispatches(prep, stmts, sv.class_names(spark, root))


@query("source_async_dispatches", f"""
SELECT org_id, component_id, CASE s % 5 WHEN 2 THEN 'Database.executeBatch' WHEN 3 THEN 'System.schedule' ELSE 'System.enqueueJob' END AS mechanism, CASE WHEN s % 5 = 1 THEN 31 ELSE 30 END::BIGINT AS line,
  'fetch' AS method, FALSE AS in_loop, CASE s % 5 WHEN 1 THEN 'variable_assignment' WHEN 2 THEN 'this' ELSE 'constructor' END AS resolution,
  CASE WHEN s % 5 IN (2, 3) THEN component_id ELSE concat('Job_', k % 9) END AS target, CASE WHEN s % 5 = 3 THEN 'Inner_Job' END AS inner_class,
  s % 5 IN (2, 3) OR {JOB_KNOWN} AS target_in_kb, CASE WHEN s % 5 = 0 THEN '2' END AS delay_minutes, CASE WHEN s % 5 = 2 THEN '50' END AS scope_size,
  CASE WHEN s % 5 = 3 THEN 'nightly' END AS job_name, CASE WHEN s % 5 = 3 THEN '0 0 1 * * ?' END AS cron FROM {P} p WHERE s % 5 <> 4
""")
def source_async_dispatches(spark, root):
    return _dispatches(spark, root)


CALLS_TO = f"""
SELECT org_id, component_id, concat('Cls_', k % 11) AS target, CASE WHEN {CLS_KNOWN} THEN 'local_class' ELSE 'unresolved_receiver' END AS kind, 'method_call' AS via, 'check' AS methods_called, NULL::VARCHAR AS namespace
  FROM {P} p WHERE k % 11 <> k
UNION ALL SELECT org_id, component_id, concat('Helper_', k % 4), 'namespaced_class', 'method_call', 'other', 'PKG_CORE' FROM {P} p
UNION ALL SELECT org_id, component_id, concat('Job_', k % 9), 'local_class', 'System.enqueueJob,constructor', '', NULL FROM {P} p WHERE s % 5 IN (0, 1) AND {JOB_KNOWN}
"""


@query("source_calls_to", CALLS_TO)
def source_calls_to(spark, root):
    prep, stmts = classes(spark, root, shared=True)
    names = sv.class_names(spark, root)
    return sc.calls_to(stmts, names, sc.async_dispatches(prep, stmts, names))


CALL_SITES = f"""
SELECT org_id, component_id, row_number() OVER (PARTITION BY org_id, component_id ORDER BY line) AS position, * EXCLUDE (org_id, component_id) FROM (
SELECT org_id, component_id, 7::BIGINT AS line, 'run' AS method, FALSE AS in_loop, 'org_class' AS kind, concat('Cls_', k % 11) AS target, NULL::VARCHAR AS namespace, 'check' AS method_called,
  concat('Cls_', k % 11, '.check') AS callee, 'if (a > 0)' AS conditions FROM {P} p WHERE k % 11 <> k AND {CLS_KNOWN}
UNION ALL SELECT org_id, component_id, 9, 'run', FALSE, 'namespaced_class', concat('Helper_', k % 4), 'PKG_CORE', 'other', concat('PKG_CORE.Helper_', k % 4, '.other'), 'else if (a < 0 && ids != null) [and not: a > 0]' FROM {P} p
UNION ALL SELECT org_id, component_id, 11, 'run', FALSE, 'same_class', component_id, NULL, 'fetch', concat(component_id, '.fetch'), 'else [not: a > 0 / a < 0 && ids != null]' FROM {P} p
UNION ALL SELECT org_id, component_id, 3, NULL, TRUE, 'org_class', concat('Cls_', k), NULL, 'run', concat('Cls_', k, '.run'), 'for (SObject s : Trigger.new)' FROM {T} t WHERE k IN (SELECT p_partkey FROM {{part}})) x
"""


@query("source_call_sites", CALL_SITES)
def source_call_sites(spark, root):
    names = sv.class_names(spark, root)
    both = classes(spark, root)[1].unionByName(trigger_rows(spark, root)[1])
    return sc.call_sites(written(both, "statements"), names)


@query("source_facts", f"""
SELECT org_id, component_id, k % 10 = 0 AS has_callout, CASE WHEN k % 10 = 0 THEN 'My_Cred/path' ELSE '' END AS credentials,
  CASE WHEN k % 7 = 3 THEN 'AppException' ELSE '' END AS exceptions_thrown, CASE WHEN k % 12 = 0 THEN 'AppException' ELSE '' END AS exceptions_defined FROM {P} p
""")
def source_facts(spark, root):
    return sc.facts(sc.prepared(sv.class_sources(spark, root)))


@query("source_objects", f"""
SELECT org_id, component_id, 'Quote' AS object FROM {P} p UNION ALL SELECT org_id, component_id, 'Account' FROM {P} p WHERE s % 3 = 0
UNION ALL SELECT org_id, component_id, 'Custom__c' FROM {P} p WHERE k % 5 = 0
UNION ALL SELECT org_id, component_id, 'Account' FROM {T} t WHERE k % 2 = 0 UNION ALL SELECT org_id, component_id, 'Order__c' FROM {T} t WHERE k % 2 = 1
""")
def source_objects(spark, root):
    # the org's own objects: those its triggers are on, and one more
    trig = sc.prepared(sv.trigger_sources(spark, root))
    known = sc.triggers(trig).select("object").filter("object LIKE '%\\\\_\\\\_c'").distinct().unionByName(
        table(spark, root, "region").select(F.lit("Custom__c").alias("object")).distinct()
    )
    code = sc.prepared(sv.class_sources(spark, root))
    return sc.objects_referenced(code, known).unionByName(sc.objects_referenced(trig, known))


FLAGS = f"""
SELECT org_id, component_id, 'silent_exception_handler' AS flag FROM {P} p WHERE k % 7 IN (0, 1, 6)
UNION ALL SELECT org_id, component_id, 'dml_in_loop' FROM {P} p WHERE s % 2 = 0
UNION ALL SELECT org_id, component_id, 'soql_in_loop' FROM {P} p WHERE s % 3 = 0
UNION ALL SELECT org_id, component_id, 'dynamic_soql' FROM {P} p
UNION ALL SELECT org_id, component_id, 'no_fls_enforcement' FROM {P} p WHERE s % 3 = 0
"""


def _flags(spark, root):
    return sc.flags(*classes(spark, root, marks=sc.FLAG_MARKS))


@query("class_flags", FLAGS)
def class_flags(spark, root):
    return _flags(spark, root)


@query("components_per_flag", f"SELECT flag, count(*) AS components FROM ({FLAGS}) f GROUP BY 1")
def components_per_flag(spark, root):
    return _flags(spark, root).groupBy("flag").agg(F.count(F.lit(1)).alias("components"))


@query("extract_errors", f"""
SELECT org_id, component_id, CASE WHEN k % 13 = 0 THEN 'empty source' ELSE 'unbalanced braces' END AS reason FROM {P} p WHERE k % 13 IN (0, 1)
""")
def extract_errors(spark, root):
    damaged = sv.class_sources(spark, root).withColumn(
        "code", F.when(F.col("p_partkey") % 13 == 0, " ").when(F.col("p_partkey") % 13 == 1, F.concat("code", F.lit("}"))).otherwise(F.col("code"))
    )
    return sc.extract_errors(damaged)


@query("bundle_files", f"""
SELECT split_part(file_path, '/', 2) AS bundle, split_part(file_path, '/', 3) AS file, sha256(source) AS content_sha256, length(source) AS chars FROM ({sv.BUNDLE_SOURCES}) f
""")
def bundle_files(spark, root):
    return sc.decoded_files(sv.bundle_files(spark, root)).select(
        "bundle", "file", F.sha2("content", 256).alias("content_sha256"), F.length("content").cast("bigint").alias("chars")
    )


@query("ui_bundles", """
SELECT concat('cmp', page_id) AS bundle, concat_ws(',', least(concat('Cls_', page_id % 7, '.load'), concat('Cls_', page_id, '.save')), greatest(concat('Cls_', page_id % 7, '.load'), concat('Cls_', page_id, '.save'))) AS imports,
  CASE WHEN page_id % 2 = 0 THEN 'getRecord,load' ELSE 'getRecord' END AS wires,
  array_to_string(list_sort(list_distinct(list_concat(['c-row', 'lightning-card'], regexp_extract_all(html, '<([a-z][a-z0-9]*-[a-z0-9-]+)\\b', 1)))), ',') AS children,
  page_id % 4 = 0 AS is_exposed, CASE WHEN page_id % 5 = 0 THEN 'lightning__RecordPage,lightning__AppPage' ELSE 'lightning__RecordPage' END AS targets FROM {pages}
""")
def ui_bundles(spark, root):
    return sc.ui_bundles(sc.decoded_files(sv.bundle_files(spark, root)))


# ---- extraction to index -------------------------------------------------------------


def _lookups(spark, root):
    return org_index.lookups(org_index.extract(
        sv.class_sources(spark, root).select("org_id", "component_id", "code"), sv.trigger_sources(spark, root).select("org_id", "component_id", "code"),
        sv.class_names(spark, root),
    ))


# triggers call the class of their own number
TRIGGER_CALLS = f"SELECT org_id, component_id, concat('Cls_', k) AS target FROM {T} t WHERE k IN (SELECT p_partkey FROM {{part}})"
EDGES = f"SELECT DISTINCT org_id, component_id, target FROM ({CALLS_TO}) c WHERE kind <> 'unresolved_receiver' UNION {TRIGGER_CALLS}"


@query("index_degrees", f"""
SELECT org_id, id AS component_id, sum(o)::BIGINT AS calls, sum(i)::BIGINT AS called_by FROM (
  SELECT org_id, component_id AS id, 1 AS o, 0 AS i FROM ({EDGES}) e UNION ALL SELECT org_id, target, 0, 1 FROM ({EDGES}) e) x GROUP BY 1, 2
""")
def index_degrees(spark, root):
    """Callers and callees of every component, from the sources themselves."""
    return _lookups(spark, root)["degrees"]


@query("index_inbound_sites", f"""
SELECT org_id, lower(target) AS lower_target, component_id AS caller, row_number() OVER (PARTITION BY org_id, lower(target), component_id ORDER BY position, line) AS position,
  method_called, method AS caller_method, line, in_loop, kind, count(*) OVER (PARTITION BY org_id, lower(target), component_id) AS total FROM ({CALL_SITES}) s WHERE kind <> 'same_class'
""")
def index_inbound_sites(spark, root):
    return _lookups(spark, root)["inbound_sites"]


@query("index_field_touch", f"""
SELECT org_id, field, component_id AS component, 'Apex' AS mechanism, risk, source_map, persistence, min(line) AS write_id FROM ({FIELD_WRITES}) w GROUP BY ALL
""")
def index_field_touch(spark, root):
    return _lookups(spark, root)["field_touch"].drop("risk_rank")


FLOW_WRITERS = f"""
SELECT w.org_id, field, w.flow_id AS component, CASE WHEN k % 9 = 0 THEN 'Process Builder' ELSE 'Flow' END AS mechanism, 'declarative' AS risk, NULL::VARCHAR AS source_map, NULL::VARCHAR AS persistence, 0::BIGINT AS write_id
  FROM ({ORACLES["flow_field_writes"]}) w JOIN {flow_plans.O} o ON o.org_id = w.org_id AND o.flow_id = w.flow_id
UNION ALL SELECT 'org_0', field, component_id, 'Workflow/Approval field update', 'declarative', NULL, NULL, 0 FROM {flow_plans.UPDATES} u
"""


def _sources(spark, root):
    code = ("org_id", "component_id", "code")
    return {
        "classes": sv.class_sources(spark, root).select(*code), "triggers": sv.trigger_sources(spark, root).select(*code),
        "flows": fv.flow_documents(spark, root), "updates": fv.field_update_documents(spark, root).withColumn("org_id", F.lit("org_0")),
    }


@query("index_writers", f"""
SELECT org_id, field, component_id AS component, 'Apex' AS mechanism, risk, source_map, persistence, min(line) AS write_id FROM ({FIELD_WRITES}) w GROUP BY ALL
UNION ALL SELECT DISTINCT * FROM ({FLOW_WRITERS}) f
""")
def index_writers(spark, root):
    """Writers of every field from classes, flows and field updates."""
    return org_index.lookups(org_index.extract(**_sources(spark, root)))["field_touch"].drop("risk_rank")


@query("index_statistics", f"""
WITH c AS (SELECT org_id, count(CASE WHEN k % 10 = 0 THEN 1 END) AS callouts, CASE WHEN count(CASE WHEN k % 10 = 0 THEN 1 END) > 0 THEN 1 ELSE 0 END AS credentials,
    CASE WHEN count(CASE WHEN k % 12 = 0 THEN 1 END) > 0 THEN 1 ELSE 0 END AS exceptions, count(CASE WHEN k % 2 = 0 AND k % 8 <> 0 THEN 1 END) AS loose FROM {P} p GROUP BY 1),
f AS (SELECT org_id, count(CASE WHEN k % 9 = 0 THEN 1 END) AS processes, count(*) AS bare FROM {flow_plans.O} o GROUP BY 1)
SELECT org_id, unnest(['process_builder_processes', 'classes_with_callouts', 'named_credentials_referenced', 'custom_exceptions_defined', 'flows_without_fault_paths', 'never_cleared_static_collections']) AS statistic,
  unnest([coalesce(processes, 0), coalesce(callouts, 0), coalesce(credentials, 0), coalesce(exceptions, 0), coalesce(bare, 0), coalesce(loose, 0)])::BIGINT AS value FROM c FULL JOIN f USING (org_id)
""")
def index_statistics(spark, root):
    """Processes, callouts, credentials, exceptions, fault paths and static collections of every organisation."""
    return org_index.lookups(org_index.extract(**_sources(spark, root)))["statistics"]


@query("index_refreshed", f"""
SELECT org_id, id AS component_id, sum(o)::BIGINT AS calls, sum(i)::BIGINT AS called_by FROM (
  SELECT org_id, component_id AS id, 1 AS o, 0 AS i FROM ({EDGES}) e UNION ALL SELECT org_id, target, 0, 1 FROM ({EDGES}) e) x GROUP BY 1, 2
""")
def index_refreshed(spark, root):
    """Callers and callees after the index was built from an older state of the sources and refreshed: those of a rebuild."""
    now = _sources(spark, root)
    # the classes that others name and that have no source of their own
    named = sv.class_names(spark, root).join(now["classes"].select("org_id", F.col("component_id").alias("name")).hint("merge"), ["org_id", "name"], "left_anti")
    empty = named.select("org_id", F.col("name").alias("component_id"), F.concat(F.lit("public class "), "name", F.lit(" {}")).alias("code"))
    now["classes"] = now["classes"].unionByName(empty)
    number = F.regexp_extract("component_id", r"(\d+)$", 1).cast("bigint") % 10
    older = now["classes"].filter(number != 0).withColumn(
        "code", F.when(number == 1, F.concat("code", F.lit("class Zz { void zz() { Cls_1.check(1); Cls_2.check(2); } }"))).otherwise(F.col("code"))
    )
    gone = now["classes"].filter(number == 2).withColumn("component_id", F.concat(F.lit("Old_"), "component_id"))
    folder = scratch_path(spark, "index")
    org_index.refresh(spark, folder, **{**now, "classes": older.unionByName(gone)})
    org_index.refresh(spark, folder, **now)
    return org_index.lookups(org_index.load(spark, folder))["degrees"]
