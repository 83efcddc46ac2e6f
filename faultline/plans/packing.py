"""Packing queries."""

from pyspark.sql import functions as F

from faultline.functions.columns import without_empty_lines
from faultline.operators import debug_logs as logs
from faultline.operators import packing as pk
from faultline.plans.debug_logs import COMPONENTS, EXCEPTIONS, ROUTED, SUMMARY
from faultline.plans.debug_logs import lines as log_lines
from faultline.plans.registry import SQL, query
from faultline.session import cut_lineage
from faultline.sources import component_views  # noqa: F401
from faultline.sources.tables import table
from faultline.sources.views import view

BUDGET = 2000

ITEMS = """(SELECT org_id, component_id, section, row_number() OVER (PARTITION BY org_id, component_id, section ORDER BY o1, o2) - 1 AS item_no, size FROM (
  SELECT org_id, component_id, 'entry_points' AS section, 0 AS o1, length(kind) AS o2, length(concat('{"kind":"', kind, '","detail":"', detail, '"}')) AS size FROM <entry_point_rows> e
  UNION ALL SELECT org_id, caller, 'call_sites', site_no, line, length(concat('{"line":', line, ',"method_called":"', method_called, '"}')) FROM <call_sites> s
  UNION ALL SELECT org_id, component, 'field_writes', write_id, seq, length(concat('{"field":"', field, '","risk":"', risk, '"}')) FROM <field_writes> w) x)"""


def card_items(spark, root):
    entries = view(spark, root, "entry_point_rows").select(
        "org_id", "component_id", F.lit("entry_points").alias("section"), F.lit(0).cast("bigint").alias("o1"), F.length("kind").cast("bigint").alias("o2"),
        F.length(F.to_json(F.struct("kind", "detail"))).alias("size"),
    )
    sites = view(spark, root, "call_sites").select(
        "org_id", F.col("caller").alias("component_id"), F.lit("call_sites").alias("section"), F.col("site_no").alias("o1"), F.col("line").cast("bigint").alias("o2"),
        F.length(F.to_json(F.struct("line", "method_called"))).alias("size"),
    )
    writes = view(spark, root, "field_writes").select(
        "org_id", F.col("component").alias("component_id"), F.lit("field_writes").alias("section"), F.col("write_id").alias("o1"), F.col("seq").cast("bigint").alias("o2"),
        F.length(F.to_json(F.struct("field", "risk"))).alias("size"),
    )
    return entries.unionByName(sites).unionByName(writes)


def _step(prev, section):
    """One section of the greedy fit: what is shown and the budget left."""
    return f"""SELECT b.*, coalesce(t.total, 0) AS total_{section}, CASE WHEN t.total IS NULL THEN 0 WHEN whole + {len(section)} + 6 <= budget THEN t.total
      ELSE (SELECT count(*) FROM it i WHERE i.org_id = b.org_id AND i.component_id = b.component_id AND i.section = '{section}' AND upto + 2 <= budget) END AS shown_{section},
    CASE WHEN t.total IS NULL THEN budget WHEN whole + {len(section)} + 6 <= budget THEN budget - whole - {len(section)} - 6 ELSE greatest(0, budget - 2 - {len(section)} - 6 - coalesce((
      SELECT max(upto) FROM it i WHERE i.org_id = b.org_id AND i.component_id = b.component_id AND i.section = '{section}' AND upto + 2 <= budget), 0)) END AS budget_next
    FROM {prev} b LEFT JOIN (SELECT * FROM tot WHERE section = '{section}') t ON t.org_id = b.org_id AND t.component_id = b.component_id"""


@query("card_packing", f"""
WITH it AS (SELECT *, sum(size + 2) OVER (PARTITION BY org_id, component_id, section ORDER BY item_no) AS upto FROM {ITEMS} x),
tot AS (SELECT org_id, component_id, section, count(*) AS total, sum(size) + 2 * count(*) + 2 AS whole FROM it GROUP BY 1, 2, 3),
b0 AS (SELECT org_id, component_id, sum(whole + length(section) + 6) <= {BUDGET} AS fits, {BUDGET} - 900 AS budget FROM tot GROUP BY 1, 2),
s1 AS ({_step('b0', 'entry_points')}), b1 AS (SELECT * EXCLUDE (budget, budget_next), budget_next AS budget FROM s1),
s2 AS ({_step('b1', 'call_sites')}), b2 AS (SELECT * EXCLUDE (budget, budget_next), budget_next AS budget FROM s2),
s3 AS ({_step('b2', 'field_writes')})
{' UNION ALL '.join(f"SELECT org_id, component_id, '{s}' AS section, total_{s}::BIGINT AS total, CASE WHEN fits THEN total_{s} ELSE shown_{s} END::BIGINT AS shown FROM s3 WHERE total_{s} > 0" for s in ('entry_points', 'call_sites', 'field_writes'))}
""")
def card_packing(spark, root):
    # read once: the order is that of the items themselves, and what goes on from a card is a row for each bucket
    return pk.pack_cards(card_items(spark, root), ["org_id", "component_id"], BUDGET, True, ("o1", "o2"), F.floor(F.col("o1") / F.lit(100_000)))


RUNS = SQL["unit_runs"]
LOG_ITEMS = f"""(SELECT log_id, 'execution_units' AS section, line_no AS pos, length(concat('{{"label":"', label, '","depth":', depth, ',"had_exception":', had_exception,
    CASE WHEN repeat > 1 THEN concat(',"repeat":', repeat) ELSE '' END, '}}')) AS size, 0 AS wr, 0 AS wc, had_exception OR depth = 0 AS urgent FROM ({RUNS}) u
  UNION ALL SELECT log_id, 'soql_summary', first_line, length(concat('{{"signature":"', signature, '"', CASE WHEN object IS NOT NULL THEN concat(',"object":"', object, '"') ELSE '' END,
    ',"occurrences":', occurrences, ',"total_rows":', total_rows, '}}')), total_rows, occurrences, FALSE FROM {SUMMARY} q
  UNION ALL SELECT log_id, 'dml_summary', first_line, length(concat('{{"operation":"', operation, '"', CASE WHEN object IS NOT NULL THEN concat(',"object":"', object, '"') ELSE '' END,
    ',"occurrences":', occurrences, ',"total_rows":', total_rows, '}}')), total_rows, occurrences, FALSE FROM ({SQL['dml_summary']}) q
  UNION ALL SELECT log_id, 'exceptions', first_line, length(concat('{{"type":', to_json(type), ',"message":', to_json(message), ',"stack":', to_json(stack), ',"occurrences":', occurrences, '}}')),
    0, 0, FALSE FROM {EXCEPTIONS} e
  UNION ALL SELECT log_id, 'involved_components', row_number() OVER (PARTITION BY log_id ORDER BY component_id), length(component_id) + 2, 0, 0, FALSE FROM {COMPONENTS} c
  UNION ALL SELECT log_id, section, line_no, length(detail) + 2, 0, 0, FALSE FROM ({ROUTED}) r)"""
FITS = "used + size + 2 <= room"


# both sequential steps, the shares of the sections and the fit of the items, as recursion
@query("log_packing", f"""
WITH RECURSIVE it AS (SELECT * FROM {LOG_ITEMS} i),
sr AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY need, section) AS rn, count(*) OVER (PARTITION BY log_id) AS n FROM (
  SELECT log_id, section, (sum(size + 1) + 1 + length(section) + 6)::BIGINT AS need, count(*) AS total FROM it GROUP BY 1, 2) x),
cp AS (SELECT log_id, section, need, total, rn, least(need, 800 // n) AS cap, 800 - least(need, 800 // n) AS lft FROM sr WHERE rn = 1
  UNION ALL SELECT s.log_id, s.section, s.need, s.total, s.rn, least(s.need, c.lft // (s.n - s.rn + 1)), c.lft - least(s.need, c.lft // (s.n - s.rn + 1)) FROM cp c JOIN sr s ON s.log_id = c.log_id AND s.rn = c.rn + 1),
od AS (SELECT it.log_id, it.section, size, cap - length(it.section) - 6 AS room, it.section NOT IN ('execution_units', 'soql_summary', 'dml_summary') AS gapless, row_number() OVER (PARTITION BY it.log_id, it.section ORDER BY
    CASE it.section WHEN 'soql_summary' THEN -wr WHEN 'dml_summary' THEN -wr WHEN 'execution_units' THEN CASE WHEN urgent THEN 0 ELSE 1 END ELSE 0 END,
    CASE it.section WHEN 'soql_summary' THEN -wc WHEN 'dml_summary' THEN -wc WHEN 'user_debug' THEN -pos ELSE pos END, pos) AS rn
  FROM it JOIN cp ON cp.log_id = it.log_id AND cp.section = it.section WHERE need > cap),
gr AS (SELECT DISTINCT log_id, section, 0::BIGINT AS rn, 2::BIGINT AS used, 0 AS kept, TRUE AS open FROM od
  UNION ALL SELECT o.log_id, o.section, o.rn, CASE WHEN g.open AND g.{FITS} THEN g.used + o.size + 2 ELSE g.used END, CASE WHEN g.open AND g.{FITS} THEN 1 ELSE 0 END, g.open AND (NOT o.gapless OR g.{FITS})
  FROM gr g JOIN od o ON o.log_id = g.log_id AND o.section = g.section AND o.rn = g.rn + 1)
SELECT c.log_id, c.section, c.total, CASE WHEN need <= cap THEN c.total ELSE (SELECT sum(kept) FROM gr g WHERE g.log_id = c.log_id AND g.section = c.section) END::BIGINT AS shown FROM cp c
""".replace("g.used + size + 2 <= room", "g.used + o.size + 2 <= o.room"))
def log_packing(spark, root):
    found, wide = log_lines(spark, root)
    items = cut_lineage(pk.log_items(logs.sweep(found, wide), view(spark, root, "log_components"), wide))
    return pk.pack_report(items, pk.pack_logs(items, 2200))


@query("search_merge", """
SELECT o_custkey AS key, min(o_orderkey) AS hit_no, arg_min(o_orderpriority, o_orderkey) AS query, concat('Doc ', o_custkey) AS title, arg_min(o_totalprice, o_orderkey) AS score, count(*) - 1 AS duplicates,
  coalesce((SELECT string_agg(DISTINCT p.o_orderpriority, ',' ORDER BY p.o_orderpriority) FROM {orders} p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority <> arg_min(o.o_orderpriority, o.o_orderkey)), '') AS also_matched
FROM {orders} o GROUP BY o_custkey
""")
def search_merge(spark, root):
    hits = table(spark, root, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("hit_no"), F.col("o_orderpriority").alias("query"),
        F.concat(F.lit("Doc "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_totalprice").alias("score"),
    )
    return pk.merged_hits(hits)


def _cut(cap):
    return f"CASE WHEN length(text) > {cap} THEN concat(regexp_replace(substr(text, 1, {cap}), '\\s+$', ''), ' [...]') ELSE text END"


_CAPS = (2147483647, *pk.CONTENT_STEPS)


@query("search_packing", f"""
WITH s AS (SELECT source AS search_id, {', '.join(f'sum(length({_cut(cap)}) + 60) AS s{i}' for i, cap in enumerate(_CAPS))} FROM {{documents}} GROUP BY 1),
p AS (SELECT search_id, CASE {' '.join(f'WHEN s{i} <= 20000 THEN {cap}' for i, cap in enumerate(_CAPS))} ELSE 300 END AS cap, s{len(_CAPS) - 1} > 20000 AS too_much FROM s),
r AS (SELECT p.*, doc_id AS hit_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97 DESC, doc_id) AS place, {_cut('cap')} AS body FROM {{documents}} JOIN p ON search_id = source),
u AS (SELECT *, sum(length(body) + 60) OVER (PARTITION BY search_id ORDER BY place) AS upto FROM r)
SELECT search_id, hit_id, place, cap, length(body) AS chars, ends_with(body, ' [...]') AS is_cut FROM u WHERE NOT too_much OR upto <= 20000 OR place = 1
""")
def search_packing(spark, root):
    hits = table(spark, root, "documents").select(
        F.col("source").alias("search_id"), F.col("doc_id").alias("hit_id"), (F.col("n_chars") % 97).alias("score"), F.col("text").alias("content")
    )
    return pk.pack_search(hits, 20_000, 60)


@query("query_compaction", """
SELECT p_partkey, CASE WHEN length(fl) > 200 THEN concat('SELECT <', p_size + 2, ' fields, incl. 1 subquery; ', CASE WHEN p_size >= 7 THEN 'INCLUDES Field_7__c' ELSE '' END, CASE WHEN p_size >= 7 AND p_size < 30 THEN '; ' ELSE '' END,
  CASE WHEN p_size < 30 THEN 'DOES NOT include Field_30__c' WHEN p_size >= 30 THEN ', Field_30__c' END, '> FROM Obj__c WHERE X IN (1, (2))') ELSE concat('SELECT ', fl, ' FROM Obj__c WHERE X IN (1, (2))') END AS signature
FROM (SELECT *, concat(array_to_string(list_transform(range(1, p_size + 1), lambda i: concat('Field_', i, '__c')), ', '), ', (SELECT Id, Name FROM Kids WHERE A IN (1, 2)), COUNT(Id)') AS fl FROM {part}) x
""")
def query_compaction(spark, root):
    fields = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("Field_"), i.cast("string"), F.lit("__c"))), ", ")
    sql = F.concat(F.lit("SELECT "), fields, F.lit(", (SELECT Id, Name FROM Kids WHERE A IN (1, 2)), COUNT(Id) FROM Obj__c WHERE X IN (1, (2))"))
    rows = table(spark, root, "part").select("p_partkey", sql.alias("sql"))
    short = pk.compact_queries(rows, "sql", F.array(F.lit("Field_7__c"), F.lit("Field_30__c")))
    return short.select("p_partkey", F.col("compacted").alias("signature"))


@query("text_cleaning", r"""
SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^[^\n]{{0,80}}:-[ \t]*(No Information Available|N/?A|None)?[ \t]*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS chars
FROM {documents}
""")
def text_cleaning(spark, root):
    return table(spark, root, "documents").select("doc_id", F.length(without_empty_lines(F.col("text"))).cast("bigint").alias("chars"))
