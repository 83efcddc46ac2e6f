"""Debug log queries."""

from pyspark.sql import functions as F

from faultline import api
from faultline.operators import async_jobs as jobs
from faultline.operators import debug_logs as logs
from faultline.plans.registry import SQL, query
from faultline.sources.tables import table
from faultline.sources.views import view

# ---- the same rules as plain windows, for check SQL -------------------------
EV = """(SELECT *, string_split(raw, '|') AS parts, len(string_split(raw, '|')) AS n, string_split(raw, '|')[2] AS evt, string_split(raw, '|')[-1] AS lastp
  FROM <log_lines> ll WHERE trim(raw) <> '')"""
JOB = "(?i)queu|queable|job|batch|schedul|async|future|worker"
MASK = r"'''[^'']*''|:\w+|\b\d+\b'"


def levels(kind, extra=()):
    begin, end = logs.STACKS[kind]
    names = ", ".join(f"'{e}'" for e in (begin, end, *extra))
    return f"""(SELECT *, CASE WHEN step = 1 THEN ob WHEN step = -1 AND ob > 0 THEN ob - 1 END AS level FROM (
      SELECT *, (s - step) - least(0, min(s - step) OVER (PARTITION BY log_id ORDER BY line_no)) AS ob FROM (
        SELECT *, sum(step) OVER (PARTITION BY log_id ORDER BY line_no) AS s, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS others
        FROM (SELECT *, CASE WHEN evt = '{begin}' THEN 1 WHEN evt = '{end}' THEN -1 ELSE 0 END AS step FROM {EV} e WHERE evt IN ({names})) a) b) c)"""


def ends(kind, payload, extra=()):
    return f"""(SELECT * FROM (SELECT *, CASE WHEN level IS NOT NULL THEN last_value(CASE WHEN step = 1 THEN {payload} END IGNORE NULLS) OVER (
      PARTITION BY log_id, level ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS opened FROM {levels(kind, extra)} l WHERE step <> 0) p WHERE step = -1)"""


def trunc(text, n):
    sq = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({sq}) > {n} THEN concat(substr({sq}, 1, {n - 3}), '...') ELSE {sq} END"


UNITS = f"""(SELECT s.log_id, s.line_no, CASE WHEN n >= 3 THEN lastp ELSE '' END AS label, level::BIGINT AS depth, coalesce(at_end, at_last) > s.others AS had_exception
  FROM {levels('unit', ['EXCEPTION_THROWN'])} s
  LEFT JOIN (SELECT log_id, opened, others AS at_end FROM {ends('unit', 'line_no', ['EXCEPTION_THROWN'])} x WHERE opened IS NOT NULL) e ON e.log_id = s.log_id AND e.opened = s.line_no
  LEFT JOIN (SELECT log_id, max(others) AS at_last FROM {levels('unit', ['EXCEPTION_THROWN'])} x GROUP BY 1) t ON t.log_id = s.log_id WHERE s.step = 1)"""
QUERIES = f"""(SELECT log_id, line_no, trim(regexp_replace(q, {MASK}, '?', 'g')) AS signature, nullif(regexp_extract(q, '(?i)\\bFROM\\s+([A-Za-z0-9_]+)', 1), '') AS object,
  CASE WHEN n >= 3 THEN TRY_CAST(nullif(regexp_extract(lastp, 'Rows:(\\d+)', 1), '') AS BIGINT) END AS rows, {trunc('q', 150)} AS raw_example
  FROM (SELECT *, coalesce(opened, '') AS q FROM {ends('soql', "CASE WHEN n >= 4 THEN lastp ELSE '' END")} e) f)"""
SUMMARY = f"""(SELECT log_id, signature, count(*) AS occurrences, coalesce(sum(rows), 0)::BIGINT AS total_rows, arg_min(object, line_no) FILTER (object IS NOT NULL) AS object,
  arg_min(raw_example, line_no) AS raw_example, min(line_no) AS first_line FROM {QUERIES} q GROUP BY 1, 2)"""
FRAME = r"(regexp_matches(trim(raw), '^Class\.([\w.]+?)(?:\.(\w+))?:\s*line\s*(\d+)') OR regexp_matches(trim(raw), '^Trigger\.(\w+):\s*line\s*(\d+)'))"
THROWN = f"""(WITH ev AS (SELECT *, {FRAME} AS is_frame FROM {EV} e),
  hd AS (SELECT *, max(CASE WHEN NOT is_frame THEN line_no END) OVER (PARTITION BY log_id ORDER BY line_no) AS head FROM ev),
  st AS (SELECT log_id, head, string_agg(trim(raw), chr(10) ORDER BY line_no) AS stack FROM hd WHERE is_frame GROUP BY 1, 2),
  mk AS (SELECT log_id, line_no, evt, CASE WHEN n >= 3 THEN lastp WHEN evt = 'FATAL_ERROR' THEN raw ELSE '' END AS message,
    lag(evt) OVER w AS pe, lag(line_no) OVER w AS pl FROM ev WHERE evt IN ('EXCEPTION_THROWN', 'FATAL_ERROR') WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
  ow AS (SELECT f.log_id, CASE WHEN pe = 'EXCEPTION_THROWN' THEN pl ELSE line_no END AS owner, stack FROM mk f JOIN st ON st.log_id = f.log_id AND st.head = f.line_no
    WHERE evt = 'FATAL_ERROR' AND EXISTS (SELECT 1 FROM ev z WHERE z.log_id = f.log_id AND NOT z.is_frame AND z.line_no > f.line_no))
  SELECT m.log_id, m.line_no, trim(split_part(message, ':', 1)) AS type, message, coalesce(stack, '') AS stack FROM mk m LEFT JOIN ow ON ow.log_id = m.log_id AND ow.owner = m.line_no
  WHERE evt = 'EXCEPTION_THROWN' OR pe IS DISTINCT FROM 'EXCEPTION_THROWN')"""
EXCEPTIONS = f"(SELECT log_id, type, message, stack, min(line_no) AS first_line, count(*) AS occurrences FROM {THROWN} t GROUP BY 1, 2, 3, 4)"
TOKENS = f"""(SELECT DISTINCT log_id, unnest(regexp_extract_all(txt, '\\b[A-Za-z][A-Za-z0-9_]{{{{2,}}}}\\b')) AS component_id FROM (
  SELECT log_id, label AS txt FROM {UNITS} u UNION ALL SELECT log_id, concat_ws(' ', message, stack) FROM {THROWN} t) x)"""
COMPONENTS = f"(SELECT * FROM {TOKENS} k WHERE component_id IN (SELECT component_id FROM <log_components> c))"
# -----------------------------------------------------------------------------


def lines(spark, root):
    """The log lines; logs are scanned in two levels, so one may be of any size."""
    wide = True
    return view(spark, root, "log_lines", wide), wide


def rows(spark, root):
    found, wide = lines(spark, root)
    return logs.events(found), wide


@query("log_text_lines", r"""
SELECT doc_id, sum(CASE WHEN i = 1 THEN length(l) ELSE 0 END)::BIGINT AS header_chars, sum(CASE WHEN i > 1 THEN 1 ELSE 0 END)::BIGINT AS lines,
  sum(CASE WHEN i > 1 THEN length(l) ELSE 0 END)::BIGINT AS chars FROM (
  SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS l, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS i FROM {documents}) s
WHERE i = 1 OR trim(l) <> '' GROUP BY 1
""")
def log_text_lines(spark, root):
    split = logs.split_text(table(spark, root, "documents"), "doc_id", "text")
    return split.groupBy("doc_id").agg(
        F.sum(F.when(F.col("is_header"), F.length("raw")).otherwise(0)).alias("header_chars"),
        F.count_if(~F.col("is_header")).alias("lines"),
        F.sum(F.when(~F.col("is_header"), F.length("raw")).otherwise(0)).alias("chars"),
    )


@query("execution_units", f"SELECT * FROM {UNITS} u")
def execution_units(spark, root):
    return logs.execution_units(*rows(spark, root))


@query("unit_runs", f"""
SELECT log_id, run, min(line_no) AS line_no, label, depth, had_exception, count(*) AS repeat FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY log_id ORDER BY line_no)::BIGINT AS run FROM (
    SELECT *, CASE WHEN label = lag(label) OVER w AND depth = lag(depth) OVER w AND had_exception = lag(had_exception) OVER w THEN 0 ELSE 1 END AS fresh
    FROM {UNITS} u WINDOW w AS (PARTITION BY log_id ORDER BY line_no)) a) b GROUP BY log_id, run, label, depth, had_exception
""")
def unit_runs(spark, root):
    found, wide = rows(spark, root)
    return logs.unit_runs(logs.execution_units(found, wide), wide)


def _queries(spark, root):
    return logs.query_events(*rows(spark, root))


@query("query_events", f"SELECT * FROM {QUERIES} q")
def query_events(spark, root):
    return _queries(spark, root).drop("query")


@query("query_summary", f"SELECT log_id, signature, occurrences, total_rows, object, raw_example, first_line FROM {SUMMARY} s")
def query_summary(spark, root):
    return logs.query_summary(_queries(spark, root))


@query("dml_summary", f"""
SELECT log_id, operation, object, count(*) AS occurrences, coalesce(sum(rows), 0)::BIGINT AS total_rows, min(line_no) AS first_line FROM (
  SELECT log_id, line_no, CASE WHEN o <> '' THEN o ELSE 'Unknown' END AS operation, CASE WHEN o <> '' THEN regexp_extract(d, 'Op:(\\w+)\\|Type:(\\w+)\\|Rows:(\\d+)', 2) END AS object,
    CASE WHEN o <> '' THEN regexp_extract(d, 'Op:(\\w+)\\|Type:(\\w+)\\|Rows:(\\d+)', 3)::BIGINT END AS rows FROM (
    SELECT *, coalesce(opened, '') AS d, regexp_extract(coalesce(opened, ''), 'Op:(\\w+)\\|Type:(\\w+)\\|Rows:(\\d+)', 1) AS o
    FROM {ends('dml', "CASE WHEN n >= 3 THEN array_to_string(parts[3:], '|') ELSE '' END")} e) f) g GROUP BY 1, 2, 3
""")
def dml_summary(spark, root):
    return logs.dml_summary(logs.dml_events(*rows(spark, root)))


def _thrown(spark, root):
    return logs.thrown(*rows(spark, root))


@query("log_exceptions", f"SELECT * FROM {EXCEPTIONS} e")
def log_exceptions(spark, root):
    return logs.exceptions(_thrown(spark, root))


@query("log_limits", r"""
WITH r AS (SELECT *, regexp_matches(raw, '\|LIMIT_USAGE_FOR_NS\|([^|]*)') AS hdr, coalesce(nullif(trim(regexp_extract(raw, '\|LIMIT_USAGE_FOR_NS\|([^|]*)', 1)), ''), '(default)') AS ns0,
    regexp_matches(raw, '^\s*(?:Number of|Maximum)\s+(.+?):\s*(\d+)\s*out of\s*(\d+)(.*)$') AS lim FROM <log_lines> l),
s AS (SELECT *, sum(CASE WHEN hdr THEN 1 ELSE 0 END) OVER w AS block, coalesce(last_value(CASE WHEN hdr THEN ns0 END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '(default)') AS namespace FROM r WHERE hdr OR lim WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
i AS (SELECT log_id, namespace, block, line_no, trim(regexp_extract(raw, '^\s*(?:Number of|Maximum)\s+(.+?):\s*(\d+)\s*out of\s*(\d+)(.*)$', 1)) AS name,
    regexp_extract(raw, '^\s*(?:Number of|Maximum)\s+(.+?):\s*(\d+)\s*out of\s*(\d+)(.*)$', 2)::BIGINT AS used,
    regexp_extract(raw, '^\s*(?:Number of|Maximum)\s+(.+?):\s*(\d+)\s*out of\s*(\d+)(.*)$', 3)::BIGINT AS mx, contains(raw, 'CLOSE TO LIMIT') AS close_to_limit FROM s WHERE NOT hdr),
b AS (SELECT log_id, namespace, max(block) AS lb, min(line_no) AS fl FROM s GROUP BY 1, 2),
f AS (SELECT i.log_id, i.namespace, name, arg_max(used, line_no) AS used, arg_max(mx, line_no) AS max, arg_max(close_to_limit, line_no) AS close_to_limit
    FROM i JOIN b ON b.log_id = i.log_id AND b.namespace = i.namespace AND i.block = b.lb GROUP BY 1, 2, 3),
p AS (SELECT log_id, namespace, name, max(used) AS peak FROM i GROUP BY 1, 2, 3),
d AS (SELECT log_id, CASE WHEN log_id IN (SELECT log_id FROM f WHERE namespace = '(default)') THEN '(default)' ELSE arg_min(namespace, fl) END AS fin FROM b GROUP BY 1)
SELECT f.*, CASE WHEN peak > used THEN peak END AS peak_used, f.namespace = fin AS is_final
FROM f JOIN p ON p.log_id = f.log_id AND p.namespace = f.namespace AND p.name = f.name JOIN d ON d.log_id = f.log_id
""")
def log_limits(spark, root):
    return logs.limits(*lines(spark, root))


ROUTED = f"""
SELECT log_id, line_no, section, evt, CASE section WHEN 'user_debug' THEN CASE WHEN n >= 4 THEN {trunc('lastp', 300)} ELSE raw END
  WHEN 'validation_failures' THEN {trunc('raw', 200)} ELSE CASE WHEN n >= 3 THEN {trunc('lastp', 200)} ELSE '' END END AS detail FROM (
  SELECT *, CASE WHEN evt IN ('CALLOUT_REQUEST', 'CALLOUT_RESPONSE', 'NAMED_CREDENTIAL_REQUEST', 'NAMED_CREDENTIAL_RESPONSE') THEN 'callouts' WHEN evt = 'USER_DEBUG' THEN 'user_debug'
    WHEN evt IN ('VALIDATION_RULE', 'VALIDATION_FAIL') THEN 'validation_failures' WHEN evt IN ('FLOW_START_INTERVIEW_BEGIN', 'FLOW_START_INTERVIEW_END', 'FLOW_ELEMENT_ERROR',
    'FLOW_FAULT_EVENT', 'FLOW_INTERVIEW_FINISHED') THEN 'flow_events' END AS section FROM {EV} e) s WHERE section IS NOT NULL
"""


@query("log_routing", ROUTED)
def log_routing(spark, root):
    return logs.routed(rows(spark, root)[0])


ENTRY = f"""(SELECT log_id, entry_unit, regexp_matches(entry_unit, '{JOB}') AND NOT contains(entry_unit, '__sfdc_trigger') AS likely_async
  FROM (SELECT log_id, arg_min(label, line_no) AS entry_unit FROM {UNITS} u WHERE depth = 0 GROUP BY 1) x)"""


@query("entry_units", f"SELECT * FROM {ENTRY} e")
def entry_units(spark, root):
    return logs.entry_units(execution_units(spark, root))


@query("involved_components", f"SELECT * FROM {COMPONENTS} c")
def involved_components(spark, root):
    r, wide = rows(spark, root)
    return logs.involved_components(logs.execution_units(r, wide), logs.thrown(r, wide), view(spark, root, "log_components"))


@query("missing_field_evidence", f"""
SELECT s.log_id, signature, object, field, CASE WHEN list_contains(list_transform(string_split(regexp_extract(signature, '(?is)^SELECT\\s(.*?)\\sFROM\\s', 1), ','),
  lambda f: lower(trim(f))), lower(field)) THEN 'INCLUDES' ELSE 'DOES NOT include' END AS verdict
FROM {SUMMARY} s JOIN (SELECT DISTINCT log_id, lower(regexp_extract(message, '(?i)without querying the requested field:\\s*([\\w.]+?)\\.(\\w+)', 1)) AS o,
  regexp_extract(message, '(?i)without querying the requested field:\\s*([\\w.]+?)\\.(\\w+)', 2) AS field FROM {THROWN} t WHERE contains(message, 'without querying')) w
ON w.log_id = s.log_id AND w.o = lower(s.object)
""")
def missing_field_evidence(spark, root):
    r, wide = rows(spark, root)
    return logs.missing_field_evidence(logs.thrown(r, wide), logs.query_summary(logs.query_events(r, wide)))


@query("log_meta", f"""
SELECT l.log_id, lines, size_kb, coalesce(ec, 0) AS exception_count, te AS top_exception, coalesce(uc, 0) AS execution_unit_count, coalesce(cc, 0) AS component_count
FROM (SELECT log_id, count(*) AS lines, round_even(sum(length(raw) + 1) / 1024.0::DOUBLE, 1) AS size_kb FROM <log_lines> l GROUP BY 1) l
LEFT JOIN (SELECT log_id, count(*) AS ec, arg_min(type, first_line) AS te FROM {EXCEPTIONS} e GROUP BY 1) e USING (log_id)
LEFT JOIN (SELECT log_id, count(*) AS uc FROM {UNITS} u GROUP BY 1) u USING (log_id) LEFT JOIN (SELECT log_id, count(*) AS cc FROM {COMPONENTS} c GROUP BY 1) c USING (log_id)
""")
def log_meta(spark, root):
    wide = lines(spark, root)[1]
    found = logs.sweep(*lines(spark, root))
    units, raised = logs.execution_units(found, wide), logs.thrown(found, wide)
    return logs.log_meta(found, units, raised, logs.involved_components(units, raised, view(spark, root, "log_components")))


LEVELS = "['NONE', 'ERROR', 'WARN', 'INFO', 'DEBUG', 'FINE', 'FINER', 'FINEST']"


def below(cat):
    return f"coalesce(list_position({LEVELS}, upper(nullif(regexp_extract(flags, '(?:^|;)\\s*{cat},([A-Za-z]*)', 1), ''))), 1) < 6"


@query("log_visibility", f"""
SELECT h.log_id, nullif(regexp_extract(header, '^(\\d+(?:\\.\\d+)?)\\s', 1), '') AS api_version,
  len(list_filter(string_split(flags, ';'), lambda p: contains(p, ','))) AS n_levels, {below('APEX_CODE')} AS code_below_fine, {below('SYSTEM')} AS system_below_fine,
  coalesce(m, 0) AS managed_entries FROM (SELECT *, regexp_replace(header, '^\\d+(\\.\\d+)?\\s+', '') AS flags FROM <log_headers> h0) h
LEFT JOIN (SELECT log_id, count(*) AS m FROM {EV} e WHERE evt = 'ENTERING_MANAGED_PKG' GROUP BY 1) m ON m.log_id = h.log_id
""")
def log_visibility(spark, root):
    return logs.visibility(view(spark, root, "log_headers"), rows(spark, root)[0])


@query("log_section_page", f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) - 1 AS position, CASE WHEN n >= 4 THEN {trunc('lastp', 300)} ELSE raw END AS detail FROM {EV} e WHERE evt = 'USER_DEBUG')
SELECT t.log_id, position, detail, total, CASE WHEN total > 3 THEN 3 END AS next_offset FROM (SELECT log_id, count(*) AS total FROM d GROUP BY 1) t
LEFT JOIN (SELECT log_id, position, detail FROM d WHERE position BETWEEN 1 AND 2) p ON p.log_id = t.log_id
""")
def log_section_page(spark, root):
    section = logs.routed(rows(spark, root)[0]).filter("section = 'user_debug'")
    return logs.section_page(section, "line_no", 1, 2).select("log_id", "position", "detail", "total", "next_offset")


# ---- async evidence ---------------------------------------------------------
INNER = f"""(SELECT *, last_value(CASE WHEN step = 1 THEN line_no END IGNORE NULLS) OVER (PARTITION BY log_id, inr ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ul,
    last_value(CASE WHEN step = 1 THEN (CASE WHEN n >= 3 THEN lastp ELSE '' END) END IGNORE NULLS) OVER (PARTITION BY log_id, inr ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label
  FROM (SELECT *, CASE WHEN step = 1 THEN ob ELSE ob - 1 END AS inr FROM {levels('unit', ['METHOD_ENTRY', 'METHOD_EXIT', 'CONSTRUCTOR_ENTRY', 'SYSTEM_METHOD_ENTRY', 'EXCEPTION_THROWN'])} l WHERE step >= 0) i)"""
# the method stack, one event of every unit per round
EVIDENCE = f"""
WITH RECURSIVE fr AS (SELECT log_id, line_no, evt, parts, n, lastp, CASE WHEN inr >= 0 THEN ul END AS ul, CASE WHEN inr >= 0 THEN label END AS label,
    trim(split_part(lastp, '(', 1)) AS callee, row_number() OVER (PARTITION BY log_id, CASE WHEN inr >= 0 THEN ul END ORDER BY line_no) AS rn FROM {INNER} x WHERE step = 0),
st AS (SELECT log_id, ul, 0::BIGINT AS rn, NULL::BIGINT AS line_no, []::VARCHAR[] AS stk FROM fr WHERE ul IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT s.log_id, s.ul, f.rn, f.line_no, CASE f.evt WHEN 'METHOD_ENTRY' THEN list_append(s.stk, f.callee)
    WHEN 'METHOD_EXIT' THEN CASE WHEN list_contains(s.stk, f.callee) THEN s.stk[1 : len(s.stk) - list_position(list_reverse(s.stk), f.callee)] ELSE s.stk END ELSE s.stk END
  FROM st s JOIN fr f ON f.log_id = s.log_id AND f.ul = s.ul AND f.rn = s.rn + 1),
ev AS (SELECT f.log_id, f.line_no, f.ul, f.label AS code_unit, coalesce(s.stk[-1], f.label) AS caller, f.evt, f.lastp, f.n,
    CASE WHEN evt = 'CONSTRUCTOR_ENTRY' AND trim(lastp) <> '' AND NOT starts_with(trim(lastp), '<') THEN 'construction'
         WHEN evt = 'SYSTEM_METHOD_ENTRY' AND regexp_matches(lastp, '^(System.enqueueJob|Database.executeBatch|System.scheduleBatch|System.schedule)\\(') THEN 'dispatch'
         WHEN evt = 'EXCEPTION_THROWN' AND regexp_matches(lastp, '(?i)Too many (queueable jobs added to the queue|future calls|batch jobs|async)') THEN 'failure' END AS what,
    TRY_CAST(nullif(regexp_extract(CASE WHEN n >= CASE WHEN evt = 'EXCEPTION_THROWN' THEN 4 ELSE 3 END THEN trim(parts[3]) ELSE '' END, '^\\[(\\d+)\\]$', 1), '') AS BIGINT) AS line
  FROM fr f LEFT JOIN st s ON s.log_id = f.log_id AND s.ul = f.ul AND s.line_no = f.line_no),
k AS (SELECT *, lag(CASE WHEN what = 'construction' THEN {{'c': trim(lastp), 'l': line, 'w': caller}} END IGNORE NULLS) OVER (PARTITION BY log_id, ul ORDER BY line_no) AS made FROM ev WHERE what IS NOT NULL),
g AS (SELECT *, what <> 'construction' AND ul IS NOT NULL AND made IS NOT NULL AND made.w IS NOT DISTINCT FROM caller
    AND (line IS NULL OR made.l IS NULL OR (line - made.l BETWEEN 0 AND 25)) AS usable FROM k)
"""


def _evidence(spark, root):
    return jobs.evidence(*rows(spark, root))


@query("async_dispatches", EVIDENCE + """
SELECT d.log_id, d.line_no, split_part(lastp, '(', 1) AS mechanism, line, caller, code_unit, CASE WHEN usable THEN made.c END AS job_class_guess,
  CASE WHEN usable THEN made.l END AS job_class_line, EXISTS (SELECT 1 FROM g f WHERE f.what = 'failure' AND f.log_id = d.log_id AND f.line IS NOT DISTINCT FROM d.line
    AND f.caller IS NOT DISTINCT FROM d.caller AND f.line_no > d.line_no AND NOT EXISTS (SELECT 1 FROM g z WHERE z.what = 'dispatch' AND z.log_id = d.log_id
      AND z.line IS NOT DISTINCT FROM d.line AND z.caller IS NOT DISTINCT FROM d.caller AND z.line_no > d.line_no AND z.line_no < f.line_no)) AS failed
FROM g d WHERE what = 'dispatch'
""")
def async_dispatches(spark, root):
    return jobs.shown_dispatches(_evidence(spark, root), rows(spark, root)[1])


@query("async_failures", EVIDENCE + """
SELECT log_id, line_no, lastp AS message, line, caller, code_unit, TRY_CAST(nullif(regexp_extract(lastp, 'queue\\S*:?\\s*(\\d+)', 1), '') AS BIGINT) AS attempted,
  CASE WHEN usable THEN made.c END AS job_class_guess, CASE WHEN usable THEN made.l END AS job_class_line FROM g WHERE what = 'failure'
""".replace("\\\\", "\\"))
def async_failures(spark, root):
    return jobs.failures(_evidence(spark, root))


@query("job_constructions", EVIDENCE + f"""
SELECT log_id, trim(lastp) AS class, line, caller, count(*) AS count, min(line_no) AS first_line FROM g
WHERE what = 'construction' AND regexp_matches(trim(lastp), '{JOB}') GROUP BY 1, 2, 3, 4
""")
def job_constructions(spark, root):
    return jobs.job_constructions(_evidence(spark, root))


@query("async_presence", EVIDENCE + f"""
SELECT * FROM (SELECT coalesce(e.log_id, c.log_id) AS log_id, entry_unit, coalesce(likely_async, FALSE) AS likely_async, coalesce(dispatches, 0) AS dispatches,
  coalesce(failures, 0) AS failures, coalesce(constructions, 0) AS constructions FROM {ENTRY} e FULL JOIN (
  SELECT log_id, sum(CASE WHEN what = 'dispatch' THEN 1 ELSE 0 END)::BIGINT AS dispatches, sum(CASE WHEN what = 'failure' THEN 1 ELSE 0 END)::BIGINT AS failures,
    sum(CASE WHEN what = 'construction' AND regexp_matches(trim(lastp), '{JOB}') THEN 1 ELSE 0 END)::BIGINT AS constructions FROM g GROUP BY 1) c ON c.log_id = e.log_id) x
WHERE likely_async OR dispatches > 0 OR failures > 0 OR constructions > 0
""")
def async_presence(spark, root):
    r, wide = rows(spark, root)
    return jobs.presence(jobs.evidence(r, wide), logs.entry_units(logs.execution_units(r, wide)))


# every section of every log, of which the check SQL is that of the section's own query
SECTIONS = {
    "meta": "log_meta", "context": "entry_units", "execution_units": "execution_units", "exceptions": "log_exceptions", "soql_summary": "query_summary",
    "dml_summary": "dml_summary", "limits_by_namespace": "log_limits", "involved_components": "involved_components", "missing_fields": "missing_field_evidence",
    "async_presence": "async_presence", "dispatches": "async_dispatches", "failed_async_limit": "async_failures", "job_constructions": "job_constructions",
    "visibility": "log_visibility",
}


def _counted(section, rows):
    return f"SELECT log_id, '{section}' AS section, count(*) AS n FROM ({rows}) s_{section} GROUP BY 1"


@query("normalized_log_sections", " UNION ALL ".join([
    *[_counted(section, SQL[name]) for section, name in SECTIONS.items()], *[_counted(x, f"SELECT * FROM ({ROUTED}) r WHERE section = '{x}'") for x in logs.ROUTED],
    _counted("limits_final", f"SELECT * FROM ({SQL['log_limits']}) l WHERE is_final"),
]))
def normalized_log_sections(spark, root):
    found, wide = lines(spark, root)
    headers = view(spark, root, "log_headers")
    return logs.section_sizes(**api.normalize_logs(found, view(spark, root, "log_components"), headers, wide))


WANTED = ["dispatches", "exceptions", "nope"]
ALL_SECTIONS = sorted(logs.SECTIONS)


@query("log_missing_sections", f"""
SELECT h.log_id, CASE WHEN p.log_id IS NULL THEN 'dispatches,nope' ELSE 'nope' END AS missing,
  CASE WHEN p.log_id IS NULL THEN '{",".join(x for x in ALL_SECTIONS if x not in logs.JOB_SECTIONS)}' ELSE '{",".join(ALL_SECTIONS)}' END AS available
FROM <log_headers> h LEFT JOIN ({SQL["async_presence"]}) p ON p.log_id = h.log_id
""")
def log_missing_sections(spark, root):
    return logs.missing_sections(view(spark, root, "log_headers"), async_presence(spark, root), WANTED)
