"""Incident queries."""

from pyspark.sql import functions as F

from faultline.functions.columns import iso, slug
from faultline.operators import access
from faultline.operators import incidents as inc
from faultline.operators import token_usage as usage
from faultline.plans.access import ME, VISIBLE
from faultline.plans.registry import query
from faultline.session import spread
from faultline.sources.tables import table
from faultline.sources.views import AS_OF, view

ISO = "'%Y-%m-%dT%H:%M:%SZ'"
SIGNED = r"""(SELECT *, CASE WHEN exc_type IS NOT NULL THEN substr(sha256(concat(exc_type, '|', trim(regexp_replace(message, '''[^'']*''|:\w+|\b\d+\b', '?', 'g')), '|', regexp_extract(frame_line, '(?i)^Class\.([\w.]+?)(?:\.\w+)?:', 1))), 1, 16)
    WHEN suspect_field IS NOT NULL THEN substr(sha256(concat('field_report|', suspect_field)), 1, 16) END AS signature,
  CASE WHEN exc_type IS NOT NULL THEN 'exception' WHEN suspect_field IS NOT NULL THEN 'field_report' END AS kind FROM <incidents> i0)"""
KNOWN = f"""(SELECT org_id, signature, arg_min(kind, k) AS kind, arg_min(exc_type, k) FILTER (exc_type IS NOT NULL) AS type, arg_min(CASE WHEN kind = 'exception' THEN message END, k) FILTER (kind = 'exception') AS message_sample,
  arg_min(CASE WHEN kind = 'field_report' THEN suspect_field END, k) FILTER (kind = 'field_report') AS field, min(filed_at) AS first_seen, max(filed_at) AS last_seen, count(*) AS occurrences,
  arg_max(incident_id, k) AS latest_incident, arg_max(resolution, k) FILTER (resolution IS NOT NULL) AS resolution, max(resolved_at) AS resolution_recorded_at
  FROM (SELECT s.*, r.resolution, r.resolved_at, (filed_at, s.incident_id) AS k FROM {SIGNED} s LEFT JOIN <resolutions> r ON r.incident_id = s.incident_id WHERE signature IS NOT NULL) x GROUP BY 1, 2)"""


def signed(spark, root):
    return inc.signed(view(spark, root, "incidents"))


def known(spark, root):
    return inc.known_issues(signed(spark, root), view(spark, root, "resolutions"))


@query("incident_signatures", f"SELECT incident_id, signature, kind FROM {SIGNED} s")
def incident_signatures(spark, root):
    return signed(spark, root).select("incident_id", "signature", "kind")


@query("known_issues", f"""
SELECT * REPLACE (strftime(first_seen, {ISO}) AS first_seen, strftime(last_seen, {ISO}) AS last_seen, strftime(resolution_recorded_at, {ISO}) AS resolution_recorded_at) FROM {KNOWN} k
""")
def known_issues(spark, root):
    out = known(spark, root)
    for name in ("first_seen", "last_seen", "resolution_recorded_at"):
        out = out.withColumn(name, iso(F.col(name)))
    return out


@query("incident_recurrence", f"""
SELECT incident_id, org_id, signature, kind, n AS occurrence, n > 1 AS recurrence, n - 1 AS prior_occurrences, prior_incident, prior_resolution FROM (
  SELECT s.*, row_number() OVER w AS n, lag(s.incident_id) OVER w AS prior_incident,
    last_value(resolution IGNORE NULLS) OVER (PARTITION BY org_id, signature ORDER BY filed_at, s.incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_resolution
  FROM {SIGNED} s LEFT JOIN <resolutions> r ON r.incident_id = s.incident_id WHERE signature IS NOT NULL WINDOW w AS (PARTITION BY org_id, signature ORDER BY filed_at, s.incident_id)) x
""")
def incident_recurrence(spark, root):
    rows = signed(spark, root)
    return inc.recurrence(rows, view(spark, root, "resolutions"), wide=True)


@query("incident_statistics", f"""
SELECT i.org_id, incidents, last_incident_at, coalesce(known, 0) AS known, coalesce(unresolved, 0) AS unresolved FROM (
  SELECT org_id, count(*) AS incidents, strftime(max(filed_at), '%Y%m%dT%H%M%SZ') AS last_incident_at FROM <incidents> x GROUP BY 1) i
LEFT JOIN (SELECT org_id, count(*) AS known, sum(CASE WHEN resolution IS NULL THEN 1 ELSE 0 END)::BIGINT AS unresolved FROM {KNOWN} k GROUP BY 1) k ON k.org_id = i.org_id
""")
def incident_statistics(spark, root):
    return inc.org_statistics(signed(spark, root), known(spark, root))


@query("recent_fixes", f"""
SELECT org_id, signature, kind, type, field, substr(message_sample, 1, 240) AS message_sample, substr(resolution, 1, 400) AS resolution,
  strftime(resolution_recorded_at, {ISO}) AS resolution_recorded_at, occurrences FROM {KNOWN} k WHERE resolution IS NOT NULL AND org_id IN (SELECT org_id FROM {VISIBLE} v)
ORDER BY k.resolution_recorded_at DESC, org_id, signature LIMIT 6
""")
def recent_fixes(spark, root):
    return inc.recent_fixes(known(spark, root), access.visible_orgs(view(spark, root, "registry"), ME))


@query("known_issue_browse", f"""
SELECT org_id, signature, type, field, strftime(last_seen, {ISO}) AS last_seen FROM {KNOWN} k WHERE resolution IS NULL AND (contains(signature, 'err3') OR contains(lower(coalesce(type, '')), 'err3')
  OR contains(lower(coalesce(message_sample, '')), 'err3') OR contains(lower(coalesce(field, '')), 'err3'))
""")
def known_issue_browse(spark, root):
    return inc.browse(known(spark, root), " Err3", only_unresolved=True).select(
        "org_id", "signature", "type", "field", iso(F.col("last_seen")).alias("last_seen")
    )


@query("known_issue_totals", f"""
SELECT count(*) AS total, sum(CASE WHEN resolution IS NULL THEN 0 ELSE 1 END)::BIGINT AS with_fix, sum(CASE WHEN resolution IS NULL THEN 1 ELSE 0 END)::BIGINT AS undocumented FROM {KNOWN} k
""")
def known_issue_totals(spark, root):
    return inc.browse_totals(known(spark, root))


@query("incident_ids", """
SELECT incident_id, CASE WHEN n > 1 THEN concat(base, '_', n) ELSE base END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY incident_id) AS n FROM (
  SELECT o_orderkey AS incident_id, concat(strftime(o_orderdate, '%Y%m%dT%H%M%SZ'), '_', trim(regexp_replace(concat('Quote #', o_orderpriority, '!'), '[^A-Za-z0-9_-]', '_', 'g'), '_')) AS base FROM {orders}) b) x
""")
def incident_ids(spark, root):
    orders = table(spark, root, "orders").withColumnRenamed("o_orderkey", "incident_id")
    label = slug(F.concat(F.lit("Quote #"), F.col("o_orderpriority"), F.lit("!")), "incident")
    base = F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'"), label)
    return inc.unique_ids(orders, base, "incident_id", wide=True).select("incident_id", "unique_id")


@query("logs_already_filed", """
SELECT log_id, org_id, count(*) AS times, arg_max(incident_id, (filed_at, incident_id)) AS last_incident FROM <log_links> l GROUP BY 1, 2
""")
def logs_already_filed(spark, root):
    return inc.already_filed(view(spark, root, "log_links"))


@query("admin_week", """
SELECT 'top_user' AS item, username AS name, total_tokens AS value FROM (SELECT coalesce(username, '(unknown)') AS username, sum(total_tokens)::BIGINT AS total_tokens FROM <usage> u
  WHERE day > DATE '2024-01-23' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) t
UNION ALL SELECT 'week_tokens', 'all', sum(total_tokens)::BIGINT FROM <usage> u WHERE day > DATE '2024-01-23'
UNION ALL SELECT 'unverified', username, 1 FROM <users> u WHERE created_by = 'self' AND NOT coalesce(verified, FALSE) AND NOT disabled
""")
def admin_week(spark, root):
    rows = usage.report(usage.window(view(spark, root, "usage"), AS_OF, 7))
    top = rows.filter("dimension = 'username'").orderBy(F.desc("total_tokens"), "member").limit(3).select(
        F.lit("top_user").alias("item"), F.col("member").alias("name"), F.col("total_tokens").alias("value")
    )
    total = rows.filter("dimension = 'total'").select(F.lit("week_tokens").alias("item"), F.lit("all").alias("name"), F.col("total_tokens").alias("value"))
    waiting = view(spark, root, "users").filter(
        (F.col("created_by") == "self") & ~F.coalesce("verified", F.lit(False)) & ~F.col("disabled")
    ).select(F.lit("unverified").alias("item"), F.col("username").alias("name"), F.lit(1).cast("bigint").alias("value"))
    return top.unionByName(total).unionByName(waiting)


# every incident report asked against the known issues, and each signature against itself
ASKED = f"""(SELECT concat('r', incident_id) AS query_id, concat(coalesce(exc_type, 'Report'), ': ', CASE WHEN suspect_field IS NULL THEN message ELSE concat('wrong value of ', suspect_field) END) AS text FROM <incidents> i
  UNION ALL SELECT concat('s', org_id, signature), signature FROM {KNOWN} k)"""


@query("known_issue_match", rf"""
WITH qs AS (SELECT *, trim(regexp_replace(lower(regexp_replace(text, '''[^'']*''|"[^"]*"|:\w+|\b\d+\b', '?', 'g')), '\s+', ' ', 'g')) AS q FROM {ASKED} a),
qm AS (SELECT *, CASE WHEN regexp_full_match(text, '[0-9a-f]{{16}}') THEN text ELSE '' END AS sig, lower(regexp_extract(text, '\b(?:[A-Za-z]+\.)?[A-Za-z]*(?:Exception|Error)\b')) AS ty FROM qs),
q2 AS (SELECT q, sig, ty, list_filter(list_distinct(regexp_extract_all(q, '[a-z_][a-z0-9_.]{{2,}}')), lambda w: w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'was', 'are', 'not', 'from', 'line', 'column', 'class', 'trigger', 'attempt', 'error', 'exception', 'system')) AS qw
  FROM (SELECT DISTINCT q, sig, ty FROM qm) d),
i1 AS (SELECT *, trim(lower(regexp_replace(coalesce(message_sample, ''), '''[^'']*''|"[^"]*"|:\w+|\b\d+\b', '?', 'g'))) AS msg, lower(CASE WHEN kind = 'field_report' THEN concat('field report ', field)
   ELSE concat(type, ' ', regexp_replace(message_sample, '''[^'']*''|"[^"]*"|:\w+|\b\d+\b', '?', 'g')) END) AS e FROM {KNOWN} k),
i2 AS (SELECT *, list_filter(list_distinct(regexp_extract_all(e, '[a-z_][a-z0-9_.]{{2,}}')), lambda w: w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'was', 'are', 'not', 'from', 'line', 'column', 'class', 'trigger', 'attempt', 'error', 'exception', 'system')) AS ew FROM i1),
sc AS (SELECT q, sig, ty, concat(org_id, '/', signature) AS issue_id, resolution, last_seen, type, CASE WHEN sig = signature THEN 100 WHEN length(msg) >= 12 AND (contains(q, msg) OR (length(q) >= 12 AND contains(msg, q))) THEN 90
   WHEN field IS NOT NULL AND contains(q, lower(field)) THEN 80 WHEN len(ew) > 0 AND len(list_intersect(qw, ew)) >= 2 THEN floor(70.0 * len(list_intersect(qw, ew)) / len(ew)) ELSE 0 END AS base FROM q2, i2),
fin AS (SELECT *, CASE WHEN base > 0 AND type IS NOT NULL AND ty <> '' AND contains(lower(type), ty) THEN base + 15 ELSE base END AS s0 FROM sc),
top AS (SELECT *, row_number() OVER (PARTITION BY q, sig, ty ORDER BY least(s0, 100) DESC, resolution IS NOT NULL DESC, last_seen DESC, issue_id) AS place FROM fin WHERE s0 >= 40)
SELECT query_id, place, issue_id, least(s0, 100)::BIGINT AS score FROM top JOIN qm USING (q, sig, ty) WHERE place <= 8
""")
def known_issue_match(spark, root):
    issues = known(spark, root).withColumn("issue_id", F.concat_ws("/", "org_id", "signature"))
    text = F.when(F.col("suspect_field").isNull(), F.col("message")).otherwise(F.concat(F.lit("wrong value of "), F.col("suspect_field")))
    reports = view(spark, root, "incidents").select(
        F.concat(F.lit("r"), F.col("incident_id").cast("string")).alias("query_id"),
        F.concat(F.coalesce("exc_type", F.lit("Report")), F.lit(": "), text).alias("text"),
    )
    ids = issues.select(F.concat(F.lit("s"), F.col("org_id"), F.col("signature")).alias("query_id"), F.col("signature").alias("text"))
    # masking costs far more than the bytes of a report
    return inc.match_known(issues, spread(reports.unionByName(ids), "query_id"))


# masked and lower-cased as the operator does; DuckDB's word boundary knows ASCII only, so letters and digits are spelt out
MASKED = r'''trim(regexp_replace(lower(regexp_replace(text, ''' + "'" + r"""''[^'']*''|"[^"]*"|:[\p{L}\p{N}_]+|\b\d+\b', '?', 'g')), '\s+', ' ', 'g'))"""
STOPPED = "('the', 'and', 'for', 'with', 'this', 'that', 'was', 'are', 'not', 'from', 'line', 'column', 'class', 'trigger', 'attempt', 'error', 'exception', 'system')"
WORDS = "list_filter(list_distinct(regexp_extract_all({0}, '[a-z_][a-z0-9_.]{{2,}}')), lambda w: w NOT IN " + STOPPED + ")"


@query("passage_match", rf"""
WITH q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {MASKED} AS q FROM benchmark WHERE trim(coalesce(text, '')) <> ''),
d AS (SELECT CAST(doc_id AS VARCHAR) AS issue_id, doc_id, {MASKED} AS msg FROM documents),
qw AS (SELECT *, {WORDS.format('q')} AS qws FROM q), dw AS (SELECT *, {WORDS.format('msg')} AS dws FROM d),
s AS (SELECT query_id, issue_id, doc_id, CASE WHEN length(msg) >= 12 AND (contains(q, msg) OR (length(q) >= 12 AND contains(msg, q))) THEN 90
  WHEN len(dws) > 0 AND len(list_intersect(qws, dws)) >= 2 THEN floor(70.0 * len(list_intersect(qws, dws)) / len(dws)) ELSE 0 END AS score FROM qw, dw),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC, issue_id) AS place FROM s WHERE score >= 40)
SELECT query_id, place, issue_id, CAST(score AS BIGINT) AS score FROM r WHERE place <= 8
""")
def passage_match(spark, root):
    """Texts with real overlap: benchmark passages against documents as recorded messages."""
    issues = table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("issue_id"), F.substring(F.sha2("text", 256), 1, 16).alias("signature"), F.lit("exception").alias("kind"),
        F.lit(None).cast("string").alias("type"), F.col("text").alias("message_sample"), F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("resolution"), F.col("doc_id").alias("last_seen"),
    )
    queries = table(spark, root, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return inc.match_known(spread(issues, "issue_id"), queries)
