"""Visibility, accounts, log library and listing queries."""

from faultline.operators import access as acc
from faultline.operators.access import Identity
from faultline.plans.registry import query
from faultline.sources.views import view

ME = Identity("user_7")
ADMIN = Identity("user_0", "admin")

SEEN = "(coalesce(visibility, '') = 'public' OR coalesce(owner, '') = 'user_7')"
HOST = r"lower(regexp_extract(regexp_replace(trim(coalesce(instance_url, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '^(?:[^/?#@]*@)?([^/?#:]*)', 1))"
R = rf"""(SELECT *, CASE WHEN h = '' THEN 'unknown' WHEN contains(h, '.scratch.') THEN 'scratch' WHEN contains(h, '.develop.') THEN 'developer'
    WHEN contains(h, '.sandbox.') OR starts_with(h, 'test.') OR regexp_matches(h, '^cs\d+\.') OR contains(split_part(h, '.', 1), '--') THEN 'sandbox'
    WHEN contains(h, 'salesforce.com') OR contains(h, 'force.com') THEN 'production' ELSE 'unknown' END AS environment,
  CASE WHEN (contains(h, '.my.salesforce.com') OR contains(h, '.my.site.com') OR contains(h, '.force.com'))
    AND NOT regexp_full_match(split_part(h, '.', 1), '(na|cs|eu|ap|um|gs)\d+') THEN nullif(split_part(split_part(h, '.', 1), '--', 1), '') END AS my_domain,
  coalesce(lower(nullif(trim(regexp_replace(account, '\s+', ' ', 'g')), '')), '__unassigned__') AS key
  FROM (SELECT *, {HOST} AS h FROM <registry> g0) g1)"""
VISIBLE = f"""(SELECT org_id, name, CASE WHEN visibility IN ('public', 'private') THEN visibility ELSE 'private' END AS visibility, owner,
  coalesce(owner, '') = 'user_7' AS can_manage, account, environment, my_domain, instance_url, key FROM {R} r WHERE {SEEN})"""


def _registry(spark, root):
    return view(spark, root, "registry")


@query("visible_orgs", f"SELECT * EXCLUDE (key) FROM {VISIBLE} v")
def visible_orgs(spark, root):
    return acc.visible_orgs(_registry(spark, root), ME)


@query("org_filter", f"""SELECT org_id, environment FROM {VISIBLE} v
WHERE contains(lower(concat_ws(' ', org_id, name, owner, account, environment)), 'prod')""")
def org_filter(spark, root):
    return acc.filter_orgs(acc.visible_orgs(_registry(spark, root), ME), " Prod ").select("org_id", "environment")


@query("stale_orgs", "SELECT org_id, extracted_days_ago FROM <registry> r WHERE extracted_days_ago > 30")
def stale_orgs(spark, root):
    return acc.stale_orgs(_registry(spark, root))


@query("account_suggestions", f"""
SELECT r.org_id, r.my_domain, r.environment, matched_account, coalesce(siblings, 0) AS siblings, coalesce(matched_account, r.my_domain) AS suggestion
FROM {R} r LEFT JOIN (SELECT my_domain, count(*) AS siblings, arg_min(account, org_id) FILTER (account IS NOT NULL) AS matched_account
  FROM {VISIBLE} v WHERE my_domain IS NOT NULL GROUP BY 1) b ON b.my_domain = r.my_domain
""")
def account_suggestions(spark, root):
    return acc.account_suggestions(_registry(spark, root), ME)


@query("account_snap", f"""
SELECT a.org_id, a.account, coalesce((SELECT arg_min(b.account, b.org_id) FROM {R} b WHERE b.key = a.key AND b.org_id <> a.org_id),
  trim(regexp_replace(a.account, '\\s+', ' ', 'g'))) AS snapped FROM {R} a WHERE key <> '__unassigned__'
""")
def account_snap(spark, root):
    return acc.snapped_accounts(_registry(spark, root))


@query("account_list", f"""
SELECT key, arg_min(account, org_id) AS account, count(*) AS org_count, bool_and(can_manage) AS can_manage_all, min(org_id) AS first_org, max(txt) AS environments
FROM {VISIBLE} v JOIN (SELECT key, string_agg(concat(environment, '=', n), ',' ORDER BY environment) AS txt FROM (
  SELECT key, environment, count(*) AS n FROM {VISIBLE} v GROUP BY 1, 2) q GROUP BY 1) e USING (key) GROUP BY key
""")
def account_list(spark, root):
    return acc.account_list(acc.visible_orgs(_registry(spark, root), ME))


SPELL = f"""SELECT key, arg_min(name, (-uses, name = lower(name), name)) AS spelling, sum(uses)::BIGINT AS orgs, count(*) AS spellings FROM (
  SELECT key, trim(regexp_replace(account, '\\s+', ' ', 'g')) AS name, count(*) AS uses FROM {R} r WHERE key <> '__unassigned__' GROUP BY 1, 2) t GROUP BY 1"""


@query("account_spellings", SPELL)
def account_spellings(spark, root):
    return acc.account_spellings(_registry(spark, root))


@query("account_groups", f"""
SELECT org_id, v.key, spelling AS group_name, v.key = '__unassigned__' AS unassigned, v.key = 'asia' AS account_pinned, org_id = 'org_6' AS org_pinned,
  org_id = 'org_7' AS is_current, list_position(['production', 'sandbox', 'developer', 'scratch', 'unknown'], environment)::BIGINT AS env_rank
FROM {VISIBLE} v LEFT JOIN ({SPELL}) s ON s.key = v.key
""")
def account_groups(spark, root):
    registry = _registry(spark, root)
    return acc.grouped_orgs(acc.visible_orgs(registry, ME), registry, ["asia"], ["org_6"], "org_7")


@query("account_rename_gate", f"""
SELECT key, visible, blocked, CASE WHEN visible = 0 THEN 'not found' WHEN blocked > 0 THEN 'refused' ELSE 'allowed' END AS verdict FROM (
  SELECT key, sum(CASE WHEN {SEEN} THEN 1 ELSE 0 END)::BIGINT AS visible, sum(CASE WHEN {SEEN} AND coalesce(owner, '') <> 'user_7' THEN 1 ELSE 0 END)::BIGINT AS blocked
  FROM {R} r WHERE key <> '__unassigned__' GROUP BY 1) g
""")
def account_rename_gate(spark, root):
    return acc.rename_gate(_registry(spark, root), ME)


@query("account_rename", f"""
SELECT org_id, CASE WHEN key = 'africa' THEN coalesce((SELECT arg_min(account, org_id) FROM {R} x WHERE key = 'asia'), 'ASIA') ELSE account END AS account,
  key = 'africa' AS moved FROM {R} r
""")
def account_rename(spark, root):
    return acc.renamed(_registry(spark, root), " Africa ", "ASIA", ADMIN)


LOGS = f"""(SELECT l.log_id, label, source_log, l.org_id, g.name AS org_name, environment AS org_environment, l.owner, top_exception, components,
  coalesce(g.account, l.account) AS account, archived, coalesce(l.owner, '') = 'user_7' AS can_manage, coalesce(n, 0) AS incident_links, last_incident
FROM <log_library> l LEFT JOIN {R} g ON g.org_id = l.org_id
LEFT JOIN (SELECT log_id, count(*) AS n, arg_max(incident_id, (filed_at, incident_id)) AS last_incident FROM <log_links> k
  WHERE org_id IN (SELECT org_id FROM {VISIBLE} v) GROUP BY 1) i ON i.log_id = l.log_id
WHERE coalesce(l.owner, '') = 'user_7' OR g.org_id IS NULL OR g.org_id IN (SELECT org_id FROM {VISIBLE} v))"""


def _logs(spark, root):
    return acc.decorated_logs(view(spark, root, "log_library"), view(spark, root, "log_links"), _registry(spark, root), ME)


@query("library_logs", f"SELECT * FROM {LOGS} x")
def library_logs(spark, root):
    return _logs(spark, root)


HAY = "lower(concat_ws(' ', label, log_id, source_log, org_id, org_name, account, owner, top_exception, components))"


@query("library_search", f"""
SELECT log_id, label FROM {LOGS} x WHERE NOT archived AND contains({HAY}, 'system.err') AND contains({HAY}, 'case')
""")
def library_search(spark, root):
    return acc.search_logs(_logs(spark, root), ME, q=" System.ERR  case ").select("log_id", "label")


@query("library_filter", f"""
SELECT log_id, org_id, account, archived FROM {LOGS} x WHERE coalesce(lower(trim(account)), '__unassigned__') = '__unassigned__' AND owner = 'user_7'
""")
def library_filter(spark, root):
    return acc.search_logs(_logs(spark, root), ME, account="__unassigned__", owner="me", status="all").select(
        "log_id", "org_id", "account", "archived"
    )


KEYED = f"(SELECT *, coalesce(lower(nullif(trim(account), '')), '__unassigned__') AS key FROM {LOGS} x)"
_ARCH = "sum(CASE WHEN archived THEN 1 ELSE 0 END)::BIGINT AS archived"


@query("library_facets", f"""
SELECT 'total' AS facet, 'all' AS member, count(*) AS count, {_ARCH} FROM {KEYED} k
UNION ALL SELECT 'account', key, count(*), {_ARCH} FROM {KEYED} k GROUP BY 2
UNION ALL SELECT 'org', org_id, count(*), {_ARCH} FROM {KEYED} k WHERE org_id IS NOT NULL GROUP BY 2
UNION ALL SELECT 'owner', owner, count(*), {_ARCH} FROM {KEYED} k WHERE owner IS NOT NULL GROUP BY 2
""")
def library_facets(spark, root):
    return acc.library_facets(_logs(spark, root))


@query("user_listing", "SELECT username, role, created_by, coalesce(verified, FALSE) AS verified, disabled, display_name FROM <users> u")
def user_listing(spark, root):
    return acc.user_listing(view(spark, root, "users"))


@query("token_listing", "SELECT token_id, username, kind, name, created_days_ago FROM <tokens> t")
def token_listing(spark, root):
    return acc.token_listing(view(spark, root, "tokens"))
