"""The questions a caller can ask, one function each, over the tables of an installation.

``Tables`` names the DataFrames; every function returns a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import access, activity, async_jobs, component_graph, debug_logs, filing, incidents, org_index, packing, summary, token_usage
from faultline.operators.access import Identity
from faultline.session import cut_lineage, written
from faultline.sources import stores


@dataclass
class Tables:
    registry: DataFrame | None = None
    cards: DataFrame | None = None
    call_edges: DataFrame | None = None
    call_sites: DataFrame | None = None
    ui_imports: DataFrame | None = None
    flow_actions: DataFrame | None = None
    subflows: DataFrame | None = None
    entry_points: DataFrame | None = None
    object_entries: DataFrame | None = None
    field_writes: DataFrame | None = None
    manifest: DataFrame | None = None
    incidents: DataFrame | None = None
    resolutions: DataFrame | None = None
    log_library: DataFrame | None = None
    log_links: DataFrame | None = None


def _of(df: DataFrame, org_id: str) -> DataFrame:
    return df.filter(F.col("org_id") == org_id)


def refresh(classes: DataFrame, triggers: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Extract the sources of some organisations, replace their part of the knowledgebase, and return the tables."""
    index = org_index.extract(classes, triggers)
    stores.save_knowledgebase(index, folder)
    return stores.load_knowledgebase(classes.sparkSession, folder)


def list_orgs(t: Tables, who: Identity, text: str = "") -> DataFrame:
    return access.filter_orgs(access.visible_orgs(t.registry, who), text)


def list_accounts(t: Tables, who: Identity) -> DataFrame:
    return access.account_list(access.visible_orgs(t.registry, who))


def org_stats(t: Tables, org_id: str) -> DataFrame:
    return component_graph.org_statistics(_of(t.cards, org_id), _of(t.entry_points, org_id), _of(t.field_writes, org_id))


def component(t: Tables, org_id: str, raw_id: str) -> DataFrame:
    """The card an id means, however it is spelled."""
    cards = _of(t.cards, org_id)
    asked = cards.sparkSession.createDataFrame([(org_id, 0, raw_id)], "org_id string, request_id int, raw string")
    hit = component_graph.resolve_ids(asked, cards).select("org_id", "component_id", "method", "how")
    return cards.join(hit, ["org_id", "component_id"])


def component_method(t: Tables, org_id: str, component_id: str, method: str) -> DataFrame:
    sites = _of(t.call_sites, org_id).filter(F.col("caller") == component_id)
    return component_graph.method_filter(sites, method)


def object_touch(t: Tables, org_id: str, object_name: str) -> DataFrame:
    touch = component_graph.object_touch(_of(t.cards, org_id), _of(t.field_writes, org_id))
    return touch.filter(F.col("object") == object_name).orderBy("role", "component_id")


def field_writers(t: Tables, org_id: str, field: str) -> DataFrame:
    touch = component_graph.field_touch(_of(t.field_writes, org_id).filter(F.col("field") == field))
    return component_graph.field_writers(touch, _of(t.cards, org_id), _of(t.manifest, org_id))


def inbound_references(t: Tables, org_id: str, component_id: str) -> DataFrame:
    """Everything that calls a component, in any spelling of its name."""
    parts = [_of(x, org_id) for x in (t.call_edges, t.ui_imports, t.flow_actions, t.subflows)]
    return component_graph.inbound(*parts).filter(F.lower("target") == component_id.lower())


def entry_points(t: Tables, org_id: str, object_name: str) -> DataFrame:
    return _of(t.object_entries, org_id).filter(F.col("object") == object_name)


def search(t: Tables, org_id: str, q: str, customer_authored_only: bool = True) -> DataFrame:
    cards, writes = _of(t.cards, org_id), _of(t.field_writes, org_id)
    return component_graph.search(cards, component_graph.object_touch(cards, writes), writes, q, customer_authored_only)


def list_incidents(t: Tables, org_id: str) -> DataFrame:
    return _of(t.incidents, org_id).orderBy(F.desc("incident_id"))


def known_issues(t: Tables, org_id: str, text: str | None = None, only_unresolved: bool = False) -> DataFrame:
    known = incidents.known_issues(incidents.signed(_of(t.incidents, org_id)), t.resolutions)
    return incidents.browse(known, text, only_unresolved)


def find_known_issue(t: Tables, who: Identity, query: str) -> DataFrame:
    seen = access.visible_orgs(t.registry, who).select("org_id")
    known = incidents.known_issues(incidents.signed(t.incidents.join(seen, "org_id", "left_semi")), t.resolutions)
    issues = known.withColumn("issue_id", F.concat_ws("/", "org_id", "signature"))
    asked = t.incidents.sparkSession.createDataFrame([("q", query)], "query_id string, text string")
    best = incidents.match_known(issues, asked)
    return best.join(issues, "issue_id").orderBy("place")


def file_incidents(t: Tables, filings: DataFrame, lines: DataFrame, wide: bool = False) -> dict[str, DataFrame]:
    """File logs and suspect fields (incident_id, org_id, filed_at, log_id, suspect_field) in one call.

    The lines are read once.  ``reports`` tells signature, recurrence, known
    fix and warnings of each filing; ``components``, ``objects`` and
    ``suspects`` are its context pack.  Cards need ``has_callout``.
    """
    found = debug_logs.sweep(lines, wide)
    units, raised = debug_logs.execution_units(found, wide), debug_logs.thrown(found, wide)
    statements = debug_logs.query_events(found, wide).select("log_id", "object").unionByName(debug_logs.dml_events(found, wide).select("log_id", "object"))
    signed = cut_lineage(filing.filed(filings, raised))
    touch = component_graph.field_touch(t.field_writes)
    warnings = filing.field_warnings(filings, component_graph.field_writers(touch, t.cards, t.manifest))
    tokens = debug_logs.involved_components(units, raised, t.cards.select("component_id").distinct())
    # read by the pack and by its objects; the pack has a row for each filing and component, and is made only where it is asked for
    named = cut_lineage(filing.named_components(filings, tokens, t.cards))
    # filings that ask for the same have one pack: it is made once, and given to each of them last
    requests = filing.pack_requests(filings, named)
    fields, units_named = (filing.asked_packs(requests, kind, name) for kind, name in (("field", "suspect_field"), ("component", "component_id")))
    # written: of their size depends how the edges and writes of whole organisations meet them
    asked = written(named.select("org_id", "component_id").distinct(), "named-components")
    asked_fields = written(filings.select("org_id", F.col("suspect_field").alias("field")).filter("field IS NOT NULL").distinct(), "suspect-fields")
    suspected = component_graph.field_touch(t.field_writes.join(asked_fields, ["org_id", "field"], "left_semi"))
    packed = filing.pack_components(fields, units_named, t.call_edges, t.cards, suspected, key=filing.PACK, asked=asked)
    packed = filing.with_recency(packed, t.cards, t.manifest, key=filing.PACK)
    counts = component_graph.touch_counts(component_graph.object_touch(t.cards, t.field_writes))
    dml = t.field_writes.filter("persistence = 'persisted'").select("org_id", F.col("component").alias("component_id")).distinct()
    return {
        "reports": filing.reports(signed, incidents.signed(t.incidents), t.resolutions, t.log_links, warnings, wide),
        "components": filing.of_filings(packed, requests), "objects": filing.pack_objects(filings, named, t.cards, statements, counts),
        "suspects": filing.of_filings(filing.suspect_points(packed, t.cards, dml, key=filing.PACK), requests),
    }


def list_logs(t: Tables, who: Identity, **filters: str) -> DataFrame:
    return access.search_logs(access.decorated_logs(t.log_library, t.log_links, t.registry, who), who, **filters)


def normalize_logs(
    lines: DataFrame, component_ids: DataFrame | None = None, headers: DataFrame | None = None, wide: bool = False
) -> dict[str, DataFrame]:
    """All sections of all logs from one pass over the lines; ``headers`` (log_id, header) adds what the log levels hide."""
    found = debug_logs.sweep(lines, wide)
    units, raised = debug_logs.execution_units(found, wide), debug_logs.thrown(found, wide)
    jobs = cut_lineage(async_jobs.evidence(found, wide))
    entries = debug_logs.entry_units(units)
    components = debug_logs.involved_components(units, raised, component_ids)
    queries = debug_logs.query_summary(debug_logs.query_events(found, wide))
    routed, limits = debug_logs.routed(found), debug_logs.limits(found, wide)
    sections = {
        "meta": debug_logs.log_meta(found, units, raised, components), "context": entries,
        "execution_units": units, "exceptions": debug_logs.exceptions(raised), "soql_summary": queries,
        "dml_summary": debug_logs.dml_summary(debug_logs.dml_events(found, wide)),
        **{name: routed.filter(F.col("section") == name).drop("section") for name in debug_logs.ROUTED},
        "limits_by_namespace": limits, "limits_final": limits.filter("is_final"), "involved_components": components,
        "missing_fields": debug_logs.missing_field_evidence(raised, queries), "async_presence": async_jobs.presence(jobs, entries),
        "dispatches": async_jobs.shown_dispatches(jobs, wide), "failed_async_limit": async_jobs.failures(jobs),
        "job_constructions": async_jobs.job_constructions(jobs),
    }
    if headers is not None:
        sections["visibility"] = debug_logs.visibility(headers, found)
    return sections


def log_section(section: DataFrame, order: str, offset: int = 0, limit: int = 50) -> DataFrame:
    return debug_logs.section_page(section, order, offset, limit)


# ---- usage, activity, summary -------------------------------------------------


def usage_report(ledger: DataFrame, as_of: str, days: int | None = None, username: str | None = None, org_id: str | None = None) -> DataFrame:
    """Token use by user, organisation and model over the last days, with the total."""
    return token_usage.report(token_usage.window(ledger, as_of, days, username, org_id))


def usage_by_day(ledger: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    return token_usage.by_day(token_usage.window(ledger, as_of, days), as_of, days)


def quota(users: DataFrame, ledger: DataFrame, as_of: str) -> DataFrame:
    """What each user may still spend, and whether the next turn is allowed."""
    return token_usage.turn_allowed(token_usage.quota_status(users, ledger, as_of))


def activity_report(ledger: DataFrame, usage: DataFrame, registry: DataFrame, as_of: str, days: int | None = None) -> dict[str, DataFrame]:
    """All sections of the activity report over one window, each a table.

    The ledger is read for the pre-aggregate, for the durations and for the
    last events; every breakdown reads the pre-aggregate.
    """
    window = activity.conform(token_usage.window(ledger, as_of, days))
    rows, times = cut_lineage(activity.grain(window)), cut_lineage(activity.latencies(window))
    spent = token_usage.window(usage, as_of, days)
    users, orgs = activity.users(rows, spent), activity.orgs(rows, registry)
    return {
        "totals": activity.totals(rows, spent), "by_day": activity.by_day_channel(rows, as_of, days), "channels": activity.by_channel(rows),
        "features": activity.features(rows, times), "categories": activity.categories(rows), "tools": activity.tools(rows, times),
        "clients": activity.clients(rows), "log_parser": activity.log_parser(cut_lineage(activity.parses(window))),
        "users": users, "segments": activity.segments(users), "ladder": activity.ladder(rows), "orgs": orgs, "accounts": activity.accounts(orgs),
        "hours": activity.hours(rows), "errors": activity.errors(rows), "recent": activity.recent(window),
    }


def own_activity(ledger: DataFrame, usage: DataFrame, username: str, as_of: str, days: int | None = None, last: int = 50) -> dict[str, DataFrame]:
    """One user's own report: totals, days, channels, features, tools, and the last events."""
    window = activity.conform(token_usage.window(ledger, as_of, days)).filter(F.col("username") == username)
    mine, times = cut_lineage(activity.grain(window)), cut_lineage(activity.latencies(window))
    spent = token_usage.window(usage, as_of, days)
    return {
        "totals": activity.own_report(mine, spent, username), "by_day": activity.by_day_channel(mine, as_of, days), "channels": activity.by_channel(mine),
        "features": activity.features(mine, times), "tools": activity.tools(mine, times), "recent": activity.recent(window, last),
    }


def executive_summary(ledger: DataFrame, usage: DataFrame, registry: DataFrame, as_of: str, days: int) -> dict[str, DataFrame]:
    """The lists of the executive summary for one period."""
    rows, spent = activity.conform(token_usage.window(ledger, as_of, days)), token_usage.window(usage, as_of, days)
    effort = summary.org_effort(rows, spent, registry)
    return {
        "trend": summary.trend(rows, spent, as_of, days), "top_orgs": summary.top_orgs(effort),
        "top_accounts": summary.top_accounts(effort), "top_people": summary.top_people(rows, spent), "channels": summary.channel_mix(rows),
        "top_features": summary.top_features(rows), "top_models": summary.top_models(spent),
    }


# ---- context within a budget ----------------------------------------------------


def packed_card(items: DataFrame, max_chars: int) -> DataFrame:
    """The items of each card section that fit a budget of characters."""
    return packing.pack_cards(items, ["org_id", "component_id"], max_chars, wide=True)


def packed_log(items: DataFrame, max_chars: int) -> DataFrame:
    """What fits of each log, with what was left out by section."""
    return packing.pack_report(items, packing.pack_logs(items, max_chars))


def pack_normalized_logs(lines: DataFrame, max_chars: int, component_ids: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """What fits of each log, straight from its lines: sections compacted first, then packed."""
    items = cut_lineage(packing.log_items(debug_logs.sweep(lines, wide), component_ids, wide))
    return packing.pack_report(items, packing.pack_logs(items, max_chars))
