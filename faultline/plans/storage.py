"""Tables written to storage and read again: what was kept is what comes back.

Each query writes to a folder of its own under the shared folder of the session.
"""

from pyspark.sql import functions as F

from faultline.plans.debug_logs import UNITS, rows
from faultline.plans.registry import query
from faultline.operators import debug_logs as logs
from faultline.session import scratch_path
from faultline.sources import ledger, stores
from faultline.sources.views import view


@query("stored_call_edges", "SELECT org_id, src, dst, via FROM <call_edges> e WHERE org_id = 'org_1'")
def stored_call_edges(spark, root):
    """The knowledgebase of all orgs, saved twice, of which one org is loaded."""
    folder = scratch_path(spark, "knowledgebase")
    edges = view(spark, root, "call_edges").select("org_id", "src", "dst", "via")
    for _ in range(2):  # saving again replaces
        stores.save_knowledgebase({"call_edges": edges}, folder)
    return stores.load_knowledgebase(spark, folder, "org_1")["call_edges"].select("org_id", "src", "dst", "via")


@query("stored_log_sections", f"SELECT log_id, label, depth, had_exception FROM {UNITS} u")
def stored_log_sections(spark, root):
    """A section of all logs on storage, as a download by log would read it."""
    folder = scratch_path(spark, "sections")
    found, wide = rows(spark, root)
    stores.save_section(logs.execution_units(found, wide), "execution_units", folder)
    return stores.load_section(spark, "execution_units", folder).select("log_id", "label", "depth", "had_exception")


@query("stored_incidents", "SELECT incident_id, org_id, exc_type, message FROM <incidents> i WHERE org_id = 'org_2'")
def stored_incidents(spark, root):
    folder = scratch_path(spark, "incidents")
    stores.save_incidents(view(spark, root, "incidents").select("incident_id", "org_id", "exc_type", "message"), folder)
    return stores.list_incidents(spark, folder, "org_2").select("incident_id", "org_id", "exc_type", "message")


@query("stored_ledger", """
SELECT CAST(event_date AS VARCHAR) AS day, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS event_date, user_id FROM {events}) e
WHERE user_id <> 7 AND event_date >= (SELECT max(CAST(ts AS DATE)) FROM {events}) - 10 GROUP BY 1
""")
def stored_ledger(spark, root):
    """A ledger by day, with one user forgotten and old days pruned."""
    from faultline.sources.tables import table

    folder = scratch_path(spark, "ledger")
    events = table(spark, root, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("username"))
    ledger.append(events, folder)
    ledger.forget_user(spark, folder, "7")
    last = ledger.read(spark, folder).agg(F.max("day").cast("string").alias("d")).first()["d"]
    ledger.prune(spark, folder, last, 10)
    return ledger.read(spark, folder).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
