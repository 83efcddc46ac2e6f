"""What grows with the sources never goes through the driver."""

import pytest

from faultline.operators import org_index
from faultline.operators import source_code as sc
from faultline.session import written

A = "public class A {\n  static Map<String, Id> seen = new Map<String, Id>();\n  public void run() { if (x) { B.go(1); } rec.State__c = seen.get(1); update rec; System.enqueueJob(new B()); }\n}"
B = "public class B {\n  public static void go(Integer n) { try { A.run(); } catch (DmlException e) { System.debug(e); } }\n}"


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([("o", "A", A), ("o", "B", B)], "org_id string, component_id string, code string")


def broadcasts(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_sections_of_sources_are_joined_without_broadcast(sources):
    prep, names = sc.prepared(sources), sources.selectExpr("org_id", "component_id AS name")
    stmts = written(sc.statements(prep), "statements")
    started = sc.async_dispatches(prep, stmts, names)
    sections = {
        "dispatches": started, "calls": sc.calls_to(stmts, names, started), "sites": sc.call_sites(stmts, names), "writes": sc.field_writes(prep, stmts),
        "handlers": sc.catch_handlers(prep, stmts), "methods": sc.methods(prep, stmts), "flags": sc.flags(prep, stmts),
    }
    assert {name: broadcasts(rows) for name, rows in sections.items()} == dict.fromkeys(sections, 0)
    assert sections["sites"].count() == 2


def test_index_is_joined_without_broadcast(sources):
    index = org_index.lookups(org_index.extract(sources, sources.limit(0)))
    assert {name: broadcasts(rows) for name, rows in index.items()} == dict.fromkeys(index, 0)


def test_refresh_finds_sources_without_broadcast(spark, sources):
    manifest = org_index.manifest(sources, sources.limit(0))
    code = sources.selectExpr("org_id", "concat('classes/', component_id, '.cls') AS source", "code")
    fresh, gone = org_index._affected(manifest, manifest.filter("component_id = 'A'"), code)
    assert (broadcasts(fresh), broadcasts(gone)) == (0, 0)
    assert sorted(r.source for r in fresh.collect()) == ["classes/A.cls", "classes/B.cls"] and gone.count() == 0
