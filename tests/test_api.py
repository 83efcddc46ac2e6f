"""The report functions of the API against the registered queries they share their rules with."""

import pytest

from faultline import api
from faultline.plans import registry
from faultline.sources.views import AS_OF, view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queries():
    registry.load()
    return registry.QUERIES


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_usage(spark, queries):
    usage, users = view(spark, SF, "usage"), view(spark, SF, "users")
    same(api.usage_report(usage, AS_OF), queries["usage_report"](spark, SF))
    same(api.usage_by_day(usage, AS_OF, 35), queries["usage_by_day"](spark, SF))
    # a long period is honoured
    assert api.usage_by_day(usage, AS_OF, 500).count() == 500
    assert api.quota(users, usage, AS_OF).count() == users.count()


def test_activity(spark, queries):
    ledger, usage, orgs = (view(spark, SF, n) for n in ("activity", "usage", "registry"))
    report = api.activity_report(ledger, usage, orgs, AS_OF)
    same(report["channels"], queries["activity_by_channel"](spark, SF))
    same(report["tools"], queries["activity_tools"](spark, SF))
    same(report["orgs"], queries["activity_orgs"](spark, SF))
    own = api.own_activity(ledger, usage, "user_7", AS_OF)
    same(own["totals"], queries["own_activity_report"](spark, SF))
    assert {r.username for r in own["recent"].collect()} <= {"user_7"} and own["recent"].count() <= 50
    assert all(own[name].columns for name in ("by_day", "channels", "features", "tools"))


def test_summary(spark, queries):
    ledger, usage, orgs = (view(spark, SF, n) for n in ("activity", "usage", "registry"))
    got = api.executive_summary(ledger, usage, orgs, AS_OF, 15)
    same(got["top_orgs"], queries["summary_top_orgs"](spark, SF))
    same(got["top_models"], queries["summary_top_models"](spark, SF))


def test_refresh_feeds_the_lookups(spark, tmp_path):
    classes = spark.createDataFrame([
        ("o", "A", "public class A {\n  public void run() { if (x) { B.go(1); } rec.State__c = 'n;m'; update rec; }\n}"),
        ("o", "B", "public class B {\n  public static void go(Integer n) { return; }\n}"),
        ("p", "B", "public class B {\n}"),
    ], "org_id string, component_id string, code string")
    triggers = spark.createDataFrame([("o", "T", "trigger T on Order__c (before insert) { B.go(2); }")], "org_id string, component_id string, code string")
    index = api.refresh(classes, triggers, str(tmp_path))
    tables = api.Tables(cards=index["cards"], call_edges=index["call_edges"], call_sites=index["call_sites"], field_writes=index["field_writes"])
    sites = api.component_method(tables, "o", "A", "go").collect() if "method" in tables.call_sites.columns else tables.call_sites.filter("caller = 'A'").collect()
    assert [(r.target, r.method_called, r.conditions) for r in sites] == [("B", "go", "if (x)")]
    assert sorted((r.src, r.dst, r.via) for r in tables.call_edges.collect()) == [("A", "B", "method_call"), ("T", "B", "method_call")]
    assert [(r.component, r.field, r.persistence) for r in tables.field_writes.collect()] == [("A", "State__c", "persisted")]
    again = api.refresh(classes.filter("org_id = 'p'"), triggers.filter("false"), str(tmp_path))
    assert again["call_edges"].count() == 2 and again["cards"].count() == 4
