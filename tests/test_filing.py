"""Incidents filed from logs, on an installation written by hand."""

import datetime

import pytest

from faultline import api
from faultline.operators import debug_logs, filing

LOG = [
    "1|CODE_UNIT_STARTED|[EXTERNAL]|Alpha",
    "1|SOQL_EXECUTE_BEGIN|[1]|Aggregations:0|SELECT Id FROM Order__c",
    "1|SOQL_EXECUTE_END|[1]|Rows:3",
    "1|EXCEPTION_THROWN|[3]|A.B: boom 17",
    "1|FATAL_ERROR|A.B: boom 17",
    "Class.Foo.bar: line 7, column 1",
    "1|EXCEPTION_THROWN|[3]|C.D: later",
    "1|CODE_UNIT_FINISHED|Alpha",
]
QUIET = ["1|CODE_UNIT_STARTED|[EXTERNAL]|Gone", "", "1|CODE_UNIT_FINISHED|Gone"]


def day(n):
    return datetime.date(2024, 1, n)


def installation(spark):
    table = spark.createDataFrame
    cards = [("o1", x, k, None, None, obj, False, False) for x, k, obj in (
        ("Alpha", "ApexClass", "Order__c"), ("Beta", "ApexClass", None), ("Gamma", "ApexTrigger", "Item__c"), ("Delta", "Flow", None))]
    return api.Tables(
        cards=table(cards + [("o2", "Beta", "ApexClass", None, None, None, False, False)],
                    "org_id string, component_id string, type string, namespace string, is_test_flag boolean, object string, is_managed boolean, has_callout boolean")
        .selectExpr("*", "true AS is_customer_authored"),
        call_edges=table([("o1", "Alpha", "Beta"), ("o1", "Alpha", "Nowhere"), ("o1", "Gamma", "Alpha"), ("o2", "Alpha", "Beta")], "org_id string, src string, dst string"),
        field_writes=table([("o1", 1, 1, "Delta", "F__c", "high", "Flow", None, "persisted")],
                           "org_id string, write_id long, seq long, component string, field string, risk string, mechanism string, source_map string, persistence string"),
        manifest=table([("o1", "classes/Alpha.cls", 86400), ("o1", "triggers/Gamma.trigger", 86400 * 20)], "org_id string, path string, age_seconds long"),
        incidents=table([(1, "o1", day(1), "A.B", "A.B: boom 3", "Class.Foo.bar: line 9, column 1", None)],
                        "incident_id long, org_id string, filed_at date, exc_type string, message string, frame_line string, suspect_field string"),
        resolutions=table([(1, day(2), "restart")], "incident_id long, resolved_at date, resolution string"),
        log_links=table([(7, "o1", 1, day(1))], "log_id long, org_id string, incident_id long, filed_at date"),
    )


def test_filing_in_one_call(spark):
    lines = spark.createDataFrame(
        [(7, i, x) for i, x in enumerate(LOG)] + [(8, i, x) for i, x in enumerate(QUIET)], "log_id long, line_no long, raw string"
    )
    filings = spark.createDataFrame(
        [(10, "o1", day(3), 7, "F__c"), (11, "o2", day(3), 7, None), (12, "o1", day(4), 7, None), (13, "o1", day(5), 8, "Other__c"), (14, "o1", day(5), None, None)],
        "incident_id long, org_id string, filed_at date, log_id long, suspect_field string",
    )
    out = api.file_incidents(installation(spark), filings, lines)
    reports = {r.incident_id: r for r in out["reports"].collect()}
    assert sorted(reports) == [10, 11, 12, 13, 14]
    # the same failure as the one filed before, whatever the number in its message and the line
    assert [(reports[i].recurrence, reports[i].prior_occurrences, reports[i].prior_incident) for i in (10, 11, 12)] == [(True, 1, 1), (False, 0, None), (True, 2, 10)]
    assert reports[12].prior_resolution == "restart" and reports[10].signature == reports[11].signature
    assert reports[10].top_exception == "A.B" and reports[10].log_filed_before == 1 and reports[11].log_filed_before == 0
    assert reports[10].field_warning is None and reports[13].field_warning == "no automation writes it"
    assert reports[13].signature_source == "field_report" and reports[14].signature is None and not reports[14].recurrence

    packs = {}
    for r in out["components"].collect():
        packs.setdefault(r.incident_id, {})[r.component_id] = (r.is_named, r.writes_field, r.recently_changed)
    assert packs == {
        10: {"Alpha": (True, False, True), "Beta": (False, False, False), "Gamma": (False, False, False), "Delta": (False, True, False)},
        12: {"Alpha": (True, False, True), "Beta": (False, False, False), "Gamma": (False, False, False)},
    }
    objects = {(r.incident_id, r.object): r.touches for r in out["objects"].collect()}
    assert objects == {(10, "Order__c"): 1, (12, "Order__c"): 1, (11, "Order__c"): 0}
    scores = {(r.incident_id, r.component_id): r.score for r in out["suspects"].collect()}
    assert scores[(10, "Alpha")] == 50 + 39 and scores[(10, "Delta")] == 35 + 12 + 8 and scores[(12, "Gamma")] == 15


def test_packs_are_made_only_where_they_are_asked_for(spark):
    t = installation(spark)
    t.call_edges = t.call_edges.selectExpr("org_id", "src", "coalesce(raise_error('calls were followed'), dst) AS dst")
    lines = spark.createDataFrame([(7, i, x) for i, x in enumerate(LOG)], "log_id long, line_no long, raw string")
    filings = spark.createDataFrame([(10, "o1", day(3), 7, "F__c")], "incident_id long, org_id string, filed_at date, log_id long, suspect_field string")
    out = api.file_incidents(t, filings, lines)
    assert [r.top_exception for r in out["reports"].collect()] == ["A.B"] and [r.object for r in out["objects"].collect()] == ["Order__c"]
    with pytest.raises(Exception, match="calls were followed"):
        out["components"].collect()


def test_one_pass_equals_a_pass_per_section(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(LOG + QUIET + LOG[::-1])], "log_id long, line_no long, raw string")
    rows = debug_logs.events(lines)
    for wide in (False, True):
        found = debug_logs.sweep(lines, wide)
        for section in (debug_logs.execution_units, debug_logs.query_events, debug_logs.dml_events, debug_logs.thrown):
            assert sorted(map(str, section(found, wide).collect())) == sorted(map(str, section(rows, wide).collect()))
        assert debug_logs.limits(found, wide).count() == 0 and debug_logs.routed(found).count() == debug_logs.routed(rows).count()


def test_items_are_compacted_before_they_are_packed(spark):
    from faultline.operators import packing

    fields = ", ".join(f"Field_{i}__c" for i in range(40))
    log = ["1|CODE_UNIT_STARTED|[EXTERNAL]|Same", "1|CODE_UNIT_FINISHED|Same"] * 5 + [
        f"1|SOQL_EXECUTE_BEGIN|[1]|Aggregations:0|SELECT {fields} FROM Order__c", "1|SOQL_EXECUTE_END|[1]|Rows:3",
        "1|EXCEPTION_THROWN|[3]|System.SObjectException: SObject row was retrieved via SOQL without querying the requested field: Order__c.Lost__c",
    ]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(log)], "log_id long, line_no long, raw string")
    items = {}
    for r in packing.log_items(debug_logs.sweep(lines)).collect():
        items.setdefault(r.section, []).append(r)
    assert sorted(items) == ["exceptions", "execution_units", "soql_summary"]
    assert [r.size for r in items["execution_units"]] == [len('{"label":"Same","depth":0,"had_exception":false,"repeat":5}')]
    short = "SELECT <40 fields; DOES NOT include Lost__c> FROM Order__c"
    assert [r.size for r in items["soql_summary"]] == [len(f'{{"signature":"{short}","object":"Order__c","occurrences":1,"total_rows":3}}')]
    packed = {r.section: (r.total, r.shown) for r in api.pack_normalized_logs(lines, 5000).collect()}
    assert packed == {"exceptions": (1, 1), "execution_units": (1, 1), "soql_summary": (1, 1)}


def test_equal_requests_have_one_pack(spark):
    lines = spark.createDataFrame([(n, i, x) for n in (7, 8, 9) for i, x in enumerate(LOG)], "log_id long, line_no long, raw string")
    filings = spark.createDataFrame(
        [(1, "o1", day(3), 7, "F__c"), (2, "o1", day(3), 8, "F__c"), (None, "o1", day(4), 9, "F__c"), (3, "o1", day(4), 9, None), (3, "o1", day(4), 9, None),
         (4, "o1", day(4), None, "F__c"), (5, None, day(4), 7, "F__c"), (6, "o1", day(4), None, None)],
        "incident_id long, org_id string, filed_at date, log_id long, suspect_field string",
    )
    t = installation(spark)
    out = api.file_incidents(t, filings, lines)
    packs = {}
    for r in out["components"].collect():
        packs.setdefault((r.incident_id, r.org_id), []).append((r.component_id, r.is_named, r.writes_field))
    named = [("Alpha", True, False), ("Beta", False, False), ("Gamma", False, False)]
    want = {(n, "o1"): [*named[:2], ("Delta", False, True), named[2]] for n in (1, 2, None)} | {(3, "o1"): named, (4, "o1"): [("Delta", False, True)]}
    assert {k: sorted(v) for k, v in packs.items()} == want
    suspects = [(r.incident_id, r.component_id) for r in out["suspects"].collect()]
    assert sorted(suspects, key=str) == sorted(((k[0], c[0]) for k, v in want.items() for c in v), key=str)
    # asked for alike by three filings, made once
    tokens = spark.createDataFrame([(n, "Alpha") for n in (7, 8, 9)], "log_id long, component_id string")
    requests = filing.pack_requests(filings, filing.named_components(filings, tokens, t.cards))
    assert filing.asked_packs(requests, "component", "component_id").filter("org_id = 'o1'").count() == 2
    assert filing.asked_packs(requests, "field", "suspect_field").filter("org_id = 'o1'").count() == 2


def test_packs_follow_only_edges_and_writes_that_are_asked_for(spark):
    t = installation(spark)
    named, fields = spark.createDataFrame([("p", "o1", "Alpha")], "pack_id string, org_id string, component_id string"), spark.createDataFrame([("p", "o1", "F__c")], "pack_id string, org_id string, suspect_field string")
    touch = t.field_writes.select("org_id", "field", "component")
    packed = filing.pack_components(fields, named, t.call_edges, t.cards, touch, key=filing.PACK)
    assert sorted((r.component_id, r.is_named, r.writes_field) for r in packed.collect()) == [
        ("Alpha", True, False), ("Beta", False, False), ("Delta", False, True), ("Gamma", False, False)]
    # edges meet the named components in both directions before they are made distinct; the third is the one with the cards
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 3
    lines = spark.createDataFrame([(7, i, x) for i, x in enumerate(LOG)], "log_id long, line_no long, raw string")
    filings = spark.createDataFrame([(10, "o1", day(3), 7, "F__c")], "incident_id long, org_id string, filed_at date, log_id long, suspect_field string")
    # writes meet the asked fields, too
    assert api.file_incidents(t, filings, lines)["components"]._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 4
