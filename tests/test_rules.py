"""Single rules on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from faultline import api
from faultline.functions import columns as c
from faultline.operators import access, activity, event_intake, flows, source_code, summary, token_usage
from faultline.operators.access import Identity
from faultline.streaming import intake


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("v")).first().v


def test_text_rules(spark):
    assert one(spark, c.mask_literals(F.col("t")), t="Id = 'a' and n = 12 or x = :b1 or v2") == "Id = ? and n = ? or x = ? or v2"
    assert one(spark, c.truncate(F.col("t"), 10), t="a  b\n" + "c" * 20) == "a b ccc..."
    assert one(spark, c.slug(F.col("t")), t="../Quote NPÉ #1") == "Quote_NPÉ__1"
    assert one(spark, c.slug(F.col("t"), "incident"), t="...") == "incident"
    assert one(spark, c.account_key(F.col("t")), t="  Big   CO ") == "big co"
    assert one(spark, c.account_problem(F.col("t")), t="x" * 81) == "too long"
    assert one(spark, c.whole(F.col("t")), t="12.7") == 12 and one(spark, c.whole(F.col("t")), t="x") == 0
    assert one(spark, c.header_levels(F.col("t")), t="59.0 APEX_CODE,FINE; SYSTEM,DEBUG;broken") == {"APEX_CODE": "FINE", "SYSTEM": "DEBUG"}
    assert one(spark, c.version_parts(F.col("t")), t="3.10.0") == [3, 10, 0] and one(spark, c.version_parts(F.col("t")), t="x") == [0]
    assert one(spark, c.without_empty_lines(F.col("t")), t="Cause:- None\nreal: text\n\n\n\nFix:-\nend") == "real: text\n\n\nend".replace("\n\n\n", "\n\n")
    for url, want in {"https://acme--uat.sandbox.my.salesforce.com": ("acme", "sandbox"), "cs4.salesforce.com": (None, "sandbox"), "": (None, "unknown"),
                      "https://acme.my.salesforce.com:443/a": ("acme", "production")}.items():
        assert (one(spark, c.my_domain(F.col("t")), t=url), one(spark, c.environment(F.col("t")), t=url)) == want


def test_value_nodes(spark):
    cases = {
        '{"stringValue":"","numberValue":null}': ("literal", "null", True), '{"booleanValue":false,"stringValue":null}': ("literal", "boolean", False),
        '{"elementReference":"$User.Id"}': ("global", "unknown", False), '{"elementReference":"$Record.X"}': ("reference", "unknown", False),
        '{"formulaExpression":"1+1","formulaDataType":"Number"}': ("formula", "number", False), '{"odd":1}': ("unparsed", "unknown", False),
        '{"odd":null}': ("literal", "null", True), "true": ("literal", "boolean", False), "12": ("literal", "number", False),
    }
    for text, want in cases.items():
        v = one(spark, flows.value_node(F.col("t"), flows.members(F.col("t"))), t=text)
        assert (v.kind, v.type, v.is_blank_assignment) == want, text


def test_deltas(spark):
    rows = spark.createDataFrame([(True, 0.0, 0.0), (True, 5.0, 0.0), (True, 3.0, 2.0), (True, 1.0, 2.0), (False, 1.0, 2.0), (True, 1001.0, 1000.0)], "h boolean, c double, p double")
    got = rows.select(summary.change_text(F.col("h"), F.col("c"), F.col("p"), summary.change_pct(F.col("c"), F.col("p"))).alias("v")).collect()
    assert [r.v for r in got] == ["no change", "new", "up 50%", "down 50%", "no prior data", "no change"]


def test_limits_and_quota(spark):
    users = spark.createDataFrame(
        [("a", "admin", None, None, False, None, False, None), ("s", "user", "self", None, False, None, False, None), ("o", "user", "self", True, True, "10", False, None), ("b", "user", "x", None, True, "bad", True, None)],
        "username string, role string, created_by string, verified boolean, has_daily_override boolean, daily_override string, has_monthly_override boolean, monthly_override string",
    )
    got = {r.username: (r.tier, r.source, r.daily_limit, r.window_limit) for r in token_usage.effective_limits(users).collect()}
    assert got == {"a": ("admin", "admin", None, None), "s": ("unverified", "unverified", 200_000, 2_000_000), "o": ("verified", "override", 10, 10_000_000), "b": ("verified", "override", None, None)}


def test_visibility(spark):
    reg = spark.createDataFrame([("p", "public", None), ("mine", None, "me"), ("other", "private", "you"), ("odd", "weird", "me"), ("none", None, None)], "org_id string, visibility string, owner string")
    reg = reg.withColumn("name", F.col("org_id")).withColumn("account", F.lit(None).cast("string")).withColumn("instance_url", F.lit(""))
    seen = {r.org_id: (r.visibility, r.can_manage) for r in access.visible_orgs(reg, Identity("me")).collect()}
    assert seen == {"p": ("public", False), "mine": ("private", True), "odd": ("private", True)}
    assert access.visible_orgs(reg, Identity("x", "admin")).count() == 5


def test_source_loops_and_guards(spark):
    code = """trigger? no
public class A {
  void a() {
    for (Integer i = 0; i < 3; i++) {
      while (x) { B.go(); }
      insert one;
    }
    B.stop(); // B.hidden();
    if (y) { this.a(); } else { b.lower(); }
  }
}"""
    prep = source_code.prepared(spark.createDataFrame([("o", "A", code)], "org_id string, component_id string, code string"))
    stmts = source_code.statements(prep)
    names = spark.createDataFrame([("o", "A"), ("o", "B")], "org_id string, name string")
    got = [(r.target, r.method_called, r.line, r.in_loop, r.conditions) for r in source_code.call_sites(stmts, names).orderBy("position").collect()]
    assert got == [("B", "go", 5, True, "for (Integer i = 0; i < 3; i++) > while (x)"), ("B", "stop", 8, False, ""), ("A", "a", 9, False, "if (y)")]
    bare = """class A { void a() {
      if (B.ask(f(1))) B.yes();
      else if (c) B.maybe(); else B.no();
      for (X x : xs) B.each(x);
      if (d) { B.one(); } else B.two();
      B.free();
    } }"""
    prep2 = source_code.prepared(spark.createDataFrame([("o", "A", bare)], "org_id string, component_id string, code string"))
    told = {r.method_called: r.conditions for r in source_code.call_sites(source_code.statements(prep2), names).collect()}
    assert told == {
        "ask": "", "yes": "if (B.ask(f(1)))", "maybe": "else if (c) [and not: B.ask(f(1))]", "no": "else [not: B.ask(f(1)) / c]",
        "each": "for (X x : xs)", "one": "if (d)", "two": "else [not: d]", "free": "",
    }
    assert [(r.op, r.receiver, r.line, r.in_loop) for r in source_code.dml(stmts).collect()] == [("insert", "one", 6, True)]
    m = source_code.methods(prep, stmts).first()
    assert (m["name"], m.loc, m.complexity) == ("a", 7, 4)


def test_call_arguments(spark):
    got = one(spark, source_code.call_arguments(F.col("t")), t="(new X(a, 'b,)c'), [1,2], f(g(h)), 4) + other(9)")
    assert got == ["new X(a, 'b,)c')", "[1,2]", "f(g(h))", "4"]


def test_flow_cycle(spark):
    doc = '{"start":{"connector":{"targetReference":"A"}},"assignments":[{"name":"A","connector":{"targetReference":"B"}},{"name":"B","connector":{"targetReference":"A"}},{"name":"C"}]}'
    g = flows.graphs(flows.parsed(spark.createDataFrame([("o", "f", doc)], "org_id string, flow_id string, metadata string"))).first()
    assert (g.has_cycles, g.unreachable, g.max_depth, g.topological_order) == (True, "C", None, "")


def test_first_seen_tie(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("u", "b", t, 1), ("u", "a", t, 2), ("u", "a", t, 4), ("u", "b", t, 3)], "username string, shown_action string, at_ts timestamp, event_id int")
    assert activity.top_action(rows, ["username"]).first().top_action == "b"


def write_batches(spark, rows, schema, folder):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cap_over_batches(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1, 10)
    def rows(k):
        return [(1, 10 * k + i, base + datetime.timedelta(minutes=10 * k + i), "ui.view") for i in range(5)] + [(1, 10 * k + 9, base, "ui.gone")]
    stream = write_batches(spark, [rows(0), rows(1), rows(2)], "user_id bigint, event_id bigint, arrived_at timestamp_ntz, action string", str(tmp_path / "in"))
    got = intake.hourly_cap(stream, str(tmp_path / "run"), cap=7)
    assert got.count() == 7


def test_bursts_over_batches(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    times = [0, 1, 2, 50, 61, 62, 130, 131, 132, 133]
    events = [("k", base + datetime.timedelta(seconds=s)) for s in times]
    df = spark.createDataFrame(events, "key string, ts timestamp_ntz")
    want = {(0, 4, 2), (61, 2, 2), (130, 4, 2)}
    zero = int((base - datetime.datetime(1970, 1, 1)).total_seconds())
    got = {(r.window_start - zero, r.events, r.allowed) for r in event_intake.bursts(df, "key", "ts", 2, 60).collect()}
    assert got == want
    stream = write_batches(spark, [events[:5], events[5:]], "key string, ts timestamp_ntz", str(tmp_path / "in"))
    told = intake.burst_windows(stream, "key", "ts", 2, 60, str(tmp_path / "run"))
    # files may be read in either order; with the first batch first the windows are the batch job's
    assert {(r.window_start - zero, r.events, r.allowed) for r in told.collect()} >= {(130, 4, 2)}


def test_api(spark):
    from faultline.plans import registry
    from faultline.sources.views import view

    registry.load()
    root = "/root/testdata/sf0.001"
    v = lambda n: view(spark, root, n)
    from faultline.operators.component_graph import with_ownership

    t = api.Tables(
        registry=v("registry"), cards=with_ownership(v("cards"), "Own"), call_edges=v("call_edges"), call_sites=v("call_sites"), ui_imports=v("ui_imports"),
        flow_actions=v("flow_action_rows"), subflows=v("subflow_calls"), entry_points=v("entry_point_rows"), field_writes=v("field_writes"),
        manifest=v("component_manifest"), incidents=v("incidents"), resolutions=v("resolutions"), log_library=v("log_library"), log_links=v("log_links"),
    )
    me = Identity("user_7")
    assert api.component(t, "org_0", "part_10").first().component_id == "Part_10"
    assert {r.lower_target for r in api.inbound_references(t, "org_0", "PART_10").selectExpr("lower(target) AS lower_target").collect()} == {"part_10"}
    assert api.field_writers(t, "org_0", "Field_7__c").count() > 0
    assert api.search(t, "org_0", "part").count() > 0
    assert api.list_orgs(t, me, "prod").count() > 0 and api.list_accounts(t, me).count() > 0
    assert api.org_stats(t, "org_0").count() == 14
    assert api.find_known_issue(t, Identity("a", "admin"), "System.Err3Exception: bad value 17 in 'x' for :acct on Obj1__c").first().score >= 90
    assert api.list_logs(t, me, status="all").count() > 0
    sections = api.normalize_logs(v("log_lines"), v("log_components"))
    assert sections["execution_units"].count() > 0 and api.log_section(sections["execution_units"], "line_no", 0, 2).count() > 0


def test_every_query_is_checked():
    import __spark_entry__ as entry
    from faultline.plans import registry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries)
    assert set(registry.QUERIES) == set(registry.ORACLES)
