"""Extraction on small classes written by hand: initialisers, literals, nesting, and no cuts."""

import pytest

from faultline.operators import source_code as sc


def read(spark, code, names=("A", "B", "SessionManagement")):
    sources = spark.createDataFrame([("o", "A", code)], "org_id string, component_id string, code string")
    prep = sc.prepared(sources)
    known = spark.createDataFrame([("o", n) for n in names], "org_id string, name string")
    return prep, sc.statements(prep), known


def body(*lines):
    return "public class A {\n  public void run() {\n" + "\n".join(lines) + "\n  }\n  Integer prefetch(Integer n) { return n; }\n  Integer fetch(Integer n) { return n; }\n}"


def calls(spark, *lines):
    _, stmts, known = read(spark, body(*lines))
    rows = sc.call_sites(stmts, known).collect()
    return [(r.callee, r.line, r.conditions) for r in sorted(rows, key=lambda r: r.position) if r.method == "run"]


def test_calls_stand_where_they_are(spark):
    assert calls(spark, "prefetch(fetch(1));") == [("A.prefetch", 3, ""), ("A.fetch", 3, "")]
    assert calls(spark, "x = B.go(1) +", "B.go(2);") == [("B.go", 3, ""), ("B.go", 4, "")]
    assert calls(spark, "B.say('; } {');", "B.go();") == [("B.say", 3, ""), ("B.go", 4, "")]


def test_conditions_of_any_depth(spark):
    got = calls(spark, "if (a && (b || (c && (d || (e && f))))) B.deep();", "if (x) { if (y == ')') { B.inner(); } else { B.other(); } }")
    assert got == [
        ("B.deep", 3, "if (a && (b || (c && (d || (e && f)))))"),
        ("B.inner", 4, "if (x) > if (y == ')')"),
        ("B.other", 4, "if (x) > else [not: y == ')']"),
    ]
    long = " && ".join(f"flag{i}" for i in range(60))
    assert calls(spark, f"if ({long}) {{ B.go(); }}")[0][2] == f"if ({long})"


def test_conditions_around_a_call_are_those_of_its_blocks(spark):
    depth = 37
    deep = " ".join(f"if (c{i}) {{ B.at{i}();" for i in range(depth)) + " }" * depth + " B.after();"
    got = calls(spark, deep)
    assert [g[2] for g in got] == [" > ".join(f"if (c{j})" for j in range(i + 1)) for i in range(depth)] + [""]
    got = calls(spark, "for (Integer i = 0; i < n; i++) { if (i > 1) { B.a(); } else B.b(); B.c(); }", "for (Integer k = 0; k < n; k++) B.d();", "B.e();", "try { B.f(); } catch (E e) { B.g(); }")
    loop = "for (Integer i = 0; i < n; i++)"
    assert [(g[0], g[2]) for g in got] == [
        ("B.a", f"{loop} > if (i > 1)"), ("B.b", f"{loop} > else [not: i > 1]"), ("B.c", loop), ("B.d", "for (Integer k = 0; k < n; k++)"), ("B.e", ""), ("B.f", "try"), ("B.g", "catch (E e)"),
    ]


def test_no_range_join_in_the_plan(spark):
    _, stmts, known = read(spark, body("if (a) { B.go(); }"))
    plan = sc.call_sites(stmts, known)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any(mark in line for line in joins for mark in ("<", ">"))


def test_a_class_of_very_many_calls(spark):
    lines = [f"if (c{i}) {{ B.go(); B.go(); }}" if i % 50 == 0 else "B.go(); B.go();" for i in range(50_000)]
    _, stmts, known = read(spark, body(*lines))
    rows = sc.call_sites(stmts, known)
    assert rows.count() == 100_000 and rows.filter("conditions <> ''").count() == 2_000


def test_comment_marks_in_literals(spark):
    got = calls(spark, "String u = 'https://x.example'; B.go(); // B.no();", "String v = '/* '; B.a(); /* B.no(); */ B.b('*/');", "B.c(); // don't")
    assert [g[0] for g in got] == ["B.go", "B.a", "B.b", "B.c"]


def test_facts_of_a_class_reach_its_handlers_writes_and_jobs(spark):
    code = body(
        "try { B.a(); } catch (X e) { try { throw e; } catch (Y f) { } }", "rec.A__c = cache.get(k);", "other.B__c = 1;", "save(other);", "Queueable q = new B();", "System.enqueueJob(q);",
    ).replace("public class A {", "public class A {\n  static Map<String, Id> cache = new Map<String, Id>();\n  static Map<String, Id> cache = null;")
    prep, stmts, known = read(spark, code)
    assert {(r.type, r.effect, r.rethrows) for r in sc.catch_handlers(prep, stmts).collect()} == {("X", "rethrow", True), ("Y", "empty", False)}
    assert [(r.name, r.reset_elsewhere) for r in sc.static_state(prep).collect()] == [("cache", False)]
    writes = {r.field: (r.risk, r.passed_to, r.reason) for r in sc.field_writes(prep, stmts).collect()}
    assert writes["B__c"] == ("low", "save", None) and writes["A__c"][0] == "high" and "never reset" in writes["A__c"][2]
    assert [(r.target, r.resolution) for r in sc.async_dispatches(prep, stmts, known).collect()] == [("B", "variable_assignment")]


def test_every_call_is_told(spark):
    got = calls(spark, *[f"B.go({i});" for i in range(450)])
    assert len(got) == 450 and got[-1] == ("B.go", 452, "")


def test_platform_namespaces_are_no_classes(spark):
    prep, stmts, known = read(spark, body("Auth.SessionManagement.validate(1);"))
    assert sc.call_sites(stmts, known).filter("method = 'run'").count() == 0
    edges = sc.calls_to(stmts, known, sc.async_dispatches(prep, stmts, known)).collect()
    assert [(r.target, r.kind, r.namespace) for r in edges] == [("SessionManagement", "local_class", None)]


@pytest.mark.parametrize("condition", ["Name = 'x;y'", "Name = 'a]b'", "Id IN :new Set<Id>{i, j}"])
def test_queries_with_literals_and_initialisers(spark, condition):
    _, stmts, _ = read(spark, body(f"List<Account> l = [SELECT Id FROM Account WHERE {condition} LIMIT 5];"))
    got = sc.queries(stmts).collect()
    assert [(r.object, r.where_text, r.limit_rows, r.method) for r in got] == [("Account", condition, 5, "run")]


def test_writes_of_initialised_values(spark):
    prep, stmts, _ = read(spark, body("rec.Tags__c = String.join(new List<String>{'a','b'}, ',');", "rec.Note__c = 'x;y';", "update rec;"))
    got = {r.field: (r.value, r.persistence, r.line) for r in sc.field_writes(prep, stmts).collect()}
    assert got == {"Tags__c": ("String.join(new List<String>{'a','b'}, ',')", "persisted", 3), "Note__c": ("'x;y'", "persisted", 4)}


def test_jobs_with_initialised_arguments(spark):
    prep, stmts, known = read(spark, body("Database.executeBatch(new B(new Map<String, List<String>>{'a' => new List<String>{'b'}}), 50);"))
    got = sc.async_dispatches(prep, stmts, known).collect()
    assert [(r.target, r.scope_size, r.resolution) for r in got] == [("B", "50", "constructor")]


def test_loops_of_every_form(spark):
    header = " OR ".join(f"Name = 'n{i}'" for i in range(80))
    _, stmts, _ = read(spark, body(
        f"for (Account a : [SELECT Id FROM Account WHERE {header}]) {{ update a; }}", "for (Integer i = 0; i < 3; i++) { insert b; }",
        "for (Account a : l) delete a;", "if (x) { upsert c; }",
    ))
    assert {r.op: r.in_loop for r in sc.dml(stmts).collect()} == {"update": True, "insert": True, "delete": True, "upsert": False}


def test_reflection_by_dotted_name(spark):
    prep, stmts, known = read(spark, body("Type t = Type.forName('B.Inner');", "Type u = Type.forName('ns', 'Nobody');"))
    edges = sc.calls_to(stmts, known, sc.async_dispatches(prep, stmts, known)).filter("via LIKE '%forName%'").collect()
    assert [(r.target, r.via) for r in edges] == [("B", "Type.forName")]


def test_long_sources_are_read(spark):
    sources = spark.createDataFrame([("o", "A", "public class A {" + " Integer x = 1;" * 100_000 + "}"), ("o", "B", " "), ("o", "C", "class C {")], "org_id string, component_id string, code string")
    assert {(r.component_id, r.reason) for r in sc.extract_errors(sources).collect()} == {("B", "empty source"), ("C", "unbalanced braces")}
