"""Log rules on logs written by hand, and properties of every log."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import async_jobs, debug_logs

NESTED = [
    "1|CODE_UNIT_STARTED|[EXTERNAL]|Outer",
    "1|SOQL_EXECUTE_BEGIN|[1]|Aggregations:0|SELECT Id FROM Order__c WHERE A = 'x' AND B = 12",
    "1|SOQL_EXECUTE_END|[1]|Rows:3",
    "1|CODE_UNIT_STARTED|[EXTERNAL]|Inner",
    "1|DML_BEGIN|[2]|Op:Update|Type:Order__c|Rows:2",
    "1|DML_END|[2]",
    "1|EXCEPTION_THROWN|[3]|A.B: boom",
    "1|CODE_UNIT_FINISHED|Inner",
    "1|CODE_UNIT_STARTED|[EXTERNAL]|Later",
    "1|CODE_UNIT_FINISHED|Later",
    "1|FATAL_ERROR|X.Y: dead",
    "Class.Foo.bar: line 7, column 1",
    "Trigger.T: line 2, column 1",
    "1|CODE_UNIT_FINISHED|Outer",
]
TORN = [  # ends without begins, and a detail that says nothing
    "1|SOQL_EXECUTE_END|[1]|Rows:1",
    "1|DML_BEGIN|[2]|odd",
    "1|DML_END|[2]",
    "1|CODE_UNIT_FINISHED|Nobody",
    "1|FATAL_ERROR|X.Y: dead",
    "Class.Foo.bar: line 1, column 1",
    "no bars at all",
]
LIMITS = [
    "1|LIMIT_USAGE_FOR_NS|(default)|",
    "  Number of SOQL queries: 5 out of 100",
    "1|LIMIT_USAGE_FOR_NS|Pkg|",
    "  Maximum CPU time: 9 out of 10000 ******* CLOSE TO LIMIT",
    "1|LIMIT_USAGE_FOR_NS|(default)|",
    "  Number of SOQL queries: 3 out of 100",
]
JOBS = [
    "1|CODE_UNIT_STARTED|[EXTERNAL]|Start",
    "1|METHOD_ENTRY|[1]|01p|Mailer.run(Integer)",
    "1|CONSTRUCTOR_ENTRY|[5]|01p|SendQueueable",
    "1|SYSTEM_METHOD_ENTRY|[9]|System.enqueueJob(Object)",
    "1|EXCEPTION_THROWN|[9]|System.LimitException: Too many queueable jobs added to the queue: 2",
    "1|METHOD_EXIT|[1]|Mailer.run(Integer)",
    "1|SYSTEM_METHOD_ENTRY|[70]|System.enqueueJob(Object)",
    "1|CODE_UNIT_FINISHED|Start",
]
SAMPLES = NESTED + TORN + LIMITS + JOBS


def parse(spark, logs, wide, chunk=16, seed=3, one_pass=False):
    """All readings of some logs; the chunk is smaller than a log, and rows come in no particular order."""
    import faultline.functions.scan as scan_module

    data = [(k, i, raw) for k, v in logs.items() for i, raw in enumerate(v, 1)]
    random.Random(seed).shuffle(data)
    before = scan_module.scan.__kwdefaults__["chunk"]
    scan_module.scan.__kwdefaults__["chunk"] = chunk
    lines = spark.createDataFrame(data, "log_id bigint, line_no bigint, raw string").repartition(5)
    rows = debug_logs.sweep(lines, wide) if one_pass else debug_logs.events(lines)
    found = async_jobs.evidence(rows, wide)
    tables = {
        "units": debug_logs.execution_units(rows, wide), "soql": debug_logs.query_events(rows, wide), "dml": debug_logs.dml_events(rows, wide),
        "exceptions": debug_logs.thrown(rows, wide), "limits": debug_logs.limits(rows if one_pass else lines, wide), "sent": async_jobs.shown_dispatches(found, wide),
        "failed": async_jobs.failures(found), "made": async_jobs.job_constructions(found),
    }
    out = {name: table.collect() for name, table in tables.items()}
    scan_module.scan.__kwdefaults__["chunk"] = before
    return out


def of(rows, log, *columns):
    found = sorted((r for r in rows if r.log_id == log), key=lambda r: r.asDict().get("line_no") or 0)
    return [tuple(r[c] for c in columns) for r in found]


@pytest.fixture(scope="module", params=["plain", "wide", "one pass"])
def parsed(request, spark):
    return parse(spark, {1: NESTED, 2: TORN, 3: LIMITS, 4: JOBS}, request.param != "plain", chunk=3, one_pass=request.param == "one pass")


def test_units(parsed):
    assert of(parsed["units"], 1, "label", "depth", "had_exception") == [("Outer", 0, True), ("Inner", 1, True), ("Later", 1, False)]
    assert of(parsed["units"], 2, "label") == []


def test_queries_and_dml(parsed):
    assert of(parsed["soql"], 1, "signature", "rows") == [("SELECT Id FROM Order__c WHERE A = ? AND B = ?", 3)]
    assert of(parsed["soql"], 2, "signature", "rows") == [("", 1)]
    assert of(parsed["dml"], 1, "operation", "object") == [("Update", "Order__c")]
    assert of(parsed["dml"], 2, "operation", "object") == [("Unknown", None)]


def test_exceptions(parsed):
    assert of(parsed["exceptions"], 1, "message", "stack") == [("A.B: boom", "Class.Foo.bar: line 7, column 1\nTrigger.T: line 2, column 1")]
    assert of(parsed["exceptions"], 2, "message") == [("X.Y: dead",)]


def test_limits(parsed):
    got = {r[:1] + r[1:] for r in of(parsed["limits"], 3, "namespace", "name", "used", "peak_used", "is_final")}
    assert got == {("(default)", "SOQL queries", 3, 5, True), ("Pkg", "CPU time", 9, None, False)}


def test_async(parsed):
    assert of(parsed["sent"], 4, "line", "caller", "job_class_guess", "failed") == [(9, "Mailer.run", "SendQueueable", True), (70, "Start", None, False)]
    assert of(parsed["failed"], 4, "line", "caller", "job_class_guess") == [(9, "Mailer.run", "SendQueueable")]
    assert of(parsed["made"], 4, "class", "line", "caller", "count") == [("SendQueueable", 5, "Mailer.run", 1)]


def test_no_log_is_cut_short(spark):
    many = ["1|CODE_UNIT_STARTED|[EXTERNAL]|Start"]
    for i in range(130):
        many += [f"1|CONSTRUCTOR_ENTRY|[{i}]|01p|Job{i}Queueable", f"1|SYSTEM_METHOD_ENTRY|[{i}]|System.enqueueJob(Object)"]
    got = parse(spark, {1: many}, True)
    assert len(got["sent"]) == 130 and len(got["made"]) == 130


def test_readings_do_not_depend_on_scan_order_or_other_logs(spark):
    rnd = random.Random(7)
    logs = {k: [rnd.choice(SAMPLES) for _ in range(70)] for k in range(4)}
    table = lambda got, log: {name: sorted(str(r) for r in rows if r.log_id == log) for name, rows in got.items()}
    plain, wide, other_order = (parse(spark, logs, w, seed=s) for w, s in ((False, 3), (True, 3), (True, 4)))
    for log in logs:
        assert table(plain, log) == table(wide, log) == table(other_order, log)
    alone = parse(spark, {2: logs[2]}, True)
    assert table(alone, 2) == table(wide, 2)


def test_runs_and_pages(spark):
    units = spark.createDataFrame(
        [(1, i, lab, 0, False) for i, lab in enumerate("aabba", 1)], "log_id int, line_no bigint, label string, depth int, had_exception boolean"
    )
    for wide in (False, True):
        got = debug_logs.unit_runs(units, wide).orderBy("line_no").collect()
        assert [(r.label, r.repeat) for r in got] == [("a", 2), ("b", 2), ("a", 1)]
    page = debug_logs.section_page(units, "line_no", 1, 2).orderBy("position").collect()
    assert [(r.position, r.label, r.total, r.next_offset) for r in page] == [(1, "a", 5, 3), (2, "b", 5, 3)]
    past = debug_logs.section_page(units, "line_no", 9, 2).collect()
    assert [(r.position, r.label, r.total, r.next_offset) for r in past] == [(None, None, 5, None)]


def test_crlf_text(spark):
    texts = spark.createDataFrame([("l", "59.0 APEX_CODE,FINE\r\none\r\n  \r\ntwo\nthree")], "k string, t string")
    got = debug_logs.split_text(texts, "k", "t").orderBy("line_no").collect()
    assert [(r.raw, r.is_header) for r in got] == [("59.0 APEX_CODE,FINE", True), ("one", False), ("two", False), ("three", False)]


def test_prefixes_are_the_callers(spark):
    units = spark.createDataFrame([(1, "acmeOrder and Other")], "log_id int, label string")
    none = spark.createDataFrame([], "log_id int, message string, stack string")
    assert debug_logs.involved_components(units, none).count() == 0
    assert [r.component_id for r in debug_logs.involved_components(units, none, prefixes=("acme",)).collect()] == ["acmeOrder"]


def plain_callers(events):
    """The rule as a loop: one stack per unit, an exit pops to the nearest entry of its name."""
    stacks, out = {}, {}
    for log, unit, line, evt, name in sorted(events, key=lambda e: (e[0], e[2])):
        stack = stacks.setdefault((log, unit), [])
        if evt == "METHOD_ENTRY":
            stack.append(name)
        elif evt == "METHOD_EXIT":
            if name in stack:
                while stack.pop() != name:
                    pass
        else:
            out[log, line] = stack[-1] if stack else None
    return out


@pytest.mark.parametrize("chunk,seed", [(1, 1), (3, 2), (7, 3), (10_000, 4)])
def test_stacks_split_into_chunks(spark, chunk, seed):
    rnd = random.Random(seed)
    kinds = ["METHOD_ENTRY", "METHOD_EXIT", "METHOD_ENTRY", "METHOD_EXIT", "EXCEPTION_THROWN"]
    data = [(log, rnd.choice([0, 0, 0, 7]), line, rnd.choice(kinds), rnd.choice("abcdef")) for log in range(5) for line in range(1, 150)]
    rows = spark.createDataFrame([(log, (unit,), line, evt, f"{name}(Integer)") for log, unit, line, evt, name in data], "log_id bigint, unit struct<line_no:bigint>, line_no bigint, evt string, last_part string")
    got = {(r.k_log, r.k_line): r.method for r in async_jobs.callers(rows.repartition(4), chunk).collect()}
    assert got == plain_callers(data)


def test_a_chunk_effect_is_short_where_calls_are_closed():
    stack = async_jobs.ChunkStack()
    stack.exit("before")
    for i in range(1_000):
        stack.enter("a")
        stack.enter(f"b{i}")
        assert stack.top() == (f"b{i}", None)
        stack.exit("a")
    stack.enter("stays")
    assert stack.effect() == ["-before", "+stays"]
    unmatched = async_jobs.ChunkStack()
    for i in range(50_000):
        unmatched.enter("open")
        unmatched.exit("nobody")
    assert len(unmatched.effect()) == 100_000


def test_one_unit_spread_over_tasks(spark):
    n = 400_000
    rows = spark.range(1, n + 1).select(
        F.lit(1).cast("bigint").alias("log_id"), F.struct(F.lit(0).cast("bigint").alias("line_no")).alias("unit"), F.col("id").alias("line_no"),
        F.when(F.col("id") == 1, "METHOD_ENTRY").when(F.col("id") % 4 == 2, "METHOD_ENTRY").when(F.col("id") % 4 == 3, "METHOD_EXIT").otherwise("EXCEPTION_THROWN").alias("evt"),
        F.when(F.col("id") == 1, "outer()").otherwise("inner()").alias("last_part"),
    )
    found = async_jobs.callers(rows, 4_096)
    assert found.groupBy("method").count().collect() == [("outer", n // 2 - 1)]
