"""Condition logic and graphs of flows on documents written by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import flows


def postfix(spark, cases):
    rows = spark.createDataFrame(cases, "logic string, n int")
    return [r.v for r in rows.select(flows.logic_postfix(F.col("logic"), F.col("n")).alias("v")).collect()]


def test_condition_logic(spark):
    cases = {
        ("1 AND (2 OR 3)", 3): "1 2 3 OR AND", ("1 or 2 and not 3", 3): "1 2 3 NOT AND OR", ("((1))", 1): "1", ("and", 3): "1 2 AND 3 AND", ("OR", 2): "1 2 OR",
        (None, 1): "1", ("(1 AND 12) OR NOT (2 AND (3 OR 4))", 12): "1 12 AND 2 3 4 OR AND NOT OR", ("NOT NOT 1", 1): "1 NOT NOT", ("1 AND (2 OR 3", 3): "1 2 3 OR AND",
    }
    assert postfix(spark, list(cases)) == list(cases.values())


def value_of(text, truth):
    stack = []
    for t in text.split():
        if t == "NOT":
            stack.append(not stack.pop())
        elif t in ("AND", "OR"):
            b, a = stack.pop(), stack.pop()
            stack.append((a and b) if t == "AND" else (a or b))
        else:
            stack.append(truth[int(t)])
    return stack.pop()


def test_condition_logic_means_what_it_says(spark):
    rnd = random.Random(8)

    def made(depth):
        if depth == 0 or rnd.random() < 0.2:
            return str(rnd.randint(1, 6))
        kind = rnd.random()
        if kind < 0.2:
            return f"NOT {made(0)}" if rnd.random() < 0.5 else f"NOT ({made(depth - 1)})"
        return f"{made(depth - 1)} {rnd.choice(['AND', 'OR'])} {made(depth - 1)}" if kind < 0.6 else f"({made(depth - 1)} {rnd.choice(['AND', 'OR'])} {made(depth - 1)})"

    texts = [made(5) for _ in range(60)]
    for text, got in zip(texts, postfix(spark, [(t, 6) for t in texts]), strict=True):
        for _ in range(8):
            truth = {i: rnd.random() < 0.5 for i in range(1, 7)}
            words = " ".join(str(truth[int(w)]) if w.isdigit() else w.lower() for w in text.replace("(", " ( ").replace(")", " ) ").split())
            assert value_of(got, truth) == eval(words), text


def graph(spark, elements, start="e0"):
    doc = {"start": {"connector": {"targetReference": start}}, "assignments": [
        {"name": name, "connector": {"targetReference": to[0]} if to else None, "faultConnector": {"targetReference": to[1]} if len(to) > 1 else None} for name, to in elements
    ]}
    rows = spark.createDataFrame([("o", "f", json.dumps(doc))], "org_id string, flow_id string, metadata string")
    return flows.graphs(flows.parsed(rows)).first()


@pytest.mark.parametrize("seed", range(6))
def test_graph_measures(spark, seed):
    rnd = random.Random(seed)
    n = 12
    ways = {f"e{i}": [f"e{rnd.randint(i + 1 if seed % 2 else 0, n + 1)}" for _ in range(rnd.randint(0, 2))] for i in range(n)}
    got = graph(spark, list(ways.items()))
    known = {a: [b for b in to if b in ways] for a, to in ways.items()}
    seen, queue = {"e0"}, ["e0"]
    while queue:
        for b in known[queue.pop()]:
            if b not in seen:
                seen.add(b)
                queue.append(b)
    assert got.unreachable == ",".join(sorted(set(ways) - seen))
    depth, left = {}, set(ways)
    while free := {x for x in left if not any(x in known[a] for a in left)}:
        for x in free:
            depth[x] = max([depth[a] + 1 for a in ways if x in known[a]], default=0)
        left -= free
    assert got.has_cycles == bool(left)
    if not left:
        assert got.max_depth == max(depth.values())
        assert got.topological_order == ",".join(x for _, x in sorted((d, x) for x, d in depth.items()))


def test_a_large_flow(spark):
    n = 2_000
    got = graph(spark, [(f"e{i}", [f"e{i + 1}", f"e{min(i + 7, n - 1)}"]) for i in range(n - 1)] + [(f"e{n - 1}", [])])
    assert (got.max_depth, got.unreachable, got.has_cycles, got.elements) == (n - 1, "", False, n)


def test_entry_points_leave_graphs_alone(spark):
    flow = {"processType": "AutoLaunchedFlow", "start": {"object": "Order__c", "triggerType": "RecordAfterSave", "connector": {"targetReference": "U"}}, "recordUpdates": [{"name": "U", "inputReference": "$Record"}]}
    rows = spark.createDataFrame([("o", "F", json.dumps(flow), "Active", 1, None)], "org_id string, flow_id string, metadata string, status string, version_number int, namespace string")
    none = spark.createDataFrame([], "org_id string, object string, component_id string")
    points = flows.entry_points(flows.parsed(rows), none, none)
    assert sorted(r.bucket for r in points.collect()) == ["after_save_flows", "self_referential_automation"]
    assert "without_fault_path" not in points._jdf.queryExecution().optimizedPlan().toString()
    assert {r.flag for r in flows.flags(flows.parsed(rows)).collect()} == {"self_referential_update", "no_fault_path"}
