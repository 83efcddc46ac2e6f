"""Work that several branches of a job share is done once."""

import pytest

from faultline.operators import component_graph as g
from faultline.operators import flows as fl
from faultline.operators import source_code as sc
from faultline.plans import registry

ROOT = "/root/testdata/sf0.001"
CODE = """class A {
    void run(List<Id> ids) {
        for (Id i : ids) { update rec; }
        Integer plain = 1;
        rec.Status__c = 'x';
        Database.insert(rows);
        Account a = [SELECT Id FROM Account];
        Database.query(q);
    }
}
"""


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["source_queries", "source_dml", "source_field_writes", "class_flags"])
def test_statements_are_found_once(spark, name):
    registry.load()
    # the windows that find statements ran when the matching ones were written
    assert "Window [" not in plan(registry.QUERIES[name](spark, ROOT))


def test_card_items_are_numbered_once(spark):
    registry.load()
    assert "row_number()" not in plan(registry.QUERIES["card_packing"](spark, ROOT))


@pytest.mark.parametrize("job", [fl.conditions, fl.assignments])
def test_value_nodes_are_read_once(spark, job):
    document = '{"start":{"filters":[{"field":"F","operator":"EqualTo","value":{"elementReference":"$Flow.X"}}]},"assignments":[{"name":"A","assignmentItems":[{"assignToReference":"a.B__c","operator":"Assign","value":{"apexValue":"$Flowers"}}]}]}'
    rows = job(fl.parsed(spark.createDataFrame([("o", "f", document)], "org_id string, flow_id string, metadata string")))
    assert [r["value_kind"] for r in rows.collect()] == ["global"]
    # the document, and the node once
    assert plan(rows).count("from_json(") == 2


def test_marked_statements_give_the_same_rows(spark):
    prep = sc.prepared(spark.createDataFrame([("o", "A", CODE), ("o", "B", "class B {}"), ("o", "C", None)], "org_id string, component_id string, code string"))
    every = sc.statements(prep)

    def same(job, marks):
        a, b = (sorted(map(str, job(s).collect())) for s in (every, sc.holding(every, *marks)))
        assert a and a == b

    same(sc.queries, sc.QUERY_MARKS)
    same(sc.dml, sc.DML_MARKS)
    same(lambda s: sc.field_writes(prep, s), sc.WRITE_MARKS)
    same(lambda s: sc.flags(prep, s), sc.FLAG_MARKS)
    assert sc.holding(every, *sc.QUERY_MARKS).count() == 2


def test_element_jobs_read_no_values(spark):
    registry.load()
    for name in ("flow_elements", "flow_edges", "flow_graphs"):
        assert "StructField(inputAssignments" not in plan(registry.QUERIES[name](spark, ROOT))


def test_element_part_of_the_schema_gives_the_same_rows(spark):
    whole = (
        '{"start":{"object":"O","connector":{"targetReference":"D"},"filters":[{"field":"F","value":{"stringValue":"x"}}],"scheduledPaths":[{"offsetNumber":"no"}]},'
        '"decisions":[{"name":"D","label":"d","rules":[{"name":"R","conditions":7,"connector":{"targetReference":"U"}},{"connector":null},null],"defaultConnector":{"targetReference":"L"}},{"label":"nameless"}],'
        '"recordUpdates":[{"name":"U","inputReference":"$Record","inputAssignments":{"odd":1},"connector":{"targetReference":"A"}}],'
        '"loops":[{"name":"L","nextValueConnector":{"targetReference":"A"},"noMoreValuesConnector":{"targetReference":"Gone"}}],'
        '"assignments":[{"name":"A","assignmentItems":[{"value":{"weird":[1,2]}}],"connector":{"targetReference":"L"}}],'
        '"actionCalls":[{"name":"X","actionName":"Cls","inputParameters":[{"value":{"numberValue":"n"}}]},{"name":"X"}],"screens":[{"name":"S"}],"extra":{"a":[{}]}}'
    )
    line = '{"start":{"connector":{"targetReference":"A"}},"screens":[{"name":"A","connector":{"targetReference":"B"}},{"name":"B","connector":{"targetReference":"C"}},{"name":"C"}]}'
    texts = [whole, line, None, "", "{}", "[]", "not json", whole[:-3], '{"decisions":"text","screens":[{"name":"S"}]}', '{"recordUpdates":[5,{"name":"U"}]}', '{"start":null,"waits":[]}']
    documents = spark.createDataFrame([("o", str(i), t) for i, t in enumerate(texts)], "org_id string, flow_id string, metadata string")
    for job in (fl.elements, fl.edges, fl.graphs):
        a, b = (sorted(map(str, job(fl.parsed(documents, s)).collect())) for s in (fl.SCHEMA, fl.ELEMENT_SCHEMA))
        assert a and a == b
    rows = {r.flow_id: r for r in fl.graphs(fl.parsed(documents, fl.ELEMENT_SCHEMA)).collect()}
    assert (rows["0"].has_cycles, rows["0"].unreachable, rows["0"].without_fault_path, rows["0"].topological_order) == (True, "S,X", "U,X,X", "")
    assert (rows["1"].has_cycles, rows["1"].max_depth, rows["1"].topological_order, rows["1"].unreachable) == (False, 2, "A,B,C", "")


def test_edges_of_the_context_are_made_distinct_once(spark):
    registry.load()
    made = plan(registry.QUERIES["context_expansion"](spark, ROOT))
    assert made.count("Relation [l_orderkey") == 1
    # how a call is made does not matter here
    assert "method_call" not in made


def test_expansion_by_hand(spark):
    seeds = [("o", "A"), ("o", "A"), ("o", "X"), ("o", None), (None, "B"), ("p", "B")]
    edges = [
        ("o", "A", "B", "call"), ("o", "A", "B", "new"), ("o", "A", "A", "call"), ("o", "C", "A", "call"), ("o", "X", "D", "call"), ("o", "E", "X", "call"),
        ("o", "B", "F", "call"), ("o", "G", "C", "call"), ("p", "A", "H", "call"), ("o", "A", None, "call"), ("o", None, "A", "call"), (None, "I", "B", "call"), (None, "B", "I", "call"),
    ]
    cards = [("o", x) for x in "ABCDEFGHI"] + [("o", "C"), ("o", None), (None, "I"), ("p", "A"), ("p", "B"), ("p", "H")]
    frames = [
        spark.createDataFrame(seeds, "org_id string, component_id string"),
        spark.createDataFrame(edges, "org_id string, src string, dst string, via string"),
        spark.createDataFrame(cards, "org_id string, component_id string"),
    ]
    named = {s for s in seeds if None not in s}
    near = {(o, d) for o, s, d, _ in edges if (o, s) in named} | {(o, s) for o, s, d, _ in edges if (o, d) in named}
    want = {x + (x in named,) for x in named | near if None not in x and x in cards}
    got = [tuple(r) for r in g.expansion(*frames).collect()]
    assert sorted(got) == sorted(want) and ("o", "D", False) in want and ("o", "E", False) in want


def test_jobs_compute_only_what_they_read(spark):
    flows = fl.parsed(spark.createDataFrame([("o", "f", "{}")], "org_id string, flow_id string, metadata string"))
    # fault paths are read without the graph, fields without their values
    assert "array_position" not in plan(fl.graphs(flows).select("flow_id", "without_fault_path"))
    assert plan(fl.field_writes(flows).select("flow_id", "field")).count("from_json(") == 1


def test_facts_are_found_behind_the_spread_of_the_sources(spark):
    from faultline.operators import org_index

    def spread_out(df, *keys):
        return df.repartition(3, *keys)

    code = spread_out(spark.createDataFrame([("o", "A", CODE)], "org_id string, component_id string, code string"), "org_id", "component_id")
    flow = '{"processType":"Workflow","recordLookups":[{"name":"L"}]}'
    flows = spark.createDataFrame([("o", "F", flow, "Active", 1, None)], "org_id string, flow_id string, metadata string, status string, version_number int, namespace string")
    facts = org_index.extract(code, code.limit(0), None, spread_out(flows, "org_id", "flow_id"))["facts"]
    assert {r.kind for r in facts.collect()} == {"process", "no_fault_path"}
    # what lies deeper than a RepartitionByExpression reads no text
    lines, deeper = plan(facts).split("\n"), None
    for line in lines:
        indent = len(line) - len(line.lstrip(" :+-"))
        if deeper is not None and indent <= deeper:
            deeper = None
        if deeper is not None:
            assert "from_json" not in line and "RLIKE" not in line and "regexp" not in line, line
        elif "RepartitionByExpression" in line:
            deeper = indent
