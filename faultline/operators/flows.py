"""Flow metadata documents: elements, graph, writes, objects, flags.

A document is one row, so everything inside it is done with array functions on
that row: no shuffle, and flows of all orgs run side by side.  Arrays are
unnested with the outer functions and filtered after: for the inner ones Spark
adds a size filter that computes the array a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import columns as c

KEY = ["org_id", "flow_id"]

# ---- fixed values -----------------------------------------------------------
PROCESS_BUILDER = ("workflow", "invocableprocess")
FAULT_CAPABLE = ("recordUpdate", "recordCreate", "recordDelete", "recordLookup", "actionCall")
GLOBALS = "$User $Organization $Profile $System $Api $Label $Setup $Permission $Flow $Client".split()
SCALARS = {
    "booleanValue": "boolean", "numberValue": "number", "dateTimeValue": "datetime", "dateValue": "date", "stringValue": "string",
}
MEMBERS = [*SCALARS, "elementReference", "apexValue", "sobjectValue", "formulaExpression", "formulaDataType"]
# -----------------------------------------------------------------------------

_GO = "struct<targetReference:string>"
_COND = "array<struct<field:string,leftValueReference:string,operator:string,value:string,rightValue:string>>"
_ITEM = f"name:string,label:string,connector:{_GO},faultConnector:{_GO}"
SCHEMA = f"""processType string, label string, runInMode string,
start struct<object:string,triggerType:string,recordTriggerType:string,connector:{_GO},filterLogic:string,filterFormula:string,filters:{_COND},
  doesRequireRecordChangedToMeetCriteria:boolean,scheduledPaths:array<struct<name:string,label:string,offsetNumber:bigint,offsetUnit:string,recordField:string,timeSource:string>>>,
decisions array<struct<name:string,label:string,rules:array<struct<name:string,label:string,conditionLogic:string,conditions:{_COND},connector:{_GO}>>,defaultConnector:{_GO}>>,
recordUpdates array<struct<{_ITEM},object:string,inputReference:string,inputAssignments:array<struct<field:string,value:string>>>>,
recordCreates array<struct<{_ITEM},object:string,inputReference:string,inputAssignments:array<struct<field:string,value:string>>>>,
recordDeletes array<struct<{_ITEM},object:string,inputReference:string>>,
recordLookups array<struct<{_ITEM},object:string,filters:{_COND},getFirstRecordOnly:boolean,outputReference:string>>,
assignments array<struct<{_ITEM},assignmentItems:array<struct<assignToReference:string,operator:string,value:string>>>>,
loops array<struct<name:string,label:string,collectionReference:string,iterationOrder:string,nextValueConnector:{_GO},noMoreValuesConnector:{_GO}>>,
actionCalls array<struct<{_ITEM},actionType:string,actionName:string,inputParameters:array<struct<name:string,value:string>>,outputParameters:array<struct<name:string>>>>,
subflows array<struct<{_ITEM},flowName:string>>, screens array<struct<{_ITEM}>>, waits array<struct<{_ITEM}>>"""

# the part of SCHEMA that elements and their graph read: names, connectors and objects, no conditions, assignments or values
ELEMENT_SCHEMA = f"""start struct<object:string,connector:{_GO}>,
decisions array<struct<name:string,label:string,rules:array<struct<connector:{_GO}>>,defaultConnector:{_GO}>>,
recordUpdates array<struct<{_ITEM},object:string,inputReference:string>>, recordCreates array<struct<{_ITEM},object:string>>,
recordDeletes array<struct<{_ITEM}>>, recordLookups array<struct<{_ITEM},object:string,outputReference:string>>, assignments array<struct<{_ITEM}>>,
loops array<struct<name:string,label:string,nextValueConnector:{_GO},noMoreValuesConnector:{_GO}>>,
actionCalls array<struct<{_ITEM},actionName:string>>, subflows array<struct<{_ITEM},flowName:string>>, screens array<struct<{_ITEM}>>, waits array<struct<{_ITEM}>>"""

# the part that field writes read
WRITE_SCHEMA = """start struct<object:string>,
recordUpdates array<struct<name:string,object:string,inputReference:string,inputAssignments:array<struct<field:string,value:string>>>>,
recordCreates array<struct<name:string,object:string,inputReference:string,inputAssignments:array<struct<field:string,value:string>>>>,
assignments array<struct<name:string,assignmentItems:array<struct<assignToReference:string,value:string>>>>"""


def parsed(documents: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """``schema``: a part of SCHEMA, for jobs that read no more; values and conditions cost most of the reading."""
    return documents.withColumn("m", F.from_json("metadata", schema))


def members(text: Column) -> Column:
    """The members of a value node; a column of its own, so that a node is read once."""
    return F.from_json(text, "map<string,string>")


def value_node(text: Column, bag: Column) -> Column:
    """The unified value of a union node: the first member that carries a value decides.

    Every member may be present with null, so presence means nothing; no
    value at all is a deliberate blank, an unknown member is "unparsed".
    """

    def member(name: str) -> Column:
        return F.try_element_at(bag, F.lit(name))

    def node(kind: str, type_: str | Column, value: Column | None = None, expression: Column | None = None, blank: bool = False) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), (F.lit(type_) if isinstance(type_, str) else type_).alias("type"),
            (none if value is None else value).alias("value"), (none if expression is None else expression).alias("expression"),
            F.lit(blank).alias("is_blank_assignment"),
        )

    ref = F.coalesce(member("elementReference"), member("apexValue"))
    # one pattern for all names: every mention of ref looks into the node again
    is_global = ref.rlike("^(?:" + "|".join(g.replace("$", r"\$") for g in GLOBALS) + ")")
    unknown = F.size(F.map_keys(F.map_filter(bag, lambda k, v: ~k.isin(MEMBERS) & v.isNotNull()))) > 0
    out = F.when(unknown, node("unparsed", "unknown")).otherwise(node("literal", "null", blank=True))
    for name, type_ in reversed(SCALARS.items()):
        v = member(name)
        if name == "stringValue":
            out = F.when(v == "", node("literal", "null", blank=True)).when(v.isNotNull(), node("literal", type_, v)).otherwise(out)
        else:
            out = F.when(v.isNotNull(), node("literal", type_, v)).otherwise(out)
    out = F.when(
        member("formulaExpression").isNotNull(),
        node("formula", F.lower(F.coalesce(member("formulaDataType"), F.lit("string"))), None, member("formulaExpression")),
    ).otherwise(out)
    out = F.when(member("sobjectValue").isNotNull(), node("variable", "sobject", member("sobjectValue"))).otherwise(out)
    out = F.when(ref.isNotNull(), F.when(is_global, node("global", "unknown", ref)).otherwise(node("reference", "unknown", ref))).otherwise(out)
    bare = F.when(text.isin("true", "false"), node("literal", "boolean", text)).when(
        text.rlike(r"^-?\d+(\.\d+)?$"), node("literal", "number", text)
    ).otherwise(node("literal", "string", text))
    return F.when(text.isNull(), None).when(text.startswith("{"), out).otherwise(bare)


def headers(flows: DataFrame) -> DataFrame:
    m = F.col("m")
    mechanism = F.when(F.lower(m["processType"]).isin(*PROCESS_BUILDER), "Process Builder").otherwise("Flow")
    changed = m["start"]["doesRequireRecordChangedToMeetCriteria"]
    return flows.select(
        *KEY, m["label"].alias("label"), mechanism.alias("mechanism"), "status", (F.col("status") == "Active").alias("is_active"),
        F.col("version_number"), m["start"]["object"].alias("start_object"), m["start"]["triggerType"].alias("trigger_type"),
        m["start"]["recordTriggerType"].alias("record_trigger_type"),
        F.coalesce(m["start"]["filterLogic"], F.when(F.size(m["start"]["filters"]) > 0, "and")).alias("filter_logic"),
        F.coalesce(F.size(m["start"]["filters"]), F.lit(0)).cast("bigint").alias("filters"),
        F.coalesce(changed.cast("string"), F.lit("not_present_in_metadata")).alias("requires_change"),
        F.coalesce(F.size(m["start"]["scheduledPaths"]), F.lit(0)).cast("bigint").alias("scheduled_paths"), m["runInMode"].alias("run_in_mode"),
    )


def _each(array: Column, make) -> Column:
    return F.coalesce(F.transform(F.filter(array, lambda e: e["name"].isNotNull()), make), F.array())


def _element(e: Column, type_: str, next_: Column, fault: Column, targets: list[Column], obj: Column, ref: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        e["name"].alias("name"), e["label"].alias("label"), F.lit(type_).alias("type"),
        (none if next_ is None else next_).alias("next"), (none if fault is None else fault).alias("fault_target"),
        F.array_compact(F.array(*targets)).alias("targets"), (none if obj is None else obj).alias("target_object"),
        (none if ref is None else ref).alias("target_reference"),
    )


def element_array(m: Column) -> Column:
    """All elements of a document on one layout, in kind order."""
    start_object = m["start"]["object"]

    def plain(type_: str, obj=None, ref=None):
        def make(e: Column) -> Column:
            nxt, fault = e["connector"]["targetReference"], e["faultConnector"]["targetReference"]
            return _element(e, type_, nxt, fault, [nxt, fault], obj(e) if obj else None, ref(e) if ref else None)
        return make

    def changed(e: Column) -> Column:
        own = F.when(e["inputReference"].startswith("$Record"), start_object)
        return F.coalesce(e["object"], own)

    def decision(e: Column) -> Column:
        default = e["defaultConnector"]["targetReference"]
        rules = F.coalesce(F.transform(e["rules"], lambda r: r["connector"]["targetReference"]), F.array().cast("array<string>"))
        base = _element(e, "decision", None, None, [default], None, None)
        return F.struct(*[
            (F.array_compact(F.concat(rules, F.array(default))) if f == "targets" else base[f]).alias(f)
            for f in ("name", "label", "type", "next", "fault_target", "targets", "target_object", "target_reference")
        ])

    def loop(e: Column) -> Column:
        nxt, done = e["nextValueConnector"]["targetReference"], e["noMoreValuesConnector"]["targetReference"]
        return _element(e, "loop", nxt, None, [nxt, done], None, None)

    return F.concat(
        _each(m["decisions"], decision),
        _each(m["recordUpdates"], plain("recordUpdate", changed, lambda e: e["inputReference"])),
        _each(m["recordCreates"], plain("recordCreate", lambda e: e["object"])),
        _each(m["recordDeletes"], plain("recordDelete")),
        _each(m["recordLookups"], plain("recordLookup", lambda e: e["object"], lambda e: e["outputReference"])),
        _each(m["assignments"], plain("assignment")),
        _each(m["loops"], loop),
        _each(m["actionCalls"], plain("actionCall", None, lambda e: e["actionName"])),
        _each(m["subflows"], plain("subflow", None, lambda e: e["flowName"])),
        _each(m["screens"], plain("screen")), _each(m["waits"], plain("wait")),
    )


def elements(flows: DataFrame) -> DataFrame:
    return flows.select(*KEY, F.inline_outer(element_array(F.col("m")))).filter("name IS NOT NULL").drop("targets")


def edges(flows: DataFrame) -> DataFrame:
    each = flows.select(*KEY, F.inline_outer(element_array(F.col("m"))))
    return each.select(*KEY, F.col("name").alias("src"), F.explode_outer("targets").alias("dst")).filter("dst IS NOT NULL")


def _let(value: Column, then) -> Column:
    """``then`` applied to a value that is computed once, however often it is used.

    A column used inside a lambda would be put in its place there and computed
    again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), then)[0]


def _reached(g: Column, start: Column, rounds: Column) -> Column:
    """Names of the elements that the start reaches: one step outward a round, from those found last."""
    first = F.array_position(g["names"], start)
    begin = F.when(first > 0, F.array(first.cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, _r: Column) -> Column:
        onward = F.array_except(F.flatten(F.transform(acc["last"], lambda i: g["after"][i])), acc["seen"])
        outward = _let(onward, lambda found: F.struct(F.concat(acc["seen"], found).alias("seen"), found.alias("last")))
        return F.when(F.size(acc["last"]) == 0, acc).otherwise(outward)

    found = F.aggregate(rounds, F.struct(begin.alias("seen"), begin.alias("last")), step, lambda acc: acc["seen"])
    return F.transform(found, lambda i: g["names"][i])


def _layers(g: Column, rounds: Column) -> Column:
    """Longest path to each element, by peeling: in each round go those whose predecessors have all gone.

    Elements on or behind a cycle never go; theirs is null.
    """
    none = F.struct(F.transform(g["names"], lambda _x: F.lit(None).cast("int")).alias("gone"), F.lit(True).alias("moved"))

    def step(acc: Column, r: Column) -> Column:
        free = lambda i: F.forall(g["before"][i], lambda p: acc["gone"][p].isNotNull())
        nxt = F.transform(acc["gone"], lambda d, i: F.when(d.isNotNull(), d).when(free(i), r - 1))
        left = lambda x: F.size(F.filter(x, lambda d: d.isNull()))
        peeled = F.transform(F.array(nxt), lambda x: F.struct(x.alias("gone"), (left(x) < left(acc["gone"])).alias("moved")))[0]
        return F.when(acc["moved"], peeled).otherwise(acc)

    return F.aggregate(rounds, none, step, lambda acc: acc["gone"])


def with_graph(flows: DataFrame) -> DataFrame:
    """Adds ``els``, the elements, ``graph``: names, what the start reaches and depths, and ``without_fault_path``.

    The last one needs no graph; in a column of its own it is read without one.
    """
    start = F.col("m.start.connector.targetReference")

    def named(els: Column) -> Column:
        return F.struct(els.alias("els"), F.array_distinct(F.transform(els, lambda e: e["name"])).alias("names"))

    def placed(g: Column) -> Column:
        place = lambda x: F.array_position(g["names"], x).cast("int") - 1
        # each name is looked up once; elements are few names, ways compare numbers
        pairs = F.flatten(F.transform(g["els"], lambda e: _let(place(e["name"]), lambda src: F.transform(
            e["targets"], lambda t: F.struct(src.alias("src"), place(t).alias("dst"))
        ))))
        return F.struct(g["els"].alias("els"), g["names"].alias("names"), F.filter(pairs, lambda p: p["dst"] >= 0).alias("pairs"))

    def inner(g: Column) -> Column:
        ways = lambda end, other: F.transform(g["names"], lambda _x, i: F.transform(F.filter(g["pairs"], lambda p: p[end] == i), lambda p: p[other]))
        return F.struct(g["els"].alias("els"), g["names"].alias("names"), ways("dst", "src").alias("before"), ways("src", "dst").alias("after"))

    def measured(g: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(g["names"])))
        return F.struct(g["names"].alias("names"), _reached(g, start, rounds).alias("reach"), _layers(g, rounds).alias("depths"))

    rows = flows.withColumn("els", element_array(F.col("m")))
    bare = F.filter("els", lambda e: e["type"].isin(*FAULT_CAPABLE) & e["fault_target"].isNull())
    return rows.withColumn("graph", _let(_let(_let(_let(F.col("els"), named), placed), inner), measured)).withColumn(
        "without_fault_path", F.array_join(F.sort_array(F.transform(bare, lambda e: e["name"])), ",")
    )


def graphs(flows: DataFrame) -> DataFrame:
    """Reachability, cycles, order and depth of every flow's element graph."""
    rows = with_graph(flows).select(*KEY, F.col("m.start.connector.targetReference").alias("start"), "graph.*", "without_fault_path")
    rows = rows.withColumn("has_cycles", F.exists("depths", lambda d: d.isNull()))
    order = F.sort_array(F.transform(F.arrays_zip("depths", "names"), lambda x: F.struct(x["depths"].alias("d"), x["names"].alias("n"))))
    acyclic = ~F.col("has_cycles")
    return rows.select(
        *KEY, "start", "has_cycles", F.size("names").cast("bigint").alias("elements"),
        F.array_join(F.sort_array(F.array_except("names", "reach")), ",").alias("unreachable"), "without_fault_path",
        F.when(acyclic & F.array_contains("names", F.col("start")), F.array_max("depths")).cast("bigint").alias("max_depth"),
        F.when(acyclic, F.array_join(F.transform(order, lambda o: o["n"]), ",")).otherwise("").alias("topological_order"),
    )


# ---- conditions, paths and assignments as rows --------------------------------

PRECEDENCE = {"NOT": 3, "AND": 2, "OR": 1}


def _strength(op: Column) -> Column:
    out = F.lit(0)
    for name, value in PRECEDENCE.items():
        out = F.when(op == name, value).otherwise(out)
    return out


def logic_postfix(logic: Column, n: Column) -> Column:
    """Condition logic over numbered conditions, as ``1 AND (2 OR 3)``, in postfix order: ``1 2 3 OR AND``.

    Plain ``and`` or ``or`` joins all ``n`` conditions; none is ``and``.  One
    fold over the words: operators wait until a weaker one, a closing
    parenthesis or the end comes, so those that wait inside one parenthesis
    grow in strength.
    """
    word = F.upper(F.coalesce(F.trim(logic), F.lit("and")))
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string"))
    spelled = F.when(word == "AND", F.array_join(numbers, " AND ")).when(word == "OR", F.array_join(numbers, " OR ")).otherwise(word)
    tokens = F.regexp_extract_all(spelled, F.lit(r"\d+|AND|OR|NOT|[()]"), 0)
    empty = F.array().cast("array<string>")
    begin = F.struct(empty.alias("out"), empty.alias("inner"), F.array().cast("array<array<string>>").alias("outer"))

    def step(acc: Column, t: Column) -> Column:
        def state(out: Column, inner: Column, outer: Column) -> Column:
            return F.struct(out.alias("out"), inner.alias("inner"), outer.alias("outer"))

        weaker = F.filter(acc["inner"], lambda o: _strength(o) < _strength(t))
        stronger = F.filter(acc["inner"], lambda o: _strength(o) >= _strength(t))
        above = F.coalesce(F.try_element_at(acc["outer"], F.lit(-1)), empty)
        return (
            F.when(t == "(", state(acc["out"], empty, F.array_append(acc["outer"], acc["inner"])))
            .when(t == ")", state(F.concat(acc["out"], F.reverse(acc["inner"])), above, F.slice(acc["outer"], 1, F.greatest(F.size(acc["outer"]) - 1, F.lit(0)))))
            .when(t == "NOT", state(acc["out"], F.array_append(acc["inner"], t), acc["outer"]))
            .when(t.isin("AND", "OR"), state(F.concat(acc["out"], F.reverse(stronger)), F.array_append(weaker, t), acc["outer"]))
            .otherwise(state(F.array_append(acc["out"], t), acc["inner"], acc["outer"]))
        )

    # a parenthesis left open closes at the end
    done = F.aggregate(tokens, begin, step, lambda acc: F.concat(acc["out"], F.reverse(acc["inner"]), F.flatten(F.reverse(F.transform(acc["outer"], F.reverse)))))
    return F.array_join(done, " ")


def conditions(flows: DataFrame) -> DataFrame:
    """Every condition of entry filters, decision rules and lookups, numbered as the logic numbers them."""
    m = F.col("m")
    none = F.lit(None).cast("string")

    def group(place: str, element: Column, rule: Column, logic: Column, given: Column) -> Column:
        return F.struct(
            F.lit(place).alias("place"), element.alias("element"), rule.alias("rule"), F.lower(F.coalesce(logic, F.lit("and"))).alias("logic"), given.alias("given")
        )

    start = F.array(group("start", none, none, m["start"]["filterLogic"], m["start"]["filters"]))
    rules = F.flatten(F.transform(m["decisions"], lambda d: F.transform(d["rules"], lambda r: group("rule", d["name"], r["name"], r["conditionLogic"], r["conditions"]))))
    lookups = F.transform(m["recordLookups"], lambda e: group("lookup", e["name"], none, none, e["filters"]))
    groups = F.concat(start, *[F.coalesce(x, F.array().cast("array<struct<place:string,element:string,rule:string,logic:string,given:%s>>" % _COND)) for x in (rules, lookups)])
    rows = flows.select(*KEY, F.inline_outer(groups)).filter("place IS NOT NULL")
    rows = rows.withColumn("postfix", logic_postfix(F.col("logic"), F.size("given")))
    rows = rows.select(*KEY, "place", "element", "rule", "logic", "postfix", F.posexplode_outer("given").alias("position", "c")).filter("c IS NOT NULL")
    rows = rows.withColumn("text", F.coalesce("c.value", "c.rightValue")).withColumn("bag", members(F.col("text")))
    rows = rows.withColumn("v", value_node(F.col("text"), F.col("bag")))
    return rows.select(
        *KEY, "place", "element", "rule", "logic", "postfix", (F.col("position") + 1).cast("bigint").alias("position"),
        F.coalesce("c.field", "c.leftValueReference").alias("field"), F.col("c.operator").alias("operator"),
        F.col("v.kind").alias("value_kind"), c.shown_value(F.col("v")).alias("value"),
    )


def scheduled_paths(flows: DataFrame) -> DataFrame:
    rows = flows.select(*KEY, F.explode_outer("m.start.scheduledPaths").alias("p")).filter("p IS NOT NULL")
    return rows.select(
        *KEY, F.coalesce("p.name", "p.label").alias("name"), F.col("p.offsetNumber").alias("offset_number"), F.col("p.offsetUnit").alias("offset_unit"),
        F.col("p.recordField").alias("base_field"), F.col("p.timeSource").alias("time_source"),
    )


def assignments(flows: DataFrame) -> DataFrame:
    """Every assignment with its target, operator and value, in order."""
    each = flows.select(*KEY, F.explode_outer("m.assignments").alias("e")).filter("e.name IS NOT NULL")
    rows = each.select(*KEY, F.col("e.name").alias("element"), F.posexplode_outer("e.assignmentItems").alias("position", "a")).filter("a IS NOT NULL")
    rows = rows.withColumn("bag", members(F.col("a.value"))).withColumn("v", value_node(F.col("a.value"), F.col("bag")))
    return rows.select(
        *KEY, "element", (F.col("position") + 1).cast("bigint").alias("position"), F.col("a.assignToReference").alias("target"), F.col("a.operator").alias("operator"),
        F.col("v.kind").alias("value_kind"), c.shown_value(F.col("v")).alias("value"),
    )


def actions(flows: DataFrame) -> DataFrame:
    """Action calls with inputs and outputs; apex ones await resolution by the index."""
    calls = flows.select(*KEY, F.explode_outer("m.actionCalls").alias("a")).filter("a IS NOT NULL")
    type_ = F.nullif(F.trim("a.actionType"), F.lit(""))
    read = F.transform("a.inputParameters", lambda p: F.struct(p["name"].alias("name"), p["value"].alias("text"), members(p["value"]).alias("bag")))
    nodes = F.transform(read, lambda p: F.struct(p["name"].alias("name"), value_node(p["text"], p["bag"]).alias("v")))
    inputs = F.transform(nodes, lambda p: F.concat_ws("=", p["name"], c.shown_value(p["v"])))
    return calls.select(
        *KEY, F.col("a.name").alias("element"), type_.alias("action_type"), F.col("a.actionName").alias("action_name"),
        F.array_join(inputs, ",").alias("inputs"), F.array_join(F.col("a.outputParameters.name"), ",").alias("outputs"),
        F.when(type_ == "apex", "pending").otherwise("standard_action").alias("resolution"),
    )


def subflows(flows: DataFrame) -> DataFrame:
    return flows.select(*KEY, F.explode_outer("m.subflows").alias("s")).filter("s.flowName IS NOT NULL").select(
        *KEY, F.col("s.name").alias("element"), F.col("s.flowName").alias("subflow")
    )


def _is_field(name: Column) -> Column:
    return F.coalesce(name.contains("__") | name.rlike(r"^\p{Lu}\w*$"), F.lit(False))


def _with_raw_writes(flows: DataFrame) -> DataFrame:
    """Adds ``writes``: direct writes with high confidence, those through a persisted record variable with medium; their values as text."""
    m = F.col("m")
    start_object = m["start"]["object"]

    def direct(name: str, type_: str) -> Column:
        each = F.transform(m[name], lambda e: F.transform(
            F.coalesce(e["inputAssignments"], F.array().cast("array<struct<field:string,value:string>>")), lambda a: F.struct(
                a["field"].alias("field"), F.coalesce(e["object"], F.when(e["inputReference"].startswith("$Record"), start_object)).alias("object"),
                F.lit(type_).alias("element_type"), e["name"].alias("element"), a["value"].alias("node"), F.lit("high").alias("confidence"),
            )))
        return F.coalesce(F.flatten(each), F.array())

    def heads(name: str) -> Column:
        return F.coalesce(F.flatten(F.transform(m[name], lambda e: F.array(F.split(e["inputReference"], r"\.")[0], e["name"]))), F.array().cast("array<string>"))

    known = F.concat(F.array(F.lit("$Record")), heads("recordUpdates"), heads("recordCreates"))

    def through(e: Column, persisted: Column) -> Column:
        def one(a: Column) -> Column:
            head = F.split(a["assignToReference"], r"\.")[0]
            own = head.startswith("$Record")
            return F.struct(
                F.substring_index(a["assignToReference"], ".", -1).alias("field"), F.when(own, start_object).alias("object"),
                F.lit("assignment").alias("element_type"), e["name"].alias("element"), a["value"].alias("node"),
                F.when(own, "high").when(F.array_contains(persisted, head), "medium").alias("confidence"),
            )
        dotted = F.filter(e["assignmentItems"], lambda a: a["assignToReference"].contains("."))
        return F.coalesce(F.transform(dotted, one), F.array())

    assigned = _let(known, lambda persisted: F.coalesce(
        F.flatten(F.transform(m["assignments"], lambda e: through(e, persisted))), F.array()
    ))
    raw = F.concat(direct("recordUpdates", "recordUpdate"), direct("recordCreates", "recordCreate"), assigned)
    return flows.withColumn("writes", F.filter(raw, lambda w: w["confidence"].isNotNull() & _is_field(w["field"])))


def with_writes(flows: DataFrame) -> DataFrame:
    """The same with the value of each write read."""
    rows = _with_raw_writes(flows).withColumn("writes", F.transform("writes", lambda w: F.struct(w.alias("w"), members(w["node"]).alias("bag"))))
    return rows.withColumn("writes", F.transform("writes", lambda x: F.struct(
        *[x["w"][n].alias(n) for n in ("field", "object", "element_type", "element", "confidence")], value_node(x["w"]["node"], x["bag"]).alias("v")
    )))


def field_writes(flows: DataFrame) -> DataFrame:
    # values are read from the rows: a job that wants only the fields reads none
    rows = _with_raw_writes(flows).select(*KEY, F.inline_outer("writes")).filter("field IS NOT NULL")
    rows = rows.withColumn("bag", members(F.col("node"))).withColumn("v", value_node(F.col("node"), F.col("bag")))
    return rows.select(
        *KEY, "field", "object", "element_type", "element", "confidence", F.col("v.kind").alias("value_kind"),
        c.shown_value(F.col("v")).alias("value"), F.col("v.is_blank_assignment").alias("is_blank"),
    )


def objects(flows: DataFrame) -> DataFrame:
    """Objects a flow reads and writes."""
    def touch(obj: Column, reads: Column, writes: Column) -> Column:
        return F.struct(obj.alias("object"), reads.alias("reads"), writes.alias("writes"))

    changing = ("recordLookup", "recordUpdate", "recordCreate", "recordDelete")
    from_elements = F.transform(
        F.filter(element_array(F.col("m")), lambda e: e["type"].isin(*changing)),
        lambda e: touch(e["target_object"], e["type"] == "recordLookup", e["type"] != "recordLookup"),
    )
    from_writes = F.transform("writes", lambda w: touch(w["object"], F.lit(False), F.lit(True)))
    start = F.array(touch(F.col("m.start.object"), F.lit(True), F.lit(False)))
    rows = with_writes(flows).select(*KEY, F.inline_outer(F.concat(start, from_elements, from_writes)))
    return rows.filter("object IS NOT NULL").groupBy(*KEY, "object").agg(
        F.bool_or("reads").alias("reads"), F.bool_or("writes").alias("writes")
    )


def value_nodes(flows: DataFrame) -> DataFrame:
    """Value nodes of each document: how many, and how many could not be read."""
    m = F.col("m")
    empty = F.array().cast("array<string>")

    def picked(array: Column, *names: str) -> Column:
        return F.coalesce(F.transform(array, lambda x: F.coalesce(*[x[n] for n in names])), empty)

    texts = F.concat(
        picked(m["start"]["filters"], "value", "rightValue"),
        F.coalesce(F.flatten(F.transform(m["decisions"], lambda d: F.flatten(F.transform(d["rules"], lambda r: picked(r["conditions"], "value", "rightValue"))))), empty),
        F.coalesce(F.flatten(F.transform(m["recordLookups"], lambda e: picked(e["filters"], "value", "rightValue"))), empty),
        F.coalesce(F.flatten(F.transform(m["assignments"], lambda e: picked(e["assignmentItems"], "value"))), empty),
        F.coalesce(F.flatten(F.transform(m["actionCalls"], lambda e: picked(e["inputParameters"], "value"))), empty),
    )
    rows = with_writes(flows).withColumn("nodes", F.transform(
        F.filter(texts, lambda t: t.isNotNull()), lambda t: F.struct(t.alias("text"), members(t).alias("bag"))
    ))
    own = F.transform("nodes", lambda n: value_node(n["text"], n["bag"])["kind"])
    rows = rows.withColumn("kinds", F.concat(own, F.transform("writes", lambda w: w["v"]["kind"])))
    return rows.select(
        *KEY, F.size("kinds").cast("bigint").alias("values_total"),
        F.size(F.filter("kinds", lambda x: x == "unparsed")).cast("bigint").alias("values_unparsed"),
    )


def with_flags(flows: DataFrame) -> DataFrame:
    """Adds ``flags``; everything a flag depends on is in the document itself."""
    m = F.col("m")
    after = F.coalesce(m["start"]["triggerType"].contains("AfterSave"), F.lit(False))
    self_update = F.exists("els", lambda e: (e["type"] == "recordUpdate") & (
        F.coalesce(e["target_object"] == m["start"]["object"], F.lit(False)) | F.coalesce(e["target_reference"].startswith("$Record"), F.lit(False))))
    cleared = F.transform(
        F.filter("writes", lambda w: w["v"]["is_blank_assignment"] | F.coalesce(w["v"]["value"] == "false", F.lit(False))), lambda w: w["field"]
    )
    watched = F.coalesce(F.transform(m["start"]["filters"], lambda f: f["field"]), F.array().cast("array<string>"))

    def other_package(w: Column) -> Column:
        ns = c.field_namespace(w["field"])
        return ns.isNotNull() & ~ns.eqNullSafe(F.col("namespace"))

    rows = with_writes(with_graph(flows)).withColumn("own_update", after & F.coalesce(self_update, F.lit(False))).withColumn(
        "guarded", F.coalesce(F.arrays_overlap(watched, cleared), F.lit(False))
    ).withColumn("foreign_write", F.exists("writes", other_package))
    unchanged_ok = F.coalesce(m["start"]["doesRequireRecordChangedToMeetCriteria"], F.lit(True)) == F.lit(False)
    names = F.array_compact(F.array(
        F.when(F.col("own_update"), F.lit("self_referential_update")), F.when(F.col("guarded"), F.lit("loop_guard_detected")),
        F.when(F.col("own_update") & ~F.col("guarded") & unchanged_ok, F.lit("loop_guard_missing")),
        F.when(F.col("foreign_write"), F.lit("writes_managed_package_fields")), F.when(F.col("without_fault_path") != "", F.lit("no_fault_path")),
        F.when(F.size(F.array_except(F.col("graph.names"), F.col("graph.reach"))) > 0, F.lit("unreachable_elements")),
    ))
    return rows.withColumn("flags", names)


def flags(flows: DataFrame) -> DataFrame:
    """Derived flags as (flow, flag) rows."""
    return with_flags(flows).select(*KEY, F.explode_outer("flags").alias("flag")).filter("flag IS NOT NULL")


def entry_points(flows: DataFrame, triggers: DataFrame, updates: DataFrame) -> DataFrame:
    """What runs when a record of an object is saved, as (org, object, bucket, component)."""
    m = F.col("m")
    bucket = F.when(F.lower(m["processType"]).isin(*PROCESS_BUILDER), "process_builder").when(
        F.lower(F.coalesce(m["start"]["triggerType"], F.lit(""))).contains("beforesave"), "before_save_flows"
    ).otherwise("after_save_flows")
    # the flag's own condition: of all flags only what this one depends on is computed
    loops = F.when(F.col("own_update"), F.lit("self_referential_automation"))
    own = with_flags(flows).filter(m["start"]["object"].isNotNull()).select(
        "org_id", m["start"]["object"].alias("object"), F.explode_outer(F.array_compact(F.array(bucket, loops))).alias("bucket"),
        F.col("flow_id").alias("component_id"),
    )
    trig = triggers.filter("object IS NOT NULL").select("org_id", "object", F.lit("apex_triggers").alias("bucket"), "component_id")
    upd = updates.filter("object IS NOT NULL").select("org_id", "object", F.lit("workflow_field_updates").alias("bucket"), "component_id")
    return own.unionByName(trig).unionByName(upd)


def entry_point_counts(points: DataFrame) -> DataFrame:
    buckets = (
        "before_save_flows", "after_save_flows", "apex_triggers", "process_builder", "workflow_field_updates", "self_referential_automation"
    )
    return points.groupBy("org_id", "object").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in buckets])


def field_updates(documents: DataFrame) -> DataFrame:
    """Workflow and approval field updates; without a target field there is no card."""
    m = F.from_json("metadata", "targetObject string, field string, operation string, formula string, literalValue string")
    rows = documents.withColumn("m", m).filter(F.coalesce("m.field", F.lit("")) != "")
    op = F.trim(F.coalesce("m.operation", F.lit("")))
    formula = F.nullif("m.formula", F.lit(""))
    kind = F.when(formula.isNotNull(), "formula").when(F.col("m.literalValue").isNotNull(), "literal").when(op != "", "operation")
    return rows.select(
        *[x for x in documents.columns if x == "org_id"], F.col("full_name").alias("component_id"),
        F.when(F.col("full_name").contains("."), F.split("full_name", r"\.")[0]).otherwise(F.col("m.targetObject")).alias("object"),
        F.substring_index("m.field", ".", -1).alias("field"), F.col("m.field").alias("field_path"), F.col("m.operation").alias("operation"),
        kind.alias("value_kind"), F.coalesce(formula, "m.literalValue", F.nullif(op, F.lit(""))).alias("value"),
    )
