"""Cross-component indexes and lookups: who calls, writes, touches and starts what.

Everything is an edge table keyed by ``org_id``; nothing grows an array per
hub.  Lists that a caller asks for are capped where the feature says so, with
the full count beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import columns as c

# ---- fixed values -----------------------------------------------------------
ASYNC = ("System.enqueueJob", "Database.executeBatch", "System.schedule", "System.scheduleBatch")
JOB_KINDS = ("Queueable", "Batchable", "Schedulable")
SEARCH_LIMIT = 25
RECENT_DAYS = 14
FEATURES = (("3.2.0", "async_dispatches"), ("3.3.0", "call_sites"))
CODE_TYPES = ("ApexClass", "ApexTrigger")
TEST_HINTS = ("test", "tests", "_test_", "testing", "mock", "testdata", "testsetup")
RISK_IN_MAP = {"high": 0, "medium": 1, "low": 2, "declarative": 3}
RISK_IN_ANSWER = {"high": 0, "medium": 1, "declarative": 2, "low": 3}
MECHANISMS = ("Apex", "Flow", "Process Builder", "Workflow/Approval field update")
FOLDERS = {
    "ApexClass": ("classes", ".cls"), "ApexInterface": ("classes", ".cls"), "ApexEnum": ("classes", ".cls"),
    "ApexTrigger": ("triggers", ".trigger"), "Flow": ("flows", ".flow"), "LWC": ("lwc", ""),
    "WorkflowFieldUpdate": ("workflow", ""),
}
KINDS = {
    "apex_classes": ("ApexClass", "class"), "apex_triggers": ("ApexTrigger", "trigger"), "flows": ("Flow", "flow"),
    "lwc_components": ("LWC", "lwc"), "workflow_field_updates": ("WorkflowFieldUpdate", "workflow"),
}
NOT_COLLECTED = ("validation_rules", "record_types", "approval_processes")
# -----------------------------------------------------------------------------


def rank_of(value: Column, ranks: dict[str, int], other: int = 9) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def with_ownership(cards: DataFrame, own_namespace: str | None = None) -> DataFrame:
    """Managed unless it has no namespace or the org's own."""
    own = F.coalesce(F.col("namespace") == F.lit(own_namespace), F.lit(False))
    managed = F.coalesce(F.nullif("namespace", F.lit("")).isNotNull() & ~own, F.lit(False))
    return cards.withColumn("is_managed", managed).withColumn("is_customer_authored", ~managed).withColumn(
        "in_org_namespace", own
    )


def managed_split(cards: DataFrame) -> DataFrame:
    """What is only listed and what is parsed: managed code is listed; flows need an active version."""
    inactive = (F.col("type") == "Flow") & ~F.coalesce("is_active", F.lit(False))
    return cards.withColumn(
        "handling", F.when(F.col("is_managed"), "listed").when(inactive, "skipped").otherwise("parsed")
    )


def test_verdict(name: Column, flag: Column) -> tuple[Column, Column]:
    """(is a test class, how it is known): the annotation decides, else the name."""
    hinted = F.lit(False)
    for h in TEST_HINTS:
        hinted = hinted | F.lower(name).contains(h)
    how = F.when(flag.isNotNull(), "isTest_annotation").when(hinted, "name_heuristic").otherwise("no_annotation_recorded")
    return F.coalesce(flag, hinted), how


def manifest_key(type_: Column, component: Column) -> Column:
    out = F.lit(None).cast("string")
    for t, (folder, suffix) in FOLDERS.items():
        out = F.when(type_ == t, F.concat(F.lit(f"{folder}/"), component, F.lit(suffix))).otherwise(out)
    return out


def merged_index(*kinds: DataFrame) -> DataFrame:
    """One card per id; a later kind overrides an earlier one."""
    out = None
    for i, df in enumerate(kinds):
        part = df.withColumn("kind_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [x for x in out.columns if x not in ("org_id", "component_id", "kind_no")]
    best = out.groupBy("org_id", "component_id").agg(F.max_by(F.struct(*rest), "kind_no").alias("card"))
    return best.select("org_id", "component_id", "card.*")


# ---- call graph -------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct targets and distinct callers of every component."""
    pairs = edges.select("org_id", "src", "dst").distinct()
    both = pairs.select("org_id", F.col("src").alias("component_id"), F.lit(1).alias("calls"), F.lit(0).alias("called_by")).unionByName(
        pairs.select("org_id", F.col("dst").alias("component_id"), F.lit(0).alias("calls"), F.lit(1).alias("called_by"))
    )
    return both.groupBy("org_id", "component_id").agg(F.sum("calls").alias("calls"), F.sum("called_by").alias("called_by"))


def inbound(edges: DataFrame, imports: DataFrame, actions: DataFrame, subflows: DataFrame) -> DataFrame:
    """Everything that starts a component: async dispatches, then calls they do not explain, then UI and flows."""
    # one pass over the edges; the ways one class reaches another are a handful, so both lists stay small
    starts = F.when(F.col("via").isin(*ASYNC) & (F.col("src") != F.col("dst")), F.col("via"))
    calls = edges.groupBy("org_id", "src", "dst").agg(F.collect_set("via").alias("vias"), F.collect_list(starts).alias("started"))
    left = F.array_sort(F.filter("vias", lambda v: ~v.isin(*ASYNC) & ~((F.size("started") > 0) & (v == "constructor"))))
    way = lambda via, source: F.struct(via.alias("via"), F.lit(source).alias("source"))
    called = F.filter(F.array(way(F.array_join(left, ","), "call")), lambda w: w["via"] != "")
    ways = F.concat(F.transform("started", lambda v: way(v, "dispatch")), called)
    first = calls.select("org_id", F.col("dst").alias("target"), F.col("src").alias("caller"), F.inline(ways))
    ui = imports.select(
        "org_id", F.split("import_name", r"\.")[0].alias("target"), F.col("bundle").alias("caller")
    ).filter("target <> ''").distinct().select("*", F.lit("lwc_apex_import").alias("via"), F.lit("ui").alias("source"))
    from_flows = actions.filter("action_type = 'apex' AND action_name IS NOT NULL").select(
        "org_id", F.col("action_name").alias("target"), F.col("flow_id").alias("caller"),
        F.lit("actionCall").alias("via"), F.lit("flow").alias("source"),
    )
    subs = subflows.select(
        "org_id", F.col("subflow").alias("target"), F.col("flow_id").alias("caller"), F.lit("subflow").alias("via"), F.lit("flow").alias("source")
    )
    return first.unionByName(ui).unionByName(from_flows).unionByName(subs)


def inbound_sites(sites: DataFrame) -> DataFrame:
    """The call sites of each caller into each target, numbered, with their count."""
    rows = sites.filter("kind <> 'same_class'").withColumn("lower_target", F.lower("target"))
    total = rows.groupBy("org_id", "lower_target", "caller").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("org_id", "lower_target", "caller").orderBy("site_no", "line")
    return rows.withColumn("position", F.row_number().over(order)).join(total.hint("merge"), ["org_id", "lower_target", "caller"]).select(
        "org_id", "lower_target", "caller", "position", "method_called", "caller_method", "line", "in_loop", "kind", "total"
    )


def inbound_of_method(edges: DataFrame, sites: DataFrame, imports: DataFrame, method: str) -> DataFrame:
    """Callers of one method of any class: by call site, or by the methods a UI bundle imports."""
    m = method.lower()
    by_site = sites.filter((F.col("kind") != "same_class") & (F.lower("method_called") == m)).select(
        "org_id", F.lower("target").alias("lower_target"), "caller"
    )
    called = edges.select("org_id", F.lower("dst").alias("lower_target"), F.col("src").alias("caller")).distinct()
    by_import = imports.filter(F.lower(F.substring_index("import_name", ".", -1)) == m).select(
        "org_id", F.lower(F.split("import_name", r"\.")[0]).alias("lower_target"), F.col("bundle").alias("caller")
    )
    return called.join(by_site.distinct(), ["org_id", "lower_target", "caller"], "left_semi").withColumn(
        "found_by", F.lit("call_site")
    ).unionByName(by_import.distinct().withColumn("found_by", F.lit("import")))


def merged_case_variants(edges: DataFrame) -> DataFrame:
    """Targets that differ only in case, taken as one."""
    return edges.groupBy("org_id", F.lower("dst").alias("lower_target")).agg(
        F.min("dst").alias("target"), F.countDistinct("dst").alias("variants"), F.countDistinct("src").alias("callers")
    )


def mark_managed(sites: DataFrame, cards: DataFrame) -> DataFrame:
    """Call sites into managed classes are told apart from the org's own."""
    managed = cards.filter("is_managed").select(
        F.col("org_id").alias("m_org"), F.lower("component_id").alias("m_id"), F.col("namespace").alias("m_ns")
    )
    hit = F.col("m_id").isNotNull() & F.col("kind").isin("org_class", "namespaced_class")
    return sites.join(managed, (F.col("org_id") == F.col("m_org")) & (F.lower("target") == F.col("m_id")), "left").select(
        "org_id", "site_no", "line", "caller", "target", F.when(hit, "managed_package_class").otherwise(F.col("kind")).alias("kind"),
        F.when(hit, F.col("m_ns")).alias("namespace"),
    )


def async_invocations(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """For each job class, who dispatches it and how."""
    jobs = entries.filter(F.col("kind").isin(*JOB_KINDS) & ~F.col("is_inner")).select("org_id", "component_id", "kind")
    starts = edges.filter(F.col("via").isin(*ASYNC) & (F.col("src") != F.col("dst"))).select(
        "org_id", F.col("dst").alias("component_id"), F.col("src").alias("invoked_by"), "via"
    )
    return jobs.join(starts, ["org_id", "component_id"], "left")


def resolve_actions(actions: DataFrame, entries: DataFrame, cards: DataFrame) -> DataFrame:
    """Which method a flow's action runs: one invocable in the class, several, or none."""
    invocable = entries.filter("kind = 'InvocableMethod'").groupBy("org_id", "component_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("detail").alias("method")
    )
    classes = cards.select("org_id", "component_id").join(invocable, ["org_id", "component_id"], "left").select(
        F.col("org_id").alias("c_org"), F.col("component_id").alias("c_id"), F.coalesce("n", F.lit(0)).alias("n"), "method"
    )
    joined = actions.join(classes, (F.col("org_id") == F.col("c_org")) & (F.col("action_name") == F.col("c_id")), "left")
    resolution = (
        F.when(F.col("action_type") != "apex", "standard_action").when(F.col("c_id").isNull(), "class_not_in_kb")
        .when(F.col("n") == 1, "unique_invocable_in_class").when(F.col("n") > 1, "ambiguous").otherwise("class_not_in_kb")
    )
    note = F.when(
        F.col("action_type") == "apex",
        F.when(F.col("c_id").isNull(), "class unknown").when(F.col("n") == 0, "no invocable method"),
    )
    return joined.select(
        "org_id", "flow_id", "element_no", "element_pos", "action_name", resolution.alias("resolution"), note.alias("note"),
        F.when((F.col("action_type") == "apex") & (F.col("n") == 1), F.rtrim(F.regexp_replace("method", r"[()]+$", ""))).alias("resolved_method"),
    )


def resolve_ids(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Requested ids to components: exact, any case, then dotted parts with a namespace check.

    Candidates are exploded with their rank and joined on the lower-cased id,
    and the best rank of a request wins; no request is compared with more than
    the ids it spells.
    """
    asked = requests.withColumn("text", F.trim("raw")).filter("text <> ''")
    parts = F.filter(F.split("text", r"\."), lambda p: p != "")
    whole = asked.select("org_id", "request_id", "text", F.lit(-1).alias("rank"), F.col("text").alias("cand"), F.lit(None).cast("string").alias("ns"), F.lit(None).cast("string").alias("method"))
    pieces = asked.withColumn("parts", parts).select(
        "org_id", "request_id", "text", "parts", F.posexplode("parts").alias("rank", "cand")
    ).select(
        "org_id", "request_id", "text", "rank", "cand",
        F.when(F.col("rank") > 0, F.try_element_at("parts", F.col("rank"))).alias("ns"),
        F.try_element_at("parts", F.col("rank") + 2).alias("method"),
    )
    index = cards.select(
        F.col("org_id").alias("i_org"), "component_id", F.lower("component_id").alias("lower_id"), "namespace", "is_managed"
    )
    hits = whole.unionByName(pieces).join(
        index, (F.col("org_id") == F.col("i_org")) & (F.lower("cand") == F.col("lower_id"))
    )
    wrong = F.col("ns").isNotNull() & F.when(
        F.col("namespace").isNotNull(), F.lower("ns") != F.lower("namespace")
    ).otherwise(~F.col("is_managed"))
    fitting = hits.filter((F.col("rank") == -1) | ~wrong)
    best = F.struct("rank", F.col("cand") != F.col("component_id"), "component_id")
    found = fitting.groupBy("org_id", "request_id").agg(
        F.min_by(F.struct("component_id", "method", F.when(F.col("rank") == -1, F.when(F.col("cand") == F.col("component_id"), "exact").otherwise("any case")).otherwise("qualified").alias("how")), best).alias("hit")
    )
    return requests.join(found, ["org_id", "request_id"], "left").select(
        "org_id", "request_id", "raw", "hit.component_id", "hit.method", "hit.how"
    )


# ---- root-cause context -----------------------------------------------------


def expansion(seeds: DataFrame, edges: DataFrame, cards: DataFrame) -> DataFrame:
    """Named components with one hop out and one hop in, kept if they have a card.

    Edges are made distinct once, whatever else they carry, and each goes to
    both of its ends; one semi join against the distinct seeds then serves both
    directions, and no seed is paired with its callers.  Its hash table holds
    distinct seeds of a partition only, so the edges are not sorted.
    """
    named = seeds.select("org_id", "component_id").distinct()
    # an edge without one of its ends leads to no card or from no seed
    pairs = edges.select("org_id", "src", "dst").dropna().distinct()
    way = lambda end, other: F.struct(F.col(end).alias("end"), F.col(other).alias("component_id"))
    ends = pairs.select("org_id", F.inline(F.array(way("src", "dst"), way("dst", "src"))))
    near = ends.join(named.withColumnRenamed("component_id", "end").hint("shuffle_hash"), ["org_id", "end"], "left_semi").select(
        "org_id", "component_id", F.lit(0).alias("named")
    )
    reached = named.withColumn("named", F.lit(1)).unionByName(near).groupBy("org_id", "component_id").agg(
        (F.max("named") == 1).alias("is_named")
    )
    return reached.join(cards, ["org_id", "component_id"], "left_semi")


def with_writers(primary: DataFrame, touch: DataFrame, cards: DataFrame, field: str) -> DataFrame:
    """The context pack with the writers of a suspect field that have a card."""
    writers = touch.filter(F.col("field") == field).select("org_id", F.col("component").alias("component_id")).distinct()
    known = writers.join(cards, ["org_id", "component_id"], "left_semi")
    both = primary.select("org_id", "component_id", "is_named", F.lit(False).alias("writes_field")).unionByName(
        known.select("org_id", "component_id", F.lit(False).alias("is_named"), F.lit(True).alias("writes_field"))
    )
    return both.groupBy("org_id", "component_id").agg(F.bool_or("is_named").alias("is_named"), F.bool_or("writes_field").alias("writes_field"))


def object_touch(cards: DataFrame, writes: DataFrame) -> DataFrame:
    """(org, object, role, component): a class with any DML counts as writer of the objects it refers to."""
    told = cards.filter(F.col("object").isNotNull())
    code = told.filter(F.col("type").isin(*CODE_TYPES))
    dml = writes.filter("persistence = 'persisted'").select("org_id", F.col("component").alias("component_id")).distinct()

    def role(df: DataFrame, name: str) -> DataFrame:
        return df.select("org_id", "object", F.lit(name).alias("role"), "component_id")

    return (
        role(code, "read").unionByName(role(code.join(dml, ["org_id", "component_id"], "left_semi"), "write"))
        .unionByName(role(told.filter("type = 'ApexTrigger'"), "trigger"))
        .unionByName(role(told.filter("type = 'Flow'"), "flow"))
        .unionByName(role(told.filter("type = 'WorkflowFieldUpdate'"), "workflow")).distinct()
    )


def touch_counts(touch: DataFrame) -> DataFrame:
    roles = ("read", "write", "trigger", "flow", "workflow")
    return touch.groupBy("org_id", "object").agg(
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles], F.count(F.lit(1)).alias("touches")
    )


def most_referenced(counts: DataFrame, n: int = 20) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc("touches"), "object"))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def incident_objects(primary: DataFrame, cards: DataFrame, counts: DataFrame, extra: DataFrame) -> DataFrame:
    """Objects of the named components and of the log, each with its touch counts; unknown ones stay, empty."""
    own = cards.join(primary.filter("is_named"), ["org_id", "component_id"], "left_semi").select("org_id", "object")
    objects = own.unionByName(extra).filter(F.col("object").isNotNull()).distinct()
    return objects.join(counts, ["org_id", "object"], "left").na.fill(0)


def recently_changed(components: DataFrame, cards: DataFrame, manifest: DataFrame, recent_days: float = RECENT_DAYS) -> DataFrame:
    keyed = cards.join(components.select("org_id", "component_id"), ["org_id", "component_id"], "left_semi").withColumn(
        "path", manifest_key(F.col("type"), F.col("component_id"))
    )
    aged = keyed.join(manifest, ["org_id", "path"]).filter(F.col("age_seconds") / 86400.0 <= recent_days)
    return aged.select("org_id", "component_id", c.age_days(F.col("age_seconds")).alias("age_days"))


def suspect_score(
    named: Column, age_days: Column, writes_field: Column, kind: Column, has_dml: Column, has_callout: Column, is_test: Column, is_managed: Column
) -> Column:
    """Points of one component of a context pack; ``age_days`` is null unless it changed lately."""

    def points(condition: Column, value: Column | float) -> Column:
        v = value if isinstance(value, Column) else F.lit(float(value))
        return F.when(F.coalesce(condition, F.lit(False)), v).otherwise(0.0)

    return F.bround(
        points(named, 50) + points(age_days.isNotNull(), F.greatest(F.lit(5.0), F.lit(40.0) - age_days)) + points(writes_field, 35)
        + points(kind == "ApexTrigger", 15) + points(kind == "Flow", 12) + points(has_dml, 8) + points(has_callout, 8)
        + points(is_test, -40) + points(is_managed, -25), 1,
    )


def suspects(primary: DataFrame, cards: DataFrame, manifest: DataFrame, writes: DataFrame, field: str) -> DataFrame:
    """Additive score over the context pack."""
    recent = recently_changed(primary, cards, manifest)
    writers = writes.filter(F.col("field") == field).select("org_id", F.col("component").alias("component_id")).distinct().withColumn("writes_field", F.lit(True))
    dml = writes.filter("persistence = 'persisted'").select("org_id", F.col("component").alias("component_id")).distinct().withColumn("has_dml", F.lit(True))
    df = primary.join(cards, ["org_id", "component_id"])
    for part in (recent, writers, dml):
        df = df.join(part, ["org_id", "component_id"], "left")

    is_test, _how = test_verdict(F.col("component_id"), F.col("is_test_flag"))
    score = suspect_score(
        F.col("is_named"), F.col("age_days"), F.col("writes_field"), F.col("type"), F.col("has_dml"), F.col("has_callout"), is_test, F.col("is_managed")
    )
    return df.select("org_id", "component_id", "type", "age_days", score.alias("score"))


# ---- field writers ----------------------------------------------------------


def field_touch(writes: DataFrame) -> DataFrame:
    """Writers per field, one per (component, mechanism, risk, source map): the first in source order."""
    order = F.struct("write_id", "seq")
    return writes.groupBy("org_id", "field", "component", "mechanism", "risk", "source_map").agg(
        F.min(order).alias("first"), F.min_by("persistence", order).alias("persistence")
    ).select(
        "org_id", "field", "component", "mechanism", "risk", "source_map", "persistence", F.col("first.write_id").alias("write_id"),
        rank_of(F.col("risk"), RISK_IN_MAP).alias("risk_rank"),
    )


def entry_criteria(writes: DataFrame) -> DataFrame:
    return writes.filter("in_filter").select("org_id", "field", F.col("component").alias("used_by")).distinct()


def field_writers(touch: DataFrame, cards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Writers with card and recency.

    is_test_class and risk_rank order the writers of one field; the table of all is not sorted.
    """
    is_test, how = test_verdict(F.col("component"), F.col("is_test_flag"))
    info = cards.select(
        "org_id", F.col("component_id").alias("component"), "type", "is_test_flag", "namespace", "is_customer_authored",
        manifest_key(F.col("type"), F.col("component_id")).alias("path"),
    )
    return (
        touch.join(info, ["org_id", "component"], "left").join(manifest, ["org_id", "path"], "left")
        .select(
            "org_id", "field", "component", "mechanism", "risk", "source_map", "persistence", F.col("type").alias("card_type"),
            c.age_days(F.col("age_seconds")).alias("age_days"), is_test.alias("is_test_class"), how.alias("test_class_detected_by"),
            F.coalesce("is_customer_authored", F.lit(True)).alias("is_customer_authored"), "namespace",
            rank_of(F.col("risk"), RISK_IN_ANSWER).alias("risk_rank"),
        )
    )


def field_summary(writers: DataFrame) -> DataFrame:
    t = F.col("is_test_class")
    return writers.groupBy("org_id", "field").agg(
        F.count(F.lit(1)).alias("total_writers"), F.count_if(~t).alias("production_writers"),
        F.count_if(t).alias("test_class_writers"),
        F.count_if(~t & (F.col("persistence") == "persisted")).alias("production_writers_with_dml"),
    )


def suspect_fields(asked: DataFrame, summary: DataFrame) -> DataFrame:
    """Warnings for fields that only test classes write, or that nothing writes."""
    return asked.join(summary, ["org_id", "field"], "left").select(
        "org_id", "field", F.coalesce("total_writers", F.lit(0)).alias("total_writers"),
        F.when(F.col("total_writers").isNull(), "no automation writes it")
        .when(F.col("production_writers") == 0, "only test classes write it").alias("warning"),
    )


def by_mechanism(touch: DataFrame) -> DataFrame:
    order = {m: i for i, m in enumerate(MECHANISMS)}
    return touch.groupBy("org_id", "field", "mechanism").agg(F.count(F.lit(1)).alias("writers")).withColumn(
        "place", rank_of(F.col("mechanism"), order, len(order))
    )


# ---- statistics and search --------------------------------------------------


def org_statistics(cards: DataFrame, entries: DataFrame, touch: DataFrame) -> DataFrame:
    """Long list of (org, statistic, value)."""
    is_test, _how = test_verdict(F.col("component_id"), F.col("is_test_flag"))
    counts = cards.groupBy("org_id").agg(
        *[F.count_if(F.col("type") == t).alias(name) for name, (t, _k) in KINDS.items()],
        F.count_if(F.coalesce("is_test_flag", F.lit(False))).alias("test_classes"),
        F.count_if(F.col("is_customer_authored") & (F.col("type") == "Flow")).alias("customer_flows"),
        F.count_if(F.col("is_customer_authored") & F.col("type").isin("ApexClass", "ApexTrigger", "ApexInterface")).alias("customer_code"),
    )
    jobs = entries.groupBy("org_id").agg(
        *[F.countDistinct(F.when(F.col("kind") == k, F.col("component_id"))).alias(k.lower() + "_classes") for k in (*JOB_KINDS, "future")]
    )
    fields = touch.groupBy("org_id").agg(
        F.countDistinct(F.when(F.col("risk") == "high", F.col("field"))).alias("fields_with_high_risk_writes"),
        F.countDistinct(F.when(F.col("risk") == "declarative", F.col("field"))).alias("fields_written_declaratively"),
    )
    wide = counts.join(jobs, "org_id", "left").join(fields, "org_id", "left").na.fill(0)
    names = [x for x in wide.columns if x != "org_id"]
    return wide.select("org_id", F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names])))


def coverage(cards: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per kind: ok, partial (a warning names the kind), or not supported; a true zero is not "not collected"."""
    counts = cards.groupBy("org_id").agg(*[F.count_if(F.col("type") == t).alias(k) for k, (t, _w) in KINDS.items()])
    named = warnings.groupBy("org_id").agg(
        *[F.bool_or(F.lower("warning").contains(word)).alias(f"w_{k}") for k, (_t, word) in KINDS.items()]
    )
    rows = [
        F.struct(
            F.lit(k).alias("kind"), F.lit(True).alias("attempted"),
            F.when(F.coalesce(f"w_{k}", F.lit(False)), "partial").otherwise("ok").alias("status"), F.col(k).alias("count"),
        )
        for k in KINDS
    ] + [
        F.struct(
            F.lit(k).alias("kind"), F.lit(False).alias("attempted"), F.lit("not_supported").alias("status"),
            F.lit(None).cast("bigint").alias("count"),
        )
        for k in NOT_COLLECTED
    ]
    return counts.join(named, "org_id", "left").select("org_id", F.inline(F.array(*rows)))


def coverage_exceptions(cover: DataFrame) -> DataFrame:
    return cover.filter((~F.col("attempted")) | (F.col("status") != "ok"))


def search(cards: DataFrame, touch: DataFrame, fields: DataFrame, q: str, customer_only: bool = True) -> DataFrame:
    """Substring search over component ids, objects and fields; 25 of each."""
    low = q.lower()
    kept = cards.filter(F.coalesce("is_customer_authored", F.lit(True))) if customer_only else cards

    def top(df: DataFrame, name: str, section: str) -> DataFrame:
        return (
            df.filter(F.lower(name).contains(low)).select(F.lit(section).alias("section"), F.col(name).alias("name"))
            .distinct().orderBy("name").limit(SEARCH_LIMIT)
        )

    return top(kept, "component_id", "components").unionByName(top(touch, "object", "objects")).unionByName(
        top(fields, "field", "fields")
    )


def missing_sections(present: DataFrame, cards: DataFrame, wanted: list[str]) -> DataFrame:
    """Asked-for sections a card does not have; the section names are a short fixed list."""
    have = present.groupBy("org_id", "component_id").agg(F.collect_set("section").alias("have"))
    asked = F.array(*[F.lit(w) for w in wanted])
    return cards.join(have, ["org_id", "component_id"], "left").select(
        "org_id", "component_id",
        F.array_join(F.array_sort(F.array_except(asked, F.coalesce("have", F.array().cast("array<string>")))), ",").alias("missing"),
    )


def method_filter(sites: DataFrame, method: str) -> DataFrame:
    """A method's own outbound calls in order, and apart from them where its class calls it."""
    m = method.lower()
    own = sites.filter(F.lower("caller_method") == m).withColumn("part", F.lit("call_sites"))
    inside = sites.filter((F.col("kind") == "same_class") & (F.lower("method_called") == m)).withColumn(
        "part", F.lit("called_from_in_class")
    )
    return own.unionByName(inside).select("org_id", "caller", "part", "site_no", "line", "target", "method_called")


def method_items(items: DataFrame, method: str) -> DataFrame:
    """Items of the other card sections that belong to a method or call it.

    ``items``: org_id, component_id, section, item_no and, null where a section
    has none, ``names`` (the names an item goes by), ``method_called``,
    ``detail`` (a signature) and ``methods_called``.  Items of a section without
    any of these fields are not told apart by method; they are not passed here.
    """
    m = method.lower()

    def among(names: str) -> Column:
        return F.coalesce(F.exists(names, lambda x: F.coalesce(F.lower(x) == m, F.lit(False))), F.lit(False))

    hit = (
        among("names") | among("methods_called") | F.coalesce(F.lower("method_called") == m, F.lit(False))
        | F.coalesce(F.startswith(F.lower("detail"), F.lit(f"{m}(")), F.lit(False))
    )
    return items.filter(hit).select("org_id", "component_id", "section", "item_no")


def stale_cards(cards: DataFrame, present: DataFrame) -> DataFrame:
    """Class and trigger cards older than a feature they also lack."""
    have = present.groupBy("org_id", "component_id").agg(F.collect_set("section").alias("have"))
    code = cards.filter(F.col("type").isin(*CODE_TYPES)).join(have, ["org_id", "component_id"], "left")
    version = c.version_parts(F.col("extractor_version"))
    lacking = F.array_compact(F.array(*[
        F.when(
            (version < F.array(*[F.lit(int(x)) for x in since.split(".")]))
            & ~F.coalesce(F.array_contains("have", section), F.lit(False)), section,
        )
        for since, section in FEATURES
    ]))
    return code.select("org_id", "component_id", "extractor_version", F.array_join(lacking, ",").alias("missing")).filter("missing <> ''")


def org_stale(cards: DataFrame) -> DataFrame:
    """Oldest extractor version among all cards of each org."""
    oldest = cards.filter(F.col("type").isin(*CODE_TYPES)).groupBy("org_id").agg(F.min(c.version_parts(F.col("extractor_version"))).alias("v"))
    lacking = F.array_compact(F.array(*[
        F.when(F.col("v") < F.array(*[F.lit(int(x)) for x in since.split(".")]), section) for since, section in FEATURES
    ]))
    return oldest.select("org_id", F.array_join(F.col("v").cast("array<string>"), ".").alias("oldest"), F.array_join(lacking, ",").alias("missing"))
