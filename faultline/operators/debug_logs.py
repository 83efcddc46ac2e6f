"""Debug logs as tables: execution tree, queries, DML, exceptions, limits, routing.

Input is ``lines(log_id, line_no, raw)``.  Whatever depends on line order is a
scan of ``functions.scan`` over the log; ``wide=True`` spreads one log over
many tasks and is for tables in which some log is too large for one.

An operator takes the lines or events of its own section alone, or a ``Sweep``:
all running values of all sections from one ordered pass, for callers that want
several sections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.functions.scan import scan
from faultline.session import written

# ---- fixed values -----------------------------------------------------------
CLASS_FRAME = r"^Class\.([\w.]+?)(?:\.(\w+))?:\s*line\s*(\d+)"
TRIGGER_FRAME = r"^Trigger\.(\w+):\s*line\s*(\d+)"
LIMIT_HEADER = r"\|LIMIT_USAGE_FOR_NS\|([^|]*)"
LIMIT_LINE = r"^\s*(?:Number of|Maximum)\s+(.+?):\s*(\d+)\s*out of\s*(\d+)(.*)$"
DEFAULT_NS = "(default)"
DML_DETAIL = r"Op:(\w+)\|Type:(\w+)\|Rows:(\d+)"
NAME_TOKEN = r"\b[A-Za-z][A-Za-z0-9_]{2,}\b"
MISSING_FIELD = r"(?i)without querying the requested field:\s*([\w.]+?)\.(\w+)"
CALLOUT_EVENTS = ("CALLOUT_REQUEST", "CALLOUT_RESPONSE", "NAMED_CREDENTIAL_REQUEST", "NAMED_CREDENTIAL_RESPONSE")
FLOW_EVENTS = (
    "FLOW_START_INTERVIEW_BEGIN", "FLOW_START_INTERVIEW_END", "FLOW_ELEMENT_ERROR", "FLOW_FAULT_EVENT",
    "FLOW_INTERVIEW_FINISHED",
)
ROUTED = ("callouts", "user_debug", "validation_failures", "flow_events")
VALIDATION_EVENTS = ("VALIDATION_RULE", "VALIDATION_FAIL", "VALIDATION_FORMULA")
# begin and end event of each kind of stack
STACKS = {
    "unit": ("CODE_UNIT_STARTED", "CODE_UNIT_FINISHED"),
    "soql": ("SOQL_EXECUTE_BEGIN", "SOQL_EXECUTE_END"),
    "dml": ("DML_BEGIN", "DML_END"),
}
# read beside the stacks, each inside the code unit that is innermost
METHOD_EVENTS = ["METHOD_ENTRY", "METHOD_EXIT"]
EVIDENCE_EVENTS = ["CONSTRUCTOR_ENTRY", "SYSTEM_METHOD_ENTRY", "EXCEPTION_THROWN"]
# -----------------------------------------------------------------------------


def events(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their fields; ``evt`` is null for lines without a bar."""
    rows = lines.filter(F.trim("raw") != "").withColumn("parts", F.split("raw", r"\|"))
    return rows.select(
        "log_id", "line_no", "raw", "parts", F.size("parts").alias("n_parts"),
        F.try_element_at("parts", F.lit(2)).alias("evt"), F.element_at("parts", -1).alias("last_part"),
    )


# sections of a normalized log; those about jobs exist where something async showed up
JOB_SECTIONS = ("async_presence", "dispatches", "failed_async_limit", "job_constructions")
SECTIONS = (
    "meta", "context", "execution_units", "exceptions", "soql_summary", "dml_summary", *ROUTED, "limits_by_namespace", "limits_final", "involved_components",
    "missing_fields", *JOB_SECTIONS, "visibility",
)


@dataclass
class Sweep:
    """What one ordered pass over the lines finds, written to the shared folder.

    ``lines``: every line with its event, length, the header of the frame run
    it is in, the exception before it and its limit block.  ``stacks``: begin,
    end and method events with their level and ``opened``, the begin row
    (line_no, text) of the entry they close or are in.
    """

    lines: DataFrame
    stacks: DataFrame


def of(rows: DataFrame | Sweep, *names: str) -> DataFrame:
    rows = rows.lines if isinstance(rows, Sweep) else rows
    return rows.filter(F.col("evt").isin(*names))


def last_field(least: int, otherwise: Column | str = "") -> Column:
    """The last field where the line has enough of them."""
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.when(F.col("n_parts") >= least, F.col("last_part")).otherwise(fallback)


def _payload(kind: str) -> Column:
    """What the begin row of a stack tells of its entry."""
    if kind == "dml":
        return F.when(F.col("n_parts") >= 3, F.array_join(F.slice("parts", 3, F.col("n_parts")), "|")).otherwise("")
    return last_field(4 if kind == "soql" else 3)


def _is_frame() -> Column:
    return _trimmed().rlike(CLASS_FRAME) | _trimmed().rlike(TRIGGER_FRAME)


def _trimmed() -> Column:
    return F.regexp_replace("raw", r"^\s+|\s+$", "")


def _limit_namespace() -> Column:
    """The namespace a limit header opens, null for every other line."""
    ns = F.trim(F.regexp_extract("raw", LIMIT_HEADER, 1))
    return F.when(F.col("raw").rlike(LIMIT_HEADER), F.when(ns == "", DEFAULT_NS).otherwise(ns))


def sweep(lines: DataFrame, wide: bool = False) -> Sweep:
    """One scan over all lines for every section, then one over the stack events for their pairs.

    The stacks are independent sums in the same scan; a line belongs to one of
    them at most, so one scan by (log, stack, level) pairs them all.
    """
    evt = F.col("evt")
    rows = lines.withColumn("parts", F.split("raw", r"\|")).select(
        "log_id", "line_no", "raw", "parts", F.size("parts").alias("n_parts"),
        F.try_element_at("parts", F.lit(2)).alias("evt"), F.element_at("parts", -1).alias("last_part"),
        F.length("raw").alias("chars"), (F.trim("raw") == "").alias("is_blank"), _is_frame().alias("is_frame"), _limit_namespace().alias("own_ns"),
    )
    kind, step = F.lit(None).cast("string"), F.lit(0)
    sums = {"others": F.coalesce(evt == "EXCEPTION_THROWN", F.lit(False)).cast("int"), "block": F.col("own_ns").isNotNull().cast("int")}
    for name, (begin, end) in STACKS.items():
        sums[f"{name}_total"] = F.when(evt == begin, 1).when(evt == end, -1).otherwise(0)
        kind = F.when(evt.isin(begin, end), name).otherwise(kind)
        step = F.when(evt == begin, 1).when(evt == end, -1).otherwise(step)
    kind = F.when(evt.isin(*METHOD_EVENTS, *EVIDENCE_EVENTS), "unit").otherwise(kind)
    own = F.struct("line_no", "evt")
    swept = scan(
        rows.withColumn("of_stack", kind).withColumn("step", step), ["log_id"], "line_no", sums=sums,
        lows={f"{name}_low": f"{name}_total" for name in STACKS},
        lasts={"head": F.when(~F.col("is_frame") & ~F.col("is_blank"), own), "seen_ns": F.col("own_ns")},
        prevs={"prior": F.when(evt.isin("EXCEPTION_THROWN", "FATAL_ERROR"), own)}, wide=wide,
    )
    before, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for name in STACKS:
        mine = F.col("of_stack") == name
        before = F.when(mine, F.col(f"{name}_total") - F.col("step") - F.col(f"{name}_low")).otherwise(before)
        text = F.when(mine & (F.col("step") == 1), _payload(name)).otherwise(text)
    swept = swept.withColumn("open_before", before).withColumn("text", text)
    swept = written(swept.drop(*[f"{name}_{x}" for name in STACKS for x in ("total", "low")]), "log-lines")
    marked = swept.filter("of_stack IS NOT NULL").select(
        "log_id", "line_no", "evt", "parts", "n_parts", "last_part", "of_stack", "step", "open_before", "others", "text",
        F.when(F.col("step") == 1, F.col("open_before")).when(F.col("open_before") > 0, F.col("open_before") - 1).alias("level"),
    )
    opened = F.when(F.col("step") == 1, F.struct("line_no", "text"))
    known = scan(marked.filter("level IS NOT NULL"), ["log_id", "of_stack", "level"], "line_no", lasts={"opened": opened}, wide=wide)
    loose = marked.filter("level IS NULL").withColumn("opened", F.lit(None).cast(known.schema["opened"].dataType))
    return Sweep(swept, written(known.unionByName(loose).drop("text"), "log-stacks"))


def levelled(rows: DataFrame | Sweep, kind: str, extra: list[str] | None = None, wide: bool = False) -> DataFrame:
    """Begin and end rows of one stack with the level each belongs to.

    Adds ``step`` (+1 begin, -1 end, 0 other), ``open_before`` (entries open
    when the row is read) and ``level``: for a begin its depth, for an end the
    depth of the entry it closes.  An end with nothing open has no level.
    """
    begin, end = STACKS[kind]
    if isinstance(rows, Sweep):
        return rows.stacks.filter(F.col("evt").isin(begin, end, *(extra or [])))
    marked = of(rows, begin, end, *(extra or [])).withColumn(
        "step", F.when(F.col("evt") == begin, 1).when(F.col("evt") == end, -1).otherwise(0)
    )
    sums = {"total": F.col("step")}
    if extra:
        sums["others"] = (F.col("step") == 0).cast("int")
    swept = scan(marked, ["log_id"], "line_no", sums=sums, lows={"lowest": "total"}, wide=wide)
    before = F.col("total") - F.col("step") - F.col("lowest")
    level = (
        F.when(F.col("step") == 1, before).when((F.col("step") == -1) & (before > 0), before - 1)
    )
    return swept.withColumn("open_before", before).withColumn("level", level).drop("total", "lowest")


def matched(levels: DataFrame, kind: str, wide: bool = False) -> DataFrame:
    """End rows, each with ``opened`` (line_no, text) of the begin row it closes, null for an unmatched end."""
    if "opened" in levels.columns:
        return levels.filter("step = -1")
    payload = F.struct("line_no", _payload(kind).alias("text"))
    known = levels.filter(F.col("level").isNotNull())
    paired = scan(
        known, ["log_id", "level"], "line_no", lasts={"opened": F.when(F.col("step") == 1, payload)}, wide=wide
    ).filter("step = -1")
    loose = levels.filter((F.col("step") == -1) & F.col("level").isNull())
    return paired.unionByName(loose, allowMissingColumns=True)


def execution_units(rows: DataFrame | Sweep, wide: bool = False) -> DataFrame:
    """Code units with depth, and whether an exception was thrown while they were open."""
    levels = levelled(rows, "unit", ["EXCEPTION_THROWN"], wide)
    starts = levels.filter("step = 1").select(
        "log_id", "line_no", last_field(3).alias("label"), F.col("level").cast("bigint").alias("depth"),
        F.col("others").alias("seen"),
    )
    ends = matched(levels.filter("step <> 0"), "unit", wide).filter(F.col("opened").isNotNull()).select(
        F.col("log_id").alias("e_log"), F.col("opened.line_no").alias("e_line"), F.col("others").alias("at_end"),
    )
    totals = levels.groupBy(F.col("log_id").alias("t_log")).agg(F.max("others").alias("at_last"))
    joined = starts.join(ends, (F.col("log_id") == F.col("e_log")) & (F.col("line_no") == F.col("e_line")), "left")
    joined = joined.join(totals, F.col("log_id") == F.col("t_log"), "left")
    return joined.select(
        "log_id", "line_no", "label", "depth",
        (F.coalesce("at_end", "at_last") > F.col("seen")).alias("had_exception"),
    )


def unit_runs(units: DataFrame, wide: bool = False) -> DataFrame:
    """Consecutive equal units as one row with ``repeat``."""
    same = F.struct("label", "depth", "had_exception")
    seen = scan(units, ["log_id"], "line_no", prevs={"prior": same}, wide=wide)
    marked = seen.withColumn("fresh", (~same.eqNullSafe(F.col("prior"))).cast("int"))
    runs = scan(marked, ["log_id"], "line_no", sums={"run": F.col("fresh")}, wide=wide)
    return runs.groupBy("log_id", "run").agg(
        F.min("line_no").alias("line_no"), F.first("label").alias("label"), F.first("depth").alias("depth"),
        F.first("had_exception").alias("had_exception"), F.count(F.lit(1)).alias("repeat"),
    )


def query_events(rows: DataFrame | Sweep, wide: bool = False) -> DataFrame:
    """One row per query end, with the text of the begin it closes (last in, first out)."""
    ends = matched(levelled(rows, "soql", wide=wide), "soql", wide)
    query = F.coalesce("opened.text", F.lit(""))
    found = F.regexp_extract(F.col("last_part"), r"Rows:(\d+)", 1)
    return ends.select(
        "log_id", "line_no", c.mask_literals(query).alias("signature"), c.query_object(query).alias("object"),
        F.when((F.col("n_parts") >= 3) & (found != ""), found).cast("bigint").alias("rows"),
        c.truncate(query, 150).alias("raw_example"), query.alias("query"),
    )


def query_summary(queries: DataFrame) -> DataFrame:
    """Queries collapsed by masked text; the first one is the example."""
    return queries.groupBy("log_id", "signature").agg(
        F.count(F.lit(1)).alias("occurrences"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.min_by("object", "line_no").alias("object"), F.min_by("raw_example", "line_no").alias("raw_example"),
        F.min("line_no").alias("first_line"),
    )


def dml_events(rows: DataFrame | Sweep, wide: bool = False) -> DataFrame:
    ends = matched(levelled(rows, "dml", wide=wide), "dml", wide)
    text = F.coalesce("opened.text", F.lit(""))
    op = F.regexp_extract(text, DML_DETAIL, 1)
    fine = op != ""
    return ends.select(
        "log_id", "line_no", F.when(fine, op).otherwise("Unknown").alias("operation"),
        F.when(fine, F.regexp_extract(text, DML_DETAIL, 2)).alias("object"),
        F.when(fine, F.regexp_extract(text, DML_DETAIL, 3)).cast("bigint").alias("rows"),
    )


def dml_summary(dml: DataFrame) -> DataFrame:
    return dml.groupBy("log_id", "operation", "object").agg(
        F.count(F.lit(1)).alias("occurrences"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.min("line_no").alias("first_line"),
    )


def thrown(rows: DataFrame | Sweep, wide: bool = False) -> DataFrame:
    """Exceptions in log order, each with the stack of the fatal error that belongs to it.

    A stack is the run of frame lines after a FATAL_ERROR, and counts only if
    another line follows the run.  It belongs to the last EXCEPTION_THROWN
    since the fatal error before; without one the fatal line is an exception
    of its own.  The frames of one run become one text, so a run must fit a row.
    """
    if isinstance(rows, Sweep):
        marks = headed = rows.lines.filter(~F.col("is_blank"))
    else:
        marks = rows.withColumn("is_frame", _is_frame())
        headed = scan(
            marks, ["log_id"], "line_no",
            lasts={"head": F.when(~F.col("is_frame"), F.struct("line_no", "evt"))}, wide=wide,
        )
    stacks = (
        headed.filter(F.col("is_frame") & (F.col("head.evt") == "FATAL_ERROR"))
        .groupBy(F.col("log_id").alias("s_log"), F.col("head.line_no").alias("s_line"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", _trimmed().alias("frame")))).alias("frames"))
        .withColumn("stack", F.array_join(F.col("frames.frame"), "\n")).drop("frames")
    )
    ends = marks.filter(~F.col("is_frame")).groupBy(F.col("log_id").alias("z_log")).agg(F.max("line_no").alias("z_line"))
    both = of(rows, "EXCEPTION_THROWN", "FATAL_ERROR").withColumn(
        "message", last_field(3, F.when(F.col("evt") == "FATAL_ERROR", F.col("raw")).otherwise(""))
    )
    if not isinstance(rows, Sweep):
        both = scan(both.select("log_id", "line_no", "evt", "message"), ["log_id"], "line_no", prevs={"prior": F.struct("line_no", "evt")}, wide=wide)
    fatal = both.filter("evt = 'FATAL_ERROR'").withColumn(
        "owner", F.when(F.col("prior.evt") == "EXCEPTION_THROWN", F.col("prior.line_no")).otherwise(F.col("line_no"))
    )
    owned = (
        fatal.join(stacks, (F.col("log_id") == F.col("s_log")) & (F.col("line_no") == F.col("s_line")))
        .join(ends, F.col("log_id") == F.col("z_log")).filter(F.col("z_line") > F.col("line_no"))
        .select(F.col("log_id").alias("o_log"), F.col("owner").alias("o_line"), "stack")
    )
    own = both.filter((F.col("evt") == "EXCEPTION_THROWN") | ~F.coalesce(F.col("prior.evt") == "EXCEPTION_THROWN", F.lit(False)))
    return own.join(owned, (F.col("log_id") == F.col("o_log")) & (F.col("line_no") == F.col("o_line")), "left").select(
        "log_id", "line_no", F.trim(F.split("message", ":")[0]).alias("type"), "message",
        F.coalesce("stack", F.lit("")).alias("stack"),
    )


def exceptions(raised: DataFrame) -> DataFrame:
    return raised.groupBy("log_id", "type", "message", "stack").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("occurrences")
    )


def limits(lines: DataFrame | Sweep, wide: bool = False) -> DataFrame:
    """Last checkpoint per namespace, with the peak where some checkpoint was higher."""
    told = F.col("own_ns").isNotNull() | F.col("raw").rlike(LIMIT_LINE)
    if isinstance(lines, Sweep):
        swept = lines.lines.filter(told)
    else:
        rows = lines.select("log_id", "line_no", "raw", _limit_namespace().alias("own_ns")).filter(told)
        swept = scan(
            rows, ["log_id"], "line_no", sums={"block": F.col("own_ns").isNotNull().cast("int")}, lasts={"seen_ns": F.col("own_ns")}, wide=wide
        )
    swept = swept.withColumn("is_header", F.col("own_ns").isNotNull()).withColumn("namespace", F.coalesce("seen_ns", F.lit(DEFAULT_NS)))
    spaces = swept.groupBy("log_id", "namespace").agg(F.max("block").alias("last_block"), F.min("line_no").alias("first_line"))
    close = F.upper(F.regexp_extract("raw", LIMIT_LINE, 4)).contains("CLOSE TO LIMIT")
    items = swept.filter(~F.col("is_header")).select(
        "log_id", "namespace", "block", "line_no", F.trim(F.regexp_extract("raw", LIMIT_LINE, 1)).alias("name"),
        F.regexp_extract("raw", LIMIT_LINE, 2).cast("bigint").alias("used"),
        F.regexp_extract("raw", LIMIT_LINE, 3).cast("bigint").alias("max"), close.alias("close_to_limit"),
    )
    per_block = items.groupBy("log_id", "namespace", "name", "block").agg(
        F.max_by(F.struct("used", "max", "close_to_limit"), "line_no").alias("entry"), F.max("used").alias("peak")
    )
    latest = per_block.groupBy("log_id", "namespace", "name").agg(
        F.max_by("entry", "block").alias("entry"), F.max("block").alias("block"), F.max("peak").alias("peak")
    )
    final = latest.join(spaces, ["log_id", "namespace"]).filter("block = last_block")
    # the customer's own namespace, or the first seen where that is empty or absent
    shown = spaces.groupBy("log_id").agg(F.min_by("namespace", "first_line").alias("first_ns")).join(
        final.filter(F.col("namespace") == DEFAULT_NS).select("log_id").distinct().withColumn("has_default", F.lit(True)),
        "log_id", "left",
    ).select("log_id", F.when(F.col("has_default"), DEFAULT_NS).otherwise(F.col("first_ns")).alias("final_ns"))
    return final.join(shown, "log_id").select(
        "log_id", "namespace", "name", "entry.used", "entry.max", "entry.close_to_limit",
        F.when(F.col("peak") > F.col("entry.used"), F.col("peak")).alias("peak_used"),
        (F.col("namespace") == F.col("final_ns")).alias("is_final"),
    )


def routed(rows: DataFrame | Sweep) -> DataFrame:
    """Callouts, debug lines, validation failures and flow events, with their shown text."""
    rows = rows.lines if isinstance(rows, Sweep) else rows
    evt = F.col("evt")
    validation = evt.isin(*VALIDATION_EVENTS) & (evt.contains("FAIL") | (evt == "VALIDATION_RULE"))
    section = (
        F.when(evt.isin(*CALLOUT_EVENTS), "callouts").when(evt == "USER_DEBUG", "user_debug")
        .when(validation, "validation_failures").when(evt.isin(*FLOW_EVENTS), "flow_events")
    )
    text = (
        F.when(F.col("section") == "user_debug", F.when(F.col("n_parts") >= 4, c.truncate(F.col("last_part"), 300)).otherwise(F.col("raw")))
        .when(F.col("section") == "validation_failures", c.truncate(F.col("raw"), 200))
        .otherwise(F.when(F.col("n_parts") >= 3, c.truncate(F.col("last_part"), 200)).otherwise(""))
    )
    return rows.withColumn("section", section).filter(F.col("section").isNotNull()).select(
        "log_id", "line_no", "section", "evt", text.alias("detail")
    )


def entry_units(units: DataFrame) -> DataFrame:
    """The unit a transaction entered by, and whether it looks like an async job."""
    top = units.filter("depth = 0").groupBy("log_id").agg(F.min_by("label", "line_no").alias("entry_unit"))
    return top.withColumn(
        "likely_async", F.col("entry_unit").rlike(c.JOB_NAME) & ~F.col("entry_unit").contains("__sfdc_trigger")
    )


def _named_texts(units: DataFrame, raised: DataFrame) -> DataFrame:
    return units.select("log_id", F.col("label").alias("text")).unionByName(
        raised.select("log_id", F.concat_ws(" ", "message", "stack").alias("text"))
    )


def involved_components(units: DataFrame, raised: DataFrame, ids: DataFrame | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Component names in unit labels, messages and stacks; with no org, those that begin with one of ``prefixes``."""
    tokens = _named_texts(units, raised).select(
        "log_id", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME_TOKEN), 0))).alias("component_id")
    ).filter("component_id IS NOT NULL").distinct()
    if ids is None:
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | F.col("component_id").startswith(p)
        return tokens.filter(cond)
    return tokens.join(ids.select("component_id"), "component_id", "left_semi").select("log_id", "component_id")


def missing_field_evidence(raised: DataFrame, summary: DataFrame) -> DataFrame:
    """Fields named as not queried, against each query of the log on that object."""
    pairs = raised.select(
        "log_id", F.explode(F.regexp_extract_all("message", F.lit(MISSING_FIELD), 0)).alias("hit")
    ).select(
        "log_id", F.regexp_extract("hit", MISSING_FIELD, 1).alias("object"), F.regexp_extract("hit", MISSING_FIELD, 2).alias("field"),
    ).distinct().select(F.col("log_id").alias("w_log"), F.lower("object").alias("w_object"), "field")
    listed = F.transform(
        F.split(F.regexp_extract("signature", r"(?is)^SELECT\s(.*?)\sFROM\s", 1), ","), lambda f: F.lower(F.trim(f))
    )
    joined = summary.join(pairs, (F.col("log_id") == F.col("w_log")) & (F.lower("object") == F.col("w_object")))
    return joined.select(
        "log_id", "signature", "object", "field",
        F.when(F.array_contains(listed, F.lower("field")), "INCLUDES").otherwise("DOES NOT include").alias("verdict"),
    )


def log_meta(found: Sweep, units: DataFrame, raised: DataFrame, components: DataFrame) -> DataFrame:
    size = found.lines.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("lines"), F.bround(F.sum(F.col("chars") + 1) / 1024.0, 1).alias("size_kb")
    )
    distinct = exceptions(raised).groupBy("log_id").agg(
        F.count(F.lit(1)).alias("exception_count"), F.min_by("type", "first_line").alias("top_exception")
    )
    n_units = units.groupBy("log_id").agg(F.count(F.lit(1)).alias("execution_unit_count"))
    n_parts = components.groupBy("log_id").agg(F.count(F.lit(1)).alias("component_count"))
    out = size
    for part in (distinct, n_units, n_parts):
        out = out.join(part, "log_id", "left")
    return out.na.fill(0, ["exception_count", "execution_unit_count", "component_count"])


def visibility(headers: DataFrame, rows: DataFrame | Sweep) -> DataFrame:
    """What the log levels and managed code hide."""
    managed = of(rows, "ENTERING_MANAGED_PKG").groupBy("log_id").agg(F.count(F.lit(1)).alias("managed_entries"))
    levels = F.col("levels")
    return (
        headers.withColumn("levels", c.header_levels(F.col("header"))).join(managed, "log_id", "left")
        .select(
            "log_id", c.header_version(F.col("header")).alias("api_version"),
            F.size(F.map_keys("levels")).cast("bigint").alias("n_levels"),
            (~F.coalesce(c.level_at_least(levels, "APEX_CODE", "FINE"), F.lit(False))).alias("code_below_fine"),
            (~F.coalesce(c.level_at_least(levels, "SYSTEM", "FINE"), F.lit(False))).alias("system_below_fine"),
            F.coalesce("managed_entries", F.lit(0)).alias("managed_entries"),
        )
    )


def section_sizes(**sections: DataFrame) -> DataFrame:
    """Rows per log and section: the shape of a whole normalised log."""
    out = None
    for name, df in sections.items():
        part = df.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def section_page(section: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """One page per log with its total and the offset of the next page."""
    total = section.groupBy("log_id").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy("log_id").orderBy(order))
    page = section.withColumn("position", place).filter(F.col("position") <= offset + limit).filter(F.col("position") > offset)
    # a page past the end is empty, but still tells the total
    return total.join(page, "log_id", "left").withColumn("position", F.col("position") - 1).withColumn(
        "next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit))
    )


def missing_sections(logs: DataFrame, presence: DataFrame, wanted: list[str]) -> DataFrame:
    """Asked-for sections a log does not have: unknown names, and those about jobs where nothing async showed up."""
    unknown = sorted({w for w in wanted if w not in SECTIONS})
    absent = sorted(set(wanted) & set(JOB_SECTIONS))
    rows = logs.select("log_id").join(presence.select("log_id", F.lit(True).alias("has_jobs")), "log_id", "left")
    gone = F.when(F.col("has_jobs"), F.lit(",".join(unknown))).otherwise(",".join(sorted([*unknown, *absent])))
    available = F.when(F.col("has_jobs"), ",".join(sorted(SECTIONS))).otherwise(",".join(sorted(set(SECTIONS) - set(JOB_SECTIONS))))
    return rows.select("log_id", gone.alias("missing"), F.when(gone != "", available).alias("available"))


def split_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts to numbered lines: the header apart, blank lines dropped, CRLF accepted."""
    lines = texts.select(key, F.posexplode_outer(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "raw"))
    return lines.filter((F.col("line_no") == 0) | (F.trim("raw") != "")).withColumn("is_header", F.col("line_no") == 0)
