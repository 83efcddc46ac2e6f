"""Fitting results into a character budget: logs, cards, search results, query texts.

Budgets are counted in characters of compact JSON.  A budget also bounds the
work: of any list, only the prefix that can fit at all is ever looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scan import CHUNK_ROWS, number_rows
from faultline.operators import debug_logs as logs

# ---- fixed values -----------------------------------------------------------
SECTION_ORDER = (
    "header exceptions async_jobs limits_final limits_by_namespace validation_failures flow_events involved_components "
    "dml_summary callouts execution_units soql_summary user_debug"
).split()
SELECTION = {
    "exceptions": "head", "validation_failures": "head", "flow_events": "head", "involved_components": "head", "callouts": "head",
    "dml_summary": "heavy", "soql_summary": "heavy", "execution_units": "units", "user_debug": "tail",
}
CARD_PRIORITY = (
    "entry_points flags calls_to call_sites async_dispatches callouts named_credentials dml exceptions_thrown exceptions_caught "
    "custom_exceptions_defined static_mutable_state objects_referenced methods"
).split()
CARD_TAIL = ("soql", "field_writes")
NOTE_RESERVE, CARD_RESERVE, FIELD_LIST_MIN = 1400, 900, 200
CONTENT_STEPS = (6000, 3500, 2200, 1400, 900, 550, 300)
CUT_MARK = " [...]"
MISSING = "DOES NOT include"
# -----------------------------------------------------------------------------


def section_rank(section: Column, order: list[str], last: tuple[str, ...] = ()) -> Column:
    out = F.lit(len(order))
    for i, name in enumerate(order):
        out = F.when(section == name, i).otherwise(out)
    for i, name in enumerate(last):
        out = F.when(section == name, len(order) + 1 + i).otherwise(out)
    return out


def need(section: Column, size: Column) -> Column:
    return size + F.length(section) + 6


def pack_cards(
    items: DataFrame, keys: list[str], max_chars: int, wide: bool = False, order: tuple[str, ...] = ("item_no",), bucket: Column | None = None
) -> DataFrame:
    """Sections of a card in priority order, whole while they fit, else the first items that do.

    ``items``: keys, section, size, and the columns of ``order``.  ``bucket``
    must grow with the order: with ``wide``, rows are added up inside their
    bucket, in one exchange, and only a row for each bucket goes further.
    """
    if bucket is None:
        bucket = F.floor(F.col(order[0]) / F.lit(CHUNK_ROWS))
    rows = items.withColumn("__b", bucket if wide else F.lit(0))
    inside = Window.partitionBy(*keys, "section", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum(F.col("size") + 2).over(inside))
    # a prefix longer than the budget can never be shown, so what is collected is bounded by it
    chunks = rows.groupBy(*keys, "section", "__b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.col("size") + 2).alias("upto"),
        F.collect_list(F.when(F.col("upto") <= max_chars, F.col("upto"))).alias("prefix"),
    )
    # dealt by card: nothing below needs another exchange
    chunks = chunks.repartition(*keys)
    above = Window.partitionBy(*keys, "section").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("upto").over(above), F.lit(0)))
    has_keys = F.lit(True)
    for k in keys:
        has_keys = has_keys & F.col(k).isNotNull()
    fitting = F.filter(F.transform("prefix", lambda p: p + F.col("before")), lambda p: p <= max_chars)
    # without a key there is no card to show items of
    chunks = chunks.withColumn("fitting", F.when(has_keys, fitting).otherwise(F.array().cast("array<bigint>")))
    rows = chunks.groupBy(*keys, "section").agg(
        F.sum("n").alias("total"), (F.sum("size") + F.sum("n") * 2 + 2).alias("whole_size"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.size("fitting") > 0, F.col("fitting"))))).alias("prefix"),
    ).withColumn("rank", section_rank(F.col("section"), list(CARD_PRIORITY), CARD_TAIL))
    # a card has a few dozen sections at most
    cards = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "section", "total", "whole_size", "prefix"
        ))).alias("sections"),
    )
    start = F.struct(
        F.lit(max_chars - CARD_RESERVE).cast("bigint").alias("budget"),
        F.array().cast("array<struct<section:string,total:bigint,shown:bigint>>").alias("out"),
    )

    def take(acc: Column, s: Column) -> Column:
        cost = need(s["section"], s["whole_size"])
        whole = cost <= acc["budget"]
        kept = F.filter(s["prefix"], lambda p: p + 2 <= acc["budget"])
        shown = F.when(whole, s["total"]).otherwise(F.size(kept).cast("bigint"))
        used = F.when(whole, cost).otherwise(F.coalesce(F.array_max(kept), F.lit(0)) + 2 + F.length(s["section"]) + 6)
        return F.struct(
            F.greatest(F.lit(0).cast("bigint"), acc["budget"] - used).alias("budget"),
            F.array_append(acc["out"], F.struct(s["section"].alias("section"), s["total"].alias("total"), shown.alias("shown"))).alias("out"),
        )

    fits = F.aggregate("sections", F.lit(0).cast("bigint"), lambda a, s: a + need(s["section"], s["whole_size"])) <= max_chars
    everything = F.transform("sections", lambda s: F.struct(s["section"].alias("section"), s["total"].alias("total"), s["total"].alias("shown")))
    chosen = F.when(fits, everything).otherwise(F.aggregate("sections", start, take)["out"])
    return cards.select(*keys, F.inline(chosen))


def section_caps(sizes: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Water-filling: small sections get what they need, the rest share what is left.

    ``sizes``: keys, section, size; at most a dozen sections per key.
    """
    grouped = sizes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(need(F.col("section"), F.col("size")).alias("need"), "section"))).alias("pending")
    )
    start = F.struct(
        F.lit(max(budget, 0)).cast("bigint").alias("left"), F.size("pending").cast("bigint").alias("n"),
        F.array().cast("array<struct<section:string,need:bigint,cap:bigint>>").alias("caps"),
    )

    def share(acc: Column, s: Column) -> Column:
        cap = F.least(s["need"], F.floor(acc["left"] / acc["n"]))
        return F.struct(
            (acc["left"] - cap).alias("left"), (acc["n"] - 1).alias("n"),
            F.array_append(acc["caps"], F.struct(s["section"].alias("section"), s["need"].alias("need"), cap.alias("cap"))).alias("caps"),
        )

    return grouped.select(*keys, F.inline(F.aggregate("pending", start, share)["caps"]))


def watched_fields(raised: DataFrame) -> DataFrame:
    """(log_id, object, watched): fields that exceptions name as not queried, by object in lower case; a handful per object."""
    hit = F.explode(F.regexp_extract_all("message", F.lit(logs.MISSING_FIELD), 0))
    named = raised.select("log_id", hit.alias("hit")).select(
        "log_id", F.lower(F.regexp_extract("hit", logs.MISSING_FIELD, 1)).alias("object"), F.regexp_extract("hit", logs.MISSING_FIELD, 2).alias("field")
    )
    return named.groupBy("log_id", "object").agg(F.array_sort(F.collect_set("field")).alias("watched"))


def log_items(found: logs.Sweep, component_ids: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """The items of every list section of a log as ``pack_logs`` takes them, compacted first.

    Equal units in a row are one item with ``repeat``; long SELECT lists are
    ``<N fields>``, with the fields an exception missed told apart.  Sizes are
    those of compact JSON.
    """
    none = F.lit(0).cast("bigint")

    def part(rows: DataFrame, section: Column | str, pos: str, size: Column, by: tuple[str, str] | None = None, urgent: Column | None = None) -> DataFrame:
        return rows.select(
            "log_id", (section if isinstance(section, Column) else F.lit(section)).alias("section"), F.col(pos).cast("bigint").alias("pos"), size.alias("size"),
            (F.col(by[0]) if by else none).alias("weight_rows"), (F.col(by[1]) if by else none).alias("weight_count"),
            (F.lit(False) if urgent is None else urgent).alias("urgent"),
        )

    units, raised = logs.execution_units(found, wide), logs.thrown(found, wide)
    runs = logs.unit_runs(units, wide).withColumn("repeat", F.when(F.col("repeat") > 1, F.col("repeat")))
    queries = logs.query_summary(logs.query_events(found, wide))
    seen = watched_fields(raised).select(F.col("log_id").alias("w_log"), F.col("object").alias("w_object"), "watched")
    queries = queries.join(seen, (F.col("log_id") == F.col("w_log")) & (F.lower("object") == F.col("w_object")), "left").drop("w_log", "w_object")
    queries = queries.withColumn("watched", F.coalesce("watched", F.array().cast("array<string>")))
    queries = compact_queries(queries, "signature", F.col("watched")).withColumn("signature", F.col("compacted"))
    named = logs.involved_components(units, raised, component_ids)
    # names are numbered in order within their first two characters
    named = number_rows(named, ["log_id"], F.substring("component_id", 1, 2), [F.col("component_id")], "place", wide)

    def json(*names: str) -> Column:
        return F.length(F.to_json(F.struct(*names)))

    weights = ("total_rows", "occurrences")
    sections = [
        part(runs, "execution_units", "line_no", json("label", "depth", "had_exception", "repeat"), urgent=F.col("had_exception") | (F.col("depth") == 0)),
        part(logs.exceptions(raised), "exceptions", "first_line", json("type", "message", "stack", "occurrences")),
        part(queries, "soql_summary", "first_line", json("signature", "object", "occurrences", "total_rows"), weights),
        part(logs.dml_summary(logs.dml_events(found, wide)), "dml_summary", "first_line", json("operation", "object", "occurrences", "total_rows"), weights),
        part(logs.routed(found), F.col("section"), "line_no", F.length("detail") + 2),
        part(named, "involved_components", "place", F.length("component_id") + 2),
    ]
    out = sections[0]
    for more in sections[1:]:
        out = out.unionByName(more)
    return out


def pack_logs(items: DataFrame, max_chars: int) -> DataFrame:
    """Items of every log that fit the budget, chosen as each section chooses.

    ``items``: log_id, section, pos, size, weight_rows, weight_count, urgent.
    Sections that fit are kept whole.  The others are read once in order of
    preference: head and tail stop at the first misfit, the rest skip it,
    which is sequential, so partitions sorted by that order stream through a
    small loop that holds one number per section.
    """
    sizes = items.groupBy("log_id", "section").agg((F.sum(F.col("size") + 1) + 1).alias("size"), F.count(F.lit(1)).alias("total"))
    caps = section_caps(sizes.select("log_id", "section", "size"), ["log_id"], max_chars - NOTE_RESERVE)
    rows = items.join(caps, ["log_id", "section"])
    whole = rows.filter("need <= cap").select("log_id", "section", "pos")
    mode = F.lit("head")
    for name, m in SELECTION.items():
        mode = F.when(F.col("section") == name, m).otherwise(mode)
    cut = rows.filter("need > cap").withColumn("mode", mode).withColumn("room", F.col("cap") - F.length("section") - 6)
    first = F.when(F.col("mode") == "heavy", -F.coalesce("weight_rows", F.lit(0))).when(
        (F.col("mode") == "units") & ~F.col("urgent"), 1).otherwise(0)
    second = F.when(F.col("mode") == "heavy", -F.coalesce("weight_count", F.lit(0))).when(F.col("mode") == "tail", -F.col("pos")).otherwise(F.col("pos"))
    ordered = cut.select(
        "log_id", "section", "pos", "size", "room", F.col("mode").isin("head", "tail").alias("gapless"), first.alias("a"), second.alias("b")
    ).repartition("log_id", "section").sortWithinPartitions("log_id", "section", "a", "b", "pos")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, open_ = None, 2, True
        for pdf in batches:
            out = []
            for log, section, pos, size, room, gapless in zip(pdf["log_id"], pdf["section"], pdf["pos"], pdf["size"], pdf["room"], pdf["gapless"]):
                if (log, section) != group:
                    group, used, open_ = (log, section), 2, True
                if open_ and used + size + 2 <= room:
                    used += size + 2
                    out.append((log, section, pos))
                elif gapless:
                    open_ = False
            yield pd.DataFrame(out, columns=["log_id", "section", "pos"])

    kept = whole.unionByName(ordered.mapInPandas(choose, "log_id bigint, section string, pos bigint"))
    return kept


def pack_report(items: DataFrame, kept: DataFrame) -> DataFrame:
    """Per log and section: how many items there are and how many are shown."""
    total = items.groupBy("log_id", "section").agg(F.count(F.lit(1)).alias("total"))
    shown = kept.groupBy("log_id", "section").agg(F.count(F.lit(1)).alias("shown"))
    return total.join(shown, ["log_id", "section"], "left").na.fill(0, ["shown"])


# ---- search results ---------------------------------------------------------


def merged_hits(hits: DataFrame) -> DataFrame:
    """One row per document: the first hit, and the other queries that found it too."""
    order = F.struct("hit_no")
    first = hits.groupBy("key").agg(
        F.min_by(F.struct("query", "title", "score"), order).alias("h"), F.count(F.lit(1)).alias("hits"), F.min("hit_no").alias("hit_no")
    )
    others = hits.select("key", "query").distinct().join(first.select("key", F.col("h.query").alias("own")), "key").filter("query <> own")
    # the queries of one search are a handful
    also = others.groupBy("key").agg(F.concat_ws(",", F.array_sort(F.collect_list("query"))).alias("also_matched"))
    return first.join(also, "key", "left").select(
        "key", "hit_no", "h.query", "h.title", "h.score", (F.col("hits") - 1).alias("duplicates"), F.coalesce("also_matched", F.lit("")).alias("also_matched")
    )


def cut_body(body: Column, cap: Column) -> Column:
    short = F.concat(F.regexp_replace(F.substr(body, F.lit(1), cap), r"\s+$", ""), F.lit(CUT_MARK))
    return F.when(F.length(body) > cap, short).otherwise(body)


def pack_search(hits: DataFrame, budget: int, overhead: int) -> DataFrame:
    """Bodies cut by the first cap of a ladder at which a search fits; past the last cap, lowest scores go.

    ``hits``: search_id, hit_id, score, content.  The sizes for all caps come
    from one pass; dropping keeps the longest prefix by score that fits, which
    cannot hold more than budget / overhead hits.
    """
    caps = [2**31 - 1, *CONTENT_STEPS]
    per_cap = hits.groupBy("search_id").agg(
        *[F.sum(F.length(cut_body(F.col("content"), F.lit(cap))) + overhead).alias(f"s{i}") for i, cap in enumerate(caps)]
    )
    chosen = F.lit(CONTENT_STEPS[-1])
    for i in reversed(range(len(caps))):
        chosen = F.when(F.col(f"s{i}") <= budget, caps[i]).otherwise(chosen)
    plan = per_cap.select("search_id", chosen.alias("cap"), (F.col(f"s{len(caps) - 1}") > budget).alias("too_much"))
    place = F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("score"), "hit_id"))
    top = hits.withColumn("place", place).filter(F.col("place") <= max(1, budget // overhead))
    rows = top.join(plan, "search_id").withColumn("body", cut_body(F.col("content"), F.col("cap")))
    run = Window.partitionBy("search_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum(F.length("body") + overhead).over(run))
    kept = rows.filter(~F.col("too_much") | (F.col("upto") <= budget) | (F.col("place") == 1))
    return kept.select("search_id", "hit_id", "place", "cap", F.length("body").cast("bigint").alias("chars"), F.col("body").endswith(CUT_MARK).alias("is_cut"))


# ---- query texts ------------------------------------------------------------


def _outside_parentheses(text: Column) -> Column:
    """What stands outside all parentheses; each outermost pair leaves one mark, however deep it nests."""
    pieces = F.split(text, r"(?<=[()])|(?=[()])")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        depth = F.when(p == "(", acc["depth"] + 1).when(p == ")", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        kept = F.when((p == "(") & (acc["depth"] == 0), F.concat(acc["out"], F.lit("\u0001"))).when((acc["depth"] == 0) & (p != ")"), F.concat(acc["out"], p)).otherwise(acc["out"])
        return F.struct(depth.alias("depth"), kept.alias("out"))

    return F.aggregate(pieces, start, step)["out"]


def compact_queries(rows: DataFrame, sql: str, watched: Column | None = None) -> DataFrame:
    """A long SELECT list as ``<N fields>``; fields watched for are said to be in it or not.

    The list ends at the FROM outside all parentheses, found by one pass over
    the pieces between parentheses.  Adds the column ``compacted``.
    """
    text = F.col(sql)
    pieces = F.split(text, r"(?<=[()])|(?=[()])|(?i)(?= FROM )")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(-1).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        hit = (acc["at"] < 0) & (acc["depth"] == 0) & F.upper(p).startswith(" FROM ")
        return F.struct(
            F.when(p == "(", acc["depth"] + 1).when(p == ")", acc["depth"] - 1).otherwise(acc["depth"]).alias("depth"),
            (acc["pos"] + F.length(p)).alias("pos"), F.when(hit, acc["pos"]).otherwise(acc["at"]).alias("at"),
        )

    steps = rows.withColumn("__at", F.aggregate(pieces, start, step)["at"])
    steps = steps.withColumn("__listed", F.when(F.col("__at") >= 0, F.substr(text, F.lit(8), F.col("__at") - 7)))
    long_list = (F.upper(F.substring(text, 1, 7)) == "SELECT ") & (F.length("__listed") > FIELD_LIST_MIN)
    flat = F.when(long_list, F.col("__listed"))
    flat = _outside_parentheses(flat)
    steps = steps.withColumn("__fields", F.transform(F.split(flat, ","), lambda x: F.trim(x)))
    steps = steps.withColumn("__low", F.transform("__fields", lambda f: F.lower(f)))
    subs = F.size(F.filter("__fields", lambda f: f.startswith("\u0001")))
    label = F.concat(
        F.size("__fields").cast("string"), F.lit(" fields"),
        F.when(subs == 1, ", incl. 1 subquery").when(subs > 1, F.concat(F.lit(", incl. "), subs.cast("string"), F.lit(" subqueries"))).otherwise(""),
    )
    if watched is not None:
        present = F.filter(watched, lambda w: F.array_contains("__low", F.lower(w)))
        absent = F.filter(watched, lambda w: ~F.array_contains("__low", F.lower(w)))
        label = F.concat(
            label, F.when(F.size(present) > 0, F.concat(F.lit("; INCLUDES "), F.array_join(present, ", "))).otherwise(""),
            F.when(F.size(absent) > 0, F.concat(F.lit(f"; {MISSING} "), F.array_join(absent, ", "))).otherwise(""),
        )
    short = F.concat(F.lit("SELECT <"), label, F.lit(">"), F.substr(text, F.col("__at") + 1, F.length(text) - F.col("__at")))
    out = steps.withColumn("compacted", F.when(F.col("__fields").isNotNull(), short).otherwise(text))
    return out.drop("__at", "__listed", "__fields", "__low")
