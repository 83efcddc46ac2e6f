"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  The flow network is: start -> pattern (one arc per repetition, each as
wide as the pattern has words, later repetitions dearer: a convex cost) ->
each source of the pattern -> end (as wide as the source's target).  Only the
pattern table reaches the driver; its size is checked, not trusted.

The words a pattern is to give are then turned into documents: as many whole
copies of all its documents as fit, and for the rest documents in the order of
a seeded hash, each that still fits.  That is done by cuts: among the documents
no longer than the room left, behind the one that didn't fit before, all up to
the next that doesn't fit, until none is left.  A cut is found in a histogram
over hash ranges, and by rows only inside the one range where it falls, so a
source that holds a third of all rows is never sorted in one task.  What then
remains open is shorter than any document left; one that goes over by less than
what is missing is taken at last.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import stored, whole_text

MAX_EPOCHS = 3
SEED = 20_011
# ranges a level of hashes is cut into, and rows that are few enough to be put in order by one task
RANGE_BITS, FEW_ROWS = 8, 4_096
# patterns that may reach the driver and be broadcast back; more is an error, never a cut
MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def source_order(name: str | None) -> tuple[bool, str]:
    """Sources by code point, null last."""
    return name is None, name or ""


def water_filled(sizes: dict, weights: dict, total: float, most: float = MAX_EPOCHS) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared again by weight."""
    open_, out, left = set(sizes), {}, float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= set(above)
    return out


def min_cost_flow(patterns: dict[tuple, int], quota: dict, epochs: int = MAX_EPOCHS) -> dict[tuple, dict]:
    """Words from each pattern to each of its sources.

    Costs lie only on the arcs into the patterns and rise with the repetition,
    so successive shortest paths means: send all that can be sent with one
    repetition (rerouting among sources included), then allow the next.
    """
    flow = {p: dict.fromkeys(p, 0) for p in patterns}
    holders: dict = {}
    for p in patterns:
        for s in p:
            holders.setdefault(s, []).append(p)
    need = dict(quota)
    for epoch in range(1, epochs + 1):
        spare = {p: size * epoch - sum(flow[p].values()) for p, size in patterns.items()}
        for start in sorted(patterns, key=repr):
            while spare[start] > 0:
                # breadth first: pattern -> source -> (take back from) pattern ...
                came: dict = {("p", start): None}
                queue, goal = deque([("p", start)]), None
                while queue and goal is None:
                    kind, node = queue.popleft()
                    if kind == "p":
                        for s in node:
                            if ("s", s) not in came:
                                came["s", s] = (kind, node)
                                if need.get(s, 0) > 0:
                                    goal = ("s", s)
                                    break
                                queue.append(("s", s))
                    else:
                        for p in holders[node]:
                            if flow[p][node] > 0 and ("p", p) not in came:
                                came["p", p] = (kind, node)
                                queue.append(("p", p))
                if goal is None:
                    break
                path, at = [goal], goal
                while came[at] is not None:
                    at = came[at]
                    path.append(at)
                path.reverse()
                amount = min(spare[start], need[goal[1]], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"))
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                spare[start] -= amount
                need[goal[1]] -= amount
    return flow


@dataclass
class Plan:
    """What the driver knows: sizes and targets per source, words and the cut per pattern."""

    source_size: dict
    target: dict
    flow: dict
    patterns: list[tuple]
    copies: dict[tuple, int]
    # the seeded part: (size at most, behind this place, before this place), a place being (range, hash, key), None without end
    cuts: dict[tuple, list[tuple]] = field(default_factory=dict)
    extra: dict[tuple, list] = field(default_factory=dict)


def _order(key: str = "__key", size: str = "__size", seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.col(size))


def _range(level: int = 1) -> Column:
    """The hash range of a level: each level cuts the ranges of the one above it."""
    return F.shiftrightunsigned(F.col("__h"), 64 - RANGE_BITS * level)


def _place() -> Column:
    """Where a document stands in the seeded order; a null key comes first."""
    return F.struct(_range().alias("r"), F.col("__h").alias("h"), F.col("__key").alias("k"))


def sized(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, size, membership pattern (sorted, without repeats) and seeded hash of each row."""
    rows = docs.select(F.col(key).alias("__key"), word_count(text).alias("__size"), F.array_sort(F.array_distinct(sources)).alias("__pattern"))
    return rows.withColumn("__h", _order(seed=seed))


def plan_mix(sizes: DataFrame, weight_cycle: Sequence[float] = (1, 2, 3), share: float = 1.0, epochs: int = MAX_EPOCHS) -> Plan:
    """Targets, flow and cuts for the rows of ``sized`` (stored, as it is read several times)."""
    found = sizes.groupBy("__pattern").agg(F.sum("__size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["__pattern"]): int(r["n"] or 0) for r in found}
    source_size: dict = {}
    for p, n in patterns.items():
        for s in p:
            source_size[s] = source_size.get(s, 0) + n
    names = sorted(source_size, key=source_order)
    weights = {s: weight_cycle[i % len(weight_cycle)] for i, s in enumerate(names)}
    target = water_filled(source_size, weights, share * sum(patterns.values()), epochs)
    flow = min_cost_flow(patterns, {s: math.floor(t + 0.5) for s, t in target.items()}, epochs)
    words = {p: sum(f.values()) for p, f in flow.items()}
    plan = Plan(source_size, target, flow, sorted(patterns, key=repr), {p: words[p] // n if n else 0 for p, n in patterns.items()})
    rest = {p: words[p] - plan.copies[p] * n for p, n in patterns.items()}
    _place_cuts(sizes, plan, rest)
    return plan


def _edges(rows: DataFrame, level: int) -> list:
    """Per pattern its words in all, and the range of the level in which they pass the room, with the words before it.

    ``rows`` have id, room and the words ``before`` them; the window runs over
    the ranges of one range above, never over documents.
    """
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("id").orderBy("range"))
    totals = rows.groupBy("id", "room", "before", _range(level).alias("range")).agg(F.sum("__size").alias("n"), F.count(F.lit(1)).alias("rows"))
    edge = F.struct("range", (F.col("upto") - F.col("n")).alias("before"), "rows")
    return totals.withColumn("upto", upto).groupBy("id").agg(F.max("upto").alias("total"), F.min(F.when(F.col("upto") > F.col("room"), edge)).alias("edge")).collect()


def _narrowed(rows: DataFrame, edges: dict) -> list[tuple]:
    """(id, bits, range, words before): the range of each cut, cut again by further bits of the hash until it has few rows."""
    out, level = [], 1
    while edges:
        done = {i: e for i, e in edges.items() if e["rows"] <= FEW_ROWS or RANGE_BITS * (level + 1) >= 64}
        out += [(i, 64 - RANGE_BITS * level, e["range"], e["before"]) for i, e in done.items()]
        wide = [(i, e["range"], e["before"]) for i, e in edges.items() if i not in done]
        if not wide:
            return out
        at = rows.sparkSession.createDataFrame(wide, "e int, above bigint, before bigint")
        inside = rows.join(F.broadcast(at), (F.col("id") == F.col("e")) & (_range(level) == F.col("above")))
        level += 1
        edges = {r["id"]: r["edge"] for r in _edges(inside, level)}
    return out


def _place_cuts(sizes: DataFrame, plan: Plan, rest: dict[tuple, int]) -> None:
    spark = sizes.sparkSession
    plan.extra = {p: [] for p in plan.patterns}
    plan.cuts = {p: [] for p in plan.patterns}
    kind = sizes.schema["__pattern"].dataType.simpleString()
    place = f"struct<r: bigint, h: bigint, k: {sizes.schema['__key'].dataType.simpleString()}>"
    room = dict(rest)
    open_: dict[tuple, tuple | None] = {p: None for p in plan.patterns if room[p] > 0}
    while open_:
        state = spark.createDataFrame([(list(p), i, room[p], open_[p]) for i, p in enumerate(plan.patterns) if p in open_], f"p {kind}, id int, room bigint, behind {place}")
        rows = sizes.filter("__size > 0").join(F.broadcast(state), F.col("__pattern").eqNullSafe(F.col("p"))).filter("__size <= room")
        rows = rows.filter(F.col("behind").isNull() | (_place() > F.col("behind")))
        found = _edges(rows.withColumn("before", F.lit(0).cast("bigint")), 1)
        cut = {}
        edges = _narrowed(rows, {r["id"]: r["edge"] for r in found if r["edge"] is not None})
        if edges:
            edge = spark.createDataFrame(edges, "e int, bits int, edge bigint, before bigint")
            # inside the range of the cut, rows that agree in hash and key are taken together
            inside = (
                rows.join(F.broadcast(edge), (F.col("id") == F.col("e")) & (F.expr("shiftrightunsigned(__h, bits)") == F.col("edge")))
                .groupBy("id", "room", "before", "__h", "__key").agg(F.sum("__size").alias("n"))
                .withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("id").orderBy("__h", "__key").rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy("id", "before")
                .agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("last"), F.min(F.when(F.col("upto") > F.col("room"), _place())).alias("first"))
            )
            cut = {r["id"]: (r["before"] if r["last"] is None else r["last"], tuple(r["first"])) for r in inside.collect()}
        before, open_ = open_, {}
        for r in found:  # a row per pattern
            p = plan.patterns[r["id"]]
            taken, stop = cut.get(r["id"], (r["total"], None))
            plan.cuts[p].append((room[p], before[p], stop))
            room[p] -= taken
            if stop is not None and room[p] > 0:
                open_[p] = stop
    # nothing fits any more; one may overshoot by less than what is still missing
    missing = [(list(p), n) for p, n in room.items() if n > 0]
    if not missing:
        return
    free = apply_plan(sizes, plan).filter("__size > 0 AND __part = 0").join(F.broadcast(spark.createDataFrame(missing, f"p {kind}, room bigint")), F.col("__pattern").eqNullSafe(F.col("p"))).filter("__size < 2 * room")
    free = free.groupBy("__pattern", "room", "__h", "__key").agg(F.sum("__size").alias("n")).filter("n < 2 * room")
    for r in free.groupBy("__pattern").agg(F.min(F.struct("n", "__h", "__key")).alias("above")).collect():
        plan.extra[tuple(r["__pattern"])].append((r["above"]["__h"], r["above"]["__key"]))


def apply_plan(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds __copies (whole repetitions) and __part (1 if the document is in the seeded part)."""
    spark = rows.sparkSession
    key_kind = rows.schema["__key"].dataType.simpleString()
    place = f"struct<r: bigint, h: bigint, k: {key_kind}>"
    table = [(list(p), plan.copies[p], plan.cuts.get(p, []), [tuple(x) for x in plan.extra.get(p, [])]) for p in plan.patterns]
    kind = rows.schema["__pattern"].dataType.simpleString()
    cuts = spark.createDataFrame(
        table, f"p {kind}, copies int, cuts array<struct<most: bigint, behind: {place}, before: {place}>>, extra array<struct<h: bigint, k: {key_kind}>>"
    )
    joined = rows.join(F.broadcast(cuts), F.col("__pattern").eqNullSafe(F.col("p"))).withColumn("__place", _place())
    at = F.col("__place")
    in_cut = F.exists("cuts", lambda c: (F.col("__size") <= c["most"]) & (c["behind"].isNull() | (at > c["behind"])) & (c["before"].isNull() | (at < c["before"])))
    named = F.exists("extra", lambda x: (x["h"] == F.col("__h")) & x["k"].eqNullSafe(F.col("__key")))
    return joined.select(*rows.columns, F.col("copies").alias("__copies"), F.when((F.col("__size") > 0) & (in_cut | named), 1).otherwise(0).alias("__part"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, size, source_size, target, taken: how many words the mix takes of each row's document.

    Sources in code point order, null last (null is a source of its own), weigh
    1, 2, 3 and so on in turn and share as many words as there are; a source
    gets at most three times its size.  taken is a whole number of copies (0 to
    3) times the size.  A null or empty text has size 0 and takes 0.  The
    choice depends on seed, key and size only, so reruns agree; rows repeated
    with key and text are taken or left together.  An empty table gives no rows.
    """
    sizes = stored(sized(docs, F.array(F.col(source)), key, text, seed), "mix-sizes")
    plan = plan_mix(sizes)
    spark = docs.sparkSession
    kind = docs.schema[source].dataType.simpleString()
    known = spark.createDataFrame([(s, n, plan.target[s]) for s, n in plan.source_size.items()], f"__s {kind}, source_size bigint, target double")
    chosen = apply_plan(sizes, plan).join(F.broadcast(known), F.col("__pattern")[0].eqNullSafe(F.col("__s")))
    taken = F.col("__size") * (F.col("__copies") + F.col("__part"))
    return chosen.select(F.col("__key").alias(key), F.col("__size").alias("size"), "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes its document, with the columns of ``docs``."""
    sizes = stored(sized(docs, F.array(F.col(source)), key, text, seed), "mix-sizes")
    plan = plan_mix(sizes)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__key"), word_count(text).alias("__size"), F.array(F.col(source)).alias("__pattern"))
    chosen = apply_plan(whole.withColumn("__h", _order(seed=seed)), plan)
    times = F.when(F.col("__size") > 0, F.col("__copies") + F.col("__part")).otherwise(0)
    return chosen.filter(times > 0).select(F.explode(F.sequence(F.lit(1), times)).alias("__time"), "__row").select("__row.*")
