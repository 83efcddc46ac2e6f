"""Async evidence in debug logs: who dispatched which job, and which dispatch failed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.functions.scan import CHUNK_ROWS, scan
from faultline.operators.debug_logs import EVIDENCE_EVENTS, METHOD_EVENTS, Sweep, last_field, levelled
from faultline.session import written

# ---- fixed values -----------------------------------------------------------
MECHANISMS = ("System.enqueueJob", "Database.executeBatch", "System.scheduleBatch", "System.schedule")
ASYNC_LIMIT = r"(?i)Too many (?:queueable jobs added to the queue|future calls|batch jobs|async)\S*:?\s*(\d+)?"
NEAR_LINES = 25
# -----------------------------------------------------------------------------

REDUCED = ["k_log", "k_unit", "part", "k_line", "method", "state", "ops"]


def framed(rows: DataFrame | Sweep, wide: bool = False) -> DataFrame:
    """Method and evidence events, each with the code unit that is innermost when it is read."""
    if isinstance(rows, Sweep):
        unit = F.when(F.col("opened").isNotNull(), F.struct(F.col("opened.line_no").alias("line_no"), F.col("opened.text").alias("label")))
        return rows.stacks.filter((F.col("step") == 0) & F.col("evt").isin(*METHOD_EVENTS, *EVIDENCE_EVENTS)).withColumn("unit", unit)
    levels = levelled(rows.drop("raw"), "unit", METHOD_EVENTS + EVIDENCE_EVENTS, wide)
    inner = F.when(F.col("step") == 1, F.col("open_before")).otherwise(F.col("open_before") - 1)
    start = F.when(F.col("step") == 1, F.struct("line_no", last_field(3).alias("label")))
    placed = scan(
        levels.filter("step >= 0").withColumn("inner", inner), ["log_id", "inner"], "line_no", lasts={"unit": start}, wide=wide
    )
    return placed.filter("step = 0").withColumn("unit", F.when(F.col("inner") >= 0, F.col("unit")))


class ChunkStack:
    """What a run of method events does to any stack it may start from.

    Entries pushed since the last exit that found no partner here lie on top
    whatever lay below, so exits and questions that meet them are settled at
    once.  The rest is kept in order: ``+name`` an entry that stays, ``-name`` an
    exit that pops to an entry of that name below, if there is one, ``?`` a
    question for the top of the stack.
    """

    def __init__(self) -> None:
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.ops: list[str] = []
        self.states = 0

    def _settle(self) -> None:
        self.ops += [f"+{name}" for name in self.open]
        self.open, self.at = [], {}

    def enter(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append(name)

    def leave(self, name: str) -> bool:
        """Pop to the nearest entry of the name; false if none is known here."""
        found = self.at.get(name)
        if not found:
            return False
        place = found[-1]
        for gone in reversed(self.open[place:]):
            self.at[gone].pop()
        del self.open[place:]
        return True

    def exit(self, name: str) -> None:
        if not self.leave(name):
            self._settle()
            self.ops.append(f"-{name}")

    def top(self) -> tuple[str | None, int | None]:
        """(name, None) if the top is known here, else (None, number of the question)."""
        if self.open:
            return self.open[-1], None
        if not self.ops or self.ops[-1] != "?":
            self.ops.append("?")
            self.states += 1
        return None, self.states - 1

    def effect(self) -> list[str]:
        self._settle()
        return self.ops

    def apply(self, ops: list[str]) -> list[str | None]:
        """Run a chunk's effect on this stack, which is the real one; answers to its questions."""
        answers: list[str | None] = []
        for op in ops:
            if op == "?":
                answers.append(self.open[-1] if self.open else None)
            elif op[0] == "+":
                self.enter(op[1:])
            else:
                self.leave(op[1:])
        return answers


def callers(events: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(k_log, k_line, method): the method on top of the stack for each evidence event.

    An exit pops back to the nearest entry of the same name and is ignored if
    there is none; no window function says that.  Stacks of different code
    units are independent, and a unit is cut into chunks of lines: each chunk
    is reduced on its own to its effect on a stack, answering what needs no
    earlier event; the effects of a unit, a few operations each, are run in
    order; what they answer is joined back.
    """
    inside = events.filter(F.col("unit").isNotNull()).select(
        "log_id", F.col("unit.line_no").alias("unit_line"), "line_no", "evt", c.callee(F.col("last_part")).alias("callee"),
        F.floor(F.col("line_no") / F.lit(chunk)).alias("part"),
    )

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stack = None, ChunkStack()
        for pdf in batches:
            out = []
            for log, unit_line, part, line, evt, name in zip(pdf["log_id"], pdf["unit_line"], pdf["part"], pdf["line_no"], pdf["evt"], pdf["callee"], strict=True):
                if (log, unit_line, part) != key:
                    if key is not None:
                        out.append((*key, None, None, None, stack.effect()))
                    key, stack = (log, unit_line, part), ChunkStack()
                if evt == "METHOD_ENTRY":
                    stack.enter(name)
                elif evt == "METHOD_EXIT":
                    stack.exit(name)
                else:
                    out.append((*key, line, *stack.top(), None))
            yield pd.DataFrame(out, columns=REDUCED).astype({"state": "Int64", "k_line": "Int64"})
        if key is not None:
            yield pd.DataFrame([(*key, None, None, None, stack.effect())], columns=REDUCED).astype({"state": "Int64", "k_line": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, stack = None, ChunkStack()
        for pdf in batches:
            out = []
            for log, unit_line, part, ops in zip(pdf["k_log"], pdf["k_unit"], pdf["part"], pdf["ops"], strict=True):
                if (log, unit_line) != unit:
                    unit, stack = (log, unit_line), ChunkStack()
                out += [(log, unit_line, part, i, name) for i, name in enumerate(stack.apply(list(ops))) if name is not None]
            yield pd.DataFrame(out, columns=["a_log", "a_unit", "a_part", "a_state", "above"])

    chunks = inside.repartition("log_id", "part").sortWithinPartitions("log_id", "part", "unit_line", "line_no").mapInPandas(
        reduce, "k_log bigint, k_unit bigint, part bigint, k_line bigint, method string, state bigint, ops array<string>"
    )
    chunks = written(chunks, "method-stacks")
    effects = chunks.filter("ops IS NOT NULL AND size(ops) > 0").select("k_log", "k_unit", "part", "ops")
    answers = effects.repartition("k_log", "k_unit").sortWithinPartitions("k_log", "k_unit", "part").mapInPandas(
        run, "a_log bigint, a_unit bigint, a_part bigint, a_state bigint, above string"
    )
    same = (F.col("k_log") == F.col("a_log")) & (F.col("k_unit") == F.col("a_unit")) & (F.col("part") == F.col("a_part")) & (F.col("state") == F.col("a_state"))
    asked = chunks.filter("k_line IS NOT NULL").join(answers, same, "left")
    return asked.select("k_log", "k_line", F.coalesce("method", "above").alias("method"))


def evidence(rows: DataFrame | Sweep, wide: bool = False) -> DataFrame:
    """Constructions, dispatches and async-limit failures with caller and the nearest construction."""
    # read twice, by the stacks and by what is told of them
    events = framed(rows, wide)
    events = events if isinstance(rows, Sweep) else written(events, "log-frames")
    text = F.col("last_part")
    is_new = (F.col("evt") == "CONSTRUCTOR_ENTRY") & (F.trim(text) != "") & ~F.trim(text).startswith("<")
    mechanism = F.lit(None).cast("string")
    for m in reversed(MECHANISMS):
        mechanism = F.when(text.startswith(m + "("), m).otherwise(mechanism)
    dispatch = (F.col("evt") == "SYSTEM_METHOD_ENTRY") & mechanism.isNotNull()
    message = last_field(3)
    failed = (F.col("evt") == "EXCEPTION_THROWN") & message.rlike(ASYNC_LIMIT)
    what = F.when(is_new, "construction").when(dispatch, "dispatch").when(failed, "failure")
    enough = F.when(F.col("evt") == "EXCEPTION_THROWN", 4).otherwise(3)
    line = F.when(F.col("n_parts") >= enough, c.bracket_line(F.col("parts")[2]))
    told = events.join(callers(events), (F.col("log_id") == F.col("k_log")) & (F.col("line_no") == F.col("k_line")), "left")
    kept = told.withColumn("what", what).filter(F.col("what").isNotNull()).select(
        "log_id", "line_no", "what", line.alias("line"), F.coalesce("method", "unit.label").alias("caller"),
        F.col("unit.label").alias("code_unit"), F.coalesce("unit.line_no", F.lit(-1)).alias("unit_line"),
        F.when(F.col("what") == "construction", F.trim(text)).alias("class"),
        F.when(F.col("what") == "dispatch", mechanism).alias("mechanism"),
        F.when(F.col("what") == "failure", c.truncate(message, 200)).alias("message"),
        F.when(F.col("what") == "failure", F.nullif(F.regexp_extract(message, ASYNC_LIMIT, 1), F.lit(""))).cast("bigint").alias("attempted"),
    )
    made = F.when(F.col("what") == "construction", F.struct("class", "line", "caller"))
    near = scan(kept, ["log_id", "unit_line"], "line_no", prevs={"made": made}, wide=wide)
    gap = F.col("line") - F.col("made.line")
    close = F.col("line").isNull() | F.col("made.line").isNull() | ((gap >= 0) & (gap <= NEAR_LINES))
    usable = (
        (F.col("what") != "construction") & (F.col("unit_line") >= 0) & F.col("made").isNotNull()
        & F.col("made.caller").eqNullSafe(F.col("caller")) & close
    )
    return near.withColumn("job_class_guess", F.when(usable, F.col("made.class"))).withColumn(
        "job_class_line", F.when(usable, F.col("made.line"))
    ).drop("made")


def dispatches(found: DataFrame, wide: bool = False) -> DataFrame:
    """Dispatches, the last one at the line and caller of a failure marked as failed."""
    keyed = found.filter("what <> 'construction'")
    hit = scan(
        keyed, ["log_id", "line", "caller"], "line_no", prevs={"target": F.when(F.col("what") == "dispatch", F.col("line_no"))},
        wide=wide,
    ).filter("what = 'failure' AND target IS NOT NULL").select(
        F.col("log_id").alias("h_log"), F.col("target").alias("h_line")
    ).distinct()
    out = keyed.filter("what = 'dispatch'").join(
        hit, (F.col("log_id") == F.col("h_log")) & (F.col("line_no") == F.col("h_line")), "left"
    )
    return out.select(
        "log_id", "line_no", "mechanism", "line", "caller", "code_unit", "job_class_guess", "job_class_line",
        F.col("h_log").isNotNull().alias("failed"),
    )


def shown_dispatches(found: DataFrame, wide: bool = False) -> DataFrame:
    """Every dispatch; how many of them a caller shows is the caller's affair."""
    return dispatches(found, wide)


def failures(found: DataFrame) -> DataFrame:
    return found.filter("what = 'failure'").select(
        "log_id", "line_no", "message", "line", "caller", "code_unit", "attempted", "job_class_guess", "job_class_line"
    )


def job_constructions(found: DataFrame) -> DataFrame:
    """Job-like classes constructed, counted per line and caller."""
    return found.filter((F.col("what") == "construction") & F.col("class").rlike(c.JOB_NAME)).groupBy(
        "log_id", "class", "line", "caller"
    ).agg(F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"))


def presence(found: DataFrame, entries: DataFrame) -> Column | DataFrame:
    """Logs in which something async showed up at all, with the counts that say so."""
    counts = found.groupBy("log_id").agg(
        F.count_if(F.col("what") == "dispatch").alias("dispatches"),
        F.count_if(F.col("what") == "failure").alias("failures"),
        F.count_if((F.col("what") == "construction") & F.col("class").rlike(c.JOB_NAME)).alias("constructions"),
    )
    joined = entries.select("log_id", "entry_unit", "likely_async").join(counts, "log_id", "full")
    joined = joined.na.fill(0, ["dispatches", "failures", "constructions"]).na.fill(False, ["likely_async"])
    return joined.filter("likely_async OR dispatches > 0 OR failures > 0 OR constructions > 0")
