"""Conversation queries."""

from pyspark.sql import functions as F

from faultline.operators import conversations as cv
from faultline.plans.registry import query
from faultline.sources.tables import table


def messages(spark, root):
    """Turns with the usage and calls of each derived from its length."""
    n = F.length("text")
    call = F.struct(
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("search").alias("name"), (F.col("turn") % 4 != 3).alias("ok"),
        n.cast("bigint").alias("ms"), F.concat(F.lit('{"field":"F'), F.col("conv_id").cast("string"), F.lit('"}')).alias("args"),
    )
    return table(spark, root, "conversations").select(
        "conv_id", "turn", "role", "text", F.when(F.col("role") == "assistant", n % 3).otherwise(0).alias("tool_calls"),
        n.cast("bigint").alias("total_tokens"), (n / 1000.0).alias("cost"),
        F.when(F.col("role") == "assistant", F.array(call)).otherwise(F.array().cast("array<struct<id:string,name:string,ok:boolean,ms:bigint,args:string>>")).alias("calls"),
    )


FIRST = r"regexp_replace(string_split_regex(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '^\s+|\s+$', '', 'g'), '\r\n|\r|\n')[1], '\s+', ' ', 'g')"


@query("conversation_rollup", f"""
SELECT conv_id, message_count, tool_call_count, total_tokens, total_cost, CASE WHEN line = '' THEN 'New conversation' WHEN length(line) > 80 THEN concat(substr(line, 1, 79), '…') ELSE line END AS title, last_turn FROM (
  SELECT conv_id, sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END)::BIGINT AS message_count, sum(CASE WHEN role = 'assistant' THEN length(text) % 3 ELSE 0 END)::BIGINT AS tool_call_count,
    sum(length(text))::BIGINT AS total_tokens, round_even(sum(length(text) / 1000.0::DOUBLE), 6) AS total_cost, max(turn) AS last_turn, {FIRST} AS line FROM {{conversations}} GROUP BY 1) x
""")
def conversation_rollup(spark, root):
    return cv.rollup(messages(spark, root))


@query("conversation_redaction", """
SELECT conv_id, turn, role, length(text) AS chars, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS calls, FALSE AS shows_args FROM {conversations} WHERE role NOT IN ('system', 'tool')
""")
def conversation_redaction(spark, root):
    seen = cv.redacted(messages(spark, root))
    return seen.select(
        "conv_id", "turn", "role", F.length("text").alias("chars"), F.size("calls").alias("calls"),
        F.exists("calls", lambda x: x["args"].isNotNull()).alias("shows_args"),
    )


# every question of a conversation with the answer behind it
CASES = r"""(SELECT conv_id * 1000000 + turn // 2 AS case_id, max(CASE WHEN turn % 2 = 0 THEN text END) AS q, max(CASE WHEN turn % 2 = 1 THEN text END) AS answer FROM {conversations} GROUP BY 1)"""


GRADED = rf"""
SELECT case_id, failures, CASE WHEN miss > 0 THEN 0 ELSE dec END + CASE WHEN contains(t, 'the') THEN 0 ELSE 1 END AS warnings, failures = 0 AS passed FROM (
  SELECT *, (miss + CASE WHEN case_id % 3 = 0 AND NOT contains(concat('{{"field":"f', case_id, '"}}'), 'f1') THEN 1 ELSE 0 END + CASE WHEN miss > 0 THEN dec ELSE 0 END)::BIGINT AS failures FROM (
    SELECT *, lower(coalesce(answer, '')) AS t, len(list_filter(ws, lambda w: NOT contains(lower(coalesce(answer, '')), w)))::BIGINT AS miss, CASE WHEN contains(lower(coalesce(answer, '')), 'er') THEN 1 ELSE 0 END::BIGINT AS dec FROM (
      SELECT *, regexp_extract_all(lower(coalesce(q, '')), '[a-z]{{2,3}}') AS ws FROM {CASES} c) x) y) z
"""


@query("answer_grading", GRADED)
def answer_grading(spark, root):
    return graded(spark, root)


def graded(spark, root):
    turns = table(spark, root, "conversations").groupBy(
        (F.col("conv_id") * 1_000_000 + F.floor(F.col("turn") / 2)).alias("case_id")
    ).agg(
        F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("question"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("answer")
    )
    none = F.array().cast("array<struct<name:string,args_contains:string>>")
    wanted = F.array(F.struct(F.lit("get_field_writers").alias("name"), F.lit("F1").alias("args_contains")))
    cases = turns.select(
        "case_id", F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit("[a-z]{2,3}"), 0).alias("must_mention"),
        F.array(F.lit("THE")).alias("should_mention"), F.array(F.lit("er")).alias("decoys"),
        F.when(F.col("case_id") % 3 == 0, wanted).otherwise(none).alias("must_call"), F.lit(False).alias("forbid_log_request"),
    )
    answers = turns.select(
        "case_id", "answer", F.array(F.struct(F.lit("get_field_writers").alias("name"), F.concat(F.lit('{"field":"f'), F.col("case_id").cast("string"), F.lit('"}')).alias("args"))).alias("calls"),
    )
    return cv.grade(cases, answers)


@query("answer_pass_rate", f"""
SELECT count(*) AS cases, sum(CASE WHEN passed THEN 1 ELSE 0 END)::BIGINT AS passed, round_even(avg(CASE WHEN passed THEN 1 ELSE 0 END) * 100, 1) AS pass_rate FROM ({GRADED}) g
""")
def answer_pass_rate(spark, root):
    return cv.pass_rate(graded(spark, root))
