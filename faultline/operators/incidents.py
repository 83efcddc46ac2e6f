"""Incidents: failure signatures, recurrence, resolutions and the match to known issues."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.functions.scan import number_rows, scan
from faultline.session import cut_lineage, written

# ---- fixed values -----------------------------------------------------------
CLASS_FRAME = r"(?i)^Class\.([\w.]+?)(?:\.\w+)?:"
MATCH_LIMIT, MIN_SCORE, MIN_CONTAINED, TYPE_BONUS = 8, 40, 12, 15
RECENT_FIXES = 6
# -----------------------------------------------------------------------------

# characters of the patterns of one automaton, and of the texts it runs over in one task
AUTOMATON_CHARS = 1 << 20
TEXT_CHARS = 1 << 24


def first_frame(stack: Column) -> Column:
    """Class of the first class frame among the lines of a stack."""
    lines = F.transform(F.split(F.coalesce(stack, F.lit("")), "\n"), lambda x: F.trim(x))
    framed = F.filter(lines, lambda x: x.rlike(CLASS_FRAME))
    return F.coalesce(F.regexp_extract(F.try_element_at(framed, F.lit(1)), CLASS_FRAME, 1), F.lit(""))


def signed(incidents: DataFrame) -> DataFrame:
    """The signature of each incident: of its exception, else of the suspect field, else none."""
    has_exc = F.col("exc_type").isNotNull()
    has_field = F.coalesce("suspect_field", F.lit("")) != ""
    exc = c.signature_hash(F.col("exc_type"), c.mask_literals(F.col("message")), first_frame(F.col("frame_line")))
    field = F.substring(F.sha2(F.concat(F.lit("field_report|"), F.col("suspect_field")), 256), 1, 16)
    return incidents.withColumn("signature", F.when(has_exc, exc).when(has_field, field)).withColumn(
        "kind", F.when(has_exc, "exception").when(has_field, "field_report")
    )


def known_issues(signed_incidents: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row per (org, signature): seen first and last, how often, first sample, latest resolution."""
    order = F.struct("filed_at", "incident_id")
    rows = signed_incidents.filter(F.col("signature").isNotNull()).join(
        resolutions.select("incident_id", "resolved_at", "resolution"), "incident_id", "left"
    )
    fixed = F.when(F.col("resolution").isNotNull(), F.struct("resolved_at", "incident_id"))
    return rows.groupBy("org_id", "signature").agg(
        F.min_by("kind", order).alias("kind"), F.min_by("exc_type", order).alias("type"),
        F.min_by(F.when(F.col("kind") == "exception", F.col("message")), order).alias("message_sample"),
        F.min_by(F.when(F.col("kind") == "field_report", F.col("suspect_field")), order).alias("field"),
        F.min("filed_at").alias("first_seen"), F.max("filed_at").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"),
        F.max_by("incident_id", order).alias("latest_incident"), F.max_by("resolution", fixed).alias("resolution"),
        F.max("resolved_at").alias("resolution_recorded_at"),
    )


def recurrence(signed_incidents: DataFrame, resolutions: DataFrame, wide: bool = False) -> DataFrame:
    """Each incident's place among those of its signature, and what was known when it was filed."""
    rows = signed_incidents.filter(F.col("signature").isNotNull()).join(
        resolutions.select("incident_id", "resolution"), "incident_id", "left"
    )
    keys = ["org_id", "signature"]
    numbered = number_rows(
        rows, keys, F.date_trunc("day", "filed_at"), [F.col("filed_at"), F.col("incident_id")], "occurrence", wide
    )
    seen = scan(
        numbered, keys, "occurrence", wide=wide, prevs={"prior_incident": F.col("incident_id"), "prior_resolution": F.col("resolution")}
    )
    return seen.select(
        "incident_id", "org_id", "signature", "kind", "occurrence", (F.col("occurrence") > 1).alias("recurrence"),
        (F.col("occurrence") - 1).alias("prior_occurrences"), "prior_incident", "prior_resolution",
    )


def org_statistics(signed_incidents: DataFrame, known: DataFrame) -> DataFrame:
    filed = signed_incidents.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("incidents"), F.date_format(F.max("filed_at"), "yyyyMMdd'T'HHmmss'Z'").alias("last_incident_at")
    )
    issues = known.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("known"), F.count_if(F.col("resolution").isNull()).alias("unresolved")
    )
    return filed.join(issues, "org_id", "left").na.fill(0)


def recent_fixes(known: DataFrame, orgs: DataFrame, n: int = RECENT_FIXES) -> DataFrame:
    """Newest resolutions over the orgs a caller sees, texts cut for display."""
    seen = known.filter(F.col("resolution").isNotNull()).join(orgs.select("org_id"), "org_id", "left_semi")
    return seen.orderBy(F.desc("resolution_recorded_at"), "org_id", "signature").limit(n).select(
        "org_id", "signature", "kind", "type", "field", F.substring("message_sample", 1, 240).alias("message_sample"),
        F.substring("resolution", 1, 400).alias("resolution"), c.iso(F.col("resolution_recorded_at")).alias("resolution_recorded_at"), "occurrences",
    )


def browse(known: DataFrame, text: str | None = None, only_unresolved: bool = False) -> DataFrame:
    """Known issues filtered over five fields, newest first."""
    rows = known.filter(F.col("resolution").isNull()) if only_unresolved else known
    q = (text or "").strip().lower()
    if q:
        hit = F.lit(False)
        for name in ("signature", "type", "message_sample", "field", "resolution"):
            hit = hit | F.lower(F.coalesce(name, F.lit(""))).contains(q)
        rows = rows.filter(hit)
    return rows.orderBy(F.desc("last_seen"), "org_id", "signature")


def browse_totals(known: DataFrame) -> DataFrame:
    return known.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolution").isNotNull()).alias("with_fix"),
        F.count_if(F.col("resolution").isNull()).alias("undocumented"),
    )


def unique_ids(rows: DataFrame, base: Column, order: str, wide: bool = False) -> DataFrame:
    """Ids from a base text; the same base again gets ``_2``, ``_3`` and so on.

    ``order`` is a whole-number id; blocks of it serve as buckets, so that one
    base shared by very many rows is still numbered in parallel.
    """
    based = rows.withColumn("base", base)
    numbered = number_rows(based, ["base"], F.floor(F.col(order) / F.lit(100_000)), [F.col(order)], "n", wide)
    return numbered.withColumn(
        "unique_id", F.when(F.col("n") > 1, F.concat_ws("_", "base", F.col("n").cast("string"))).otherwise(F.col("base"))
    )


def already_filed(links: DataFrame) -> DataFrame:
    """Logs already filed in an org, with the latest incident."""
    return links.groupBy("log_id", "org_id").agg(
        F.count(F.lit(1)).alias("times"), F.max_by("incident_id", F.struct("filed_at", "incident_id")).alias("last_incident")
    )


# ---- match to known issues --------------------------------------------------
#
# Scoring every issue for every query would be a cross join.  Instead each way
# of scoring has an equality that must hold for it to apply, and only pairs
# that share such a key are scored:
#   signature        the query is the signature
#   text contained   a word inside the contained text is a whole word of the
#                    containing one; the rarest such word is the key.  Texts of
#                    one or two words have none: they are the patterns of
#                    automata that run over the containing texts
#   field named      the fields are patterns likewise
#   words shared     sharing enough words means sharing one of the rarest ones
# A text longer than any containing one, or that needs more shared words than
# any query has, is left out before its words are taken apart.
# Queries and issues are first reduced to distinct masked texts.


def _spaced(text: str) -> Column:
    return F.split(F.col(text), " ")


def patterns_inside(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(p_id, t_id): patterns (p_id, p_text) that stand anywhere in texts (t_id, t_text); empty patterns stand nowhere.

    Patterns are cut into shards by their measured size, each an automaton that
    reads a text once, whatever the number of patterns; texts are dealt out in
    blocks.  A task holds one shard and one block.
    """
    chars = lambda df, name: df.agg(F.coalesce(F.sum(F.length(name)), F.lit(0))).first()[0]
    spark = texts.sparkSession
    patterns = patterns.filter(F.length("p_text") > 0)
    shards = max(1, -(-chars(patterns, "p_text") // AUTOMATON_CHARS))
    blocks = max(spark.sparkContext.defaultParallelism, -(-chars(texts, "t_text") // TEXT_CHARS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = patterns.select("p_id", "p_text", F.pmod(F.xxhash64("p_text"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    t = texts.select("t_id", "t_text", F.pmod(F.xxhash64("t_id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))

    def cell(_: tuple, own: pd.DataFrame, read: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(read):
            automaton = ahocorasick.Automaton()
            for text, ids in own.groupby("p_text")["p_id"]:
                automaton.add_word(text, (text, tuple(ids)))
            automaton.make_automaton()
            for t_id, text in zip(read["t_id"], read["t_text"], strict=True):
                hits = dict(found for _, found in automaton.iter(text))
                out += [(p_id, t_id) for ids in hits.values() for p_id in ids]
        return pd.DataFrame(out, columns=["p_id", "t_id"])

    kinds = [df.schema[name].dataType.simpleString() for df, name in ((patterns, "p_id"), (texts, "t_id"))]
    return p.groupBy("shard", "block").cogroup(t.groupBy("shard", "block")).applyInPandas(cell, f"p_id {kinds[0]}, t_id {kinds[1]}")


def _contained_pairs(small: DataFrame, big: DataFrame) -> DataFrame:
    """(s_id, b_id) such that ``small.text`` occurs in ``big.text``; both at least twelve characters."""
    longest = big.agg(F.coalesce(F.max(F.length("b_text")), F.lit(0))).first()[0]
    s = small.filter(F.length("s_text").between(MIN_CONTAINED, longest))
    patterns = s.select(F.col("s_id").alias("p_id"), F.col("s_text").alias("p_text"))
    read = big.select(F.col("b_id").alias("t_id"), F.col("b_text").alias("t_text"))
    if s.agg(F.coalesce(F.sum(F.length("s_text")), F.lit(0))).first()[0] <= AUTOMATON_CHARS:
        # one automaton holds them all: the containing texts are read once and not taken apart
        return patterns_inside(patterns, read).select(F.col("p_id").alias("s_id"), F.col("t_id").alias("b_id"))
    s = s.withColumn("toks", _spaced("s_text"))
    b_tokens = big.select("b_id", F.explode(F.array_distinct(_spaced("b_text"))).alias("tok"))
    inner = s.filter(F.size("toks") > 2).select(
        "s_id", F.explode(F.array_distinct(F.slice("toks", 2, F.size("toks") - 2))).alias("tok")
    )
    asked = inner.select("tok").distinct()
    freq = b_tokens.join(asked, "tok", "left_semi").groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # a word no containing text has rules the pair out, so it must win as the rarest
    key = inner.join(freq, "tok", "left").groupBy("s_id").agg(
        F.min_by("tok", F.struct(F.coalesce("df", F.lit(0)), "tok")).alias("tok")
    )
    pairs = key.join(b_tokens, "tok").select("s_id", "b_id")
    # two words or fewer: no inner word
    short = s.filter(F.size("toks") <= 2).select(F.col("s_id").alias("p_id"), F.col("s_text").alias("p_text"))
    inside = patterns_inside(short, read)
    pairs = pairs.unionByName(inside.select(F.col("p_id").alias("s_id"), F.col("t_id").alias("b_id")))
    joined = pairs.distinct().join(s.select("s_id", "s_text"), "s_id").join(big, "b_id")
    return joined.filter(F.contains("b_text", "s_text")).select("s_id", "b_id")


def _text_id(*columns: str) -> Column:
    """Identity of a group of texts: a 256-bit digest, as a short one would join wrong pairs at scale."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(x), F.lit("")).alias(x) for x in columns])), 256)


def _shares(forms: DataFrame, texts: DataFrame) -> DataFrame:
    """(e_id, q_id, base) of the pairs that share enough words for the least score that can count."""
    most = texts.agg(F.coalesce(F.max(F.size("q_words")), F.lit(0))).first()[0]
    floor = F.when(F.col("typed"), MIN_SCORE - TYPE_BONUS).otherwise(MIN_SCORE)
    least = F.greatest(F.lit(2), F.ceil(F.size("e_words") * floor / F.lit(70.0) - F.lit(1e-9)))
    # a form that needs more words than any text has is never taken apart
    ew = forms.select("e_id", "e_words", F.size("e_words").alias("n"), least.alias("need"))
    ew = ew.filter((F.col("n") >= 2) & (F.col("need") <= most))
    words = ew.select("e_id", "need", "n", F.explode("e_words").alias("w"))
    qwords = texts.select("q_id", F.size("q_words").alias("n_q"), F.explode("q_words").alias("w"))
    freq = qwords.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(freq, "w", "left").withColumn(
        "r", F.row_number().over(Window.partitionBy("e_id").orderBy(F.coalesce("df", F.lit(0)), "w"))
    )
    prefix = ranked.filter((F.col("r") <= F.col("n") - F.col("need") + 1) & F.col("df").isNotNull())
    pairs = prefix.join(qwords, "w").filter(F.col("n_q") >= F.col("need")).select("e_id", "q_id").distinct()
    shared = F.size(F.array_intersect("q_words", "e_words"))
    counted = pairs.join(ew.select("e_id", "e_words", "n"), "e_id").join(texts.select("q_id", "q_words"), "q_id")
    counted = counted.select("e_id", "q_id", "n", shared.alias("shared")).filter("shared >= 2")
    return counted.select("e_id", "q_id", F.floor(F.lit(70) * F.col("shared") / F.col("n")).alias("base"))


def match_known(issues: DataFrame, queries: DataFrame, limit: int = MATCH_LIMIT) -> DataFrame:
    """The best known issues for each query text.

    ``issues``: issue_id, signature, kind, type, message_sample, field, resolution, last_seen.
    ``queries``: query_id, text.
    """
    q = queries.withColumn("raw", F.trim("text")).filter("raw <> ''").withColumn("q", c.mask_for_matching(F.col("raw"))).withColumn(
        "types", F.array_join(F.array_sort(c.exception_types(F.col("raw"))), " ")
    )
    # one row per distinct masked text and set of exception types; a signature stands for itself
    q = q.withColumn("sig", F.when(F.col("raw").rlike("^[0-9a-f]{16}$"), F.col("raw")).otherwise(""))
    # masked texts feed every branch below: written once to the shared folder
    q = cut_lineage(q.select("query_id", "q", "types", "sig").withColumn("q_id", _text_id("q", "types", "sig")))
    texts = q.select("q_id", "q", "types", "sig").dropDuplicates(["q_id"])
    texts = cut_lineage(texts.withColumn("q_words", c.words(F.col("q"))))
    shown = F.when(
        F.col("kind") == "field_report", F.concat(F.lit("field report "), F.coalesce("field", F.lit("")))
    ).otherwise(F.concat_ws(" ", F.coalesce("type", F.lit("")), F.coalesce("message_sample", F.lit(""))))
    i = issues.withColumn("msg", c.mask_for_matching(F.col("message_sample"))).withColumn(
        "lfield", F.lower(F.coalesce("field", F.lit("")))
    ).withColumn("ltype", F.lower(F.coalesce("type", F.lit(""))))
    # without a type an issue shows its message and nothing else: masked once, kept once
    other = F.coalesce(F.col("kind") == "field_report", F.lit(False)) | (F.col("ltype") != "")
    i = i.withColumn("e", F.when(other, c.mask_for_matching(shown)))
    i = i.withColumn("e_id", F.sha2(F.to_json(F.struct(F.coalesce("e", "msg").alias("e"), "msg", "lfield")), 256))
    # later passes read only their columns of these two
    i = written(i.select("issue_id", "signature", "e", "msg", "lfield", "ltype", "resolution", "last_seen", "e_id"), "known-issues")
    forms = i.groupBy("e_id").agg(
        F.first("e").alias("e"), F.first("msg").alias("msg"), F.first("lfield").alias("lfield"), F.max(F.col("ltype") != "").alias("typed")
    )
    forms = written(forms.select("e_id", "msg", "lfield", "typed", c.words(F.coalesce("e", "msg")).alias("e_words")), "issue-forms")

    msgs = forms.select(F.col("e_id").alias("s_id"), F.col("msg").alias("s_text"))
    qs = texts.select(F.col("q_id").alias("b_id"), F.col("q").alias("b_text"))
    within = _contained_pairs(msgs, qs).select(F.col("s_id").alias("e_id"), F.col("b_id").alias("q_id"))
    q_small = texts.select(F.col("q_id").alias("s_id"), F.col("q").alias("s_text"))
    m_big = forms.select(F.col("e_id").alias("b_id"), F.col("msg").alias("b_text"))
    around = _contained_pairs(q_small, m_big).select(F.col("b_id").alias("e_id"), F.col("s_id").alias("q_id"))
    fields = forms.select(F.col("e_id").alias("p_id"), F.col("lfield").alias("p_text"))
    named = patterns_inside(fields, texts.select(F.col("q_id").alias("t_id"), F.col("q").alias("t_text")))
    named = named.select(F.col("p_id").alias("e_id"), F.col("t_id").alias("q_id"))
    # each way of scoring yields its score with the pair, so no text is joined to the pairs again; the best way counts
    ways = within.unionByName(around).withColumn("base", F.lit(90)).unionByName(named.withColumn("base", F.lit(80)))
    scored = ways.unionByName(_shares(forms, texts)).groupBy("e_id", "q_id").agg(F.max("base").alias("base"))

    # issues of one form and type score alike for a text, so the best few of them are enough; a signature stands for itself
    i = i.select("e_id", "issue_id", "signature", "ltype", "resolution", "last_seen")
    keys = texts.select("q_id", "types", "sig")
    alike = Window.partitionBy("e_id", "ltype").orderBy(F.desc(F.col("resolution").isNotNull()), F.desc("last_seen"), "issue_id")
    few = i.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= limit).drop("nth")
    worded = few.join(scored, "e_id").join(keys, "q_id").filter((F.col("sig") == "") | (F.col("sig") != F.col("signature")))
    signed_ones = i.join(keys.filter("sig <> ''"), F.col("signature") == F.col("sig")).withColumn("base", F.lit(100))
    hits = worded.select(*signed_ones.columns).unionByName(signed_ones)
    typed = F.exists(F.filter(F.split("types", " "), lambda t: t != ""), lambda t: F.contains(F.col("ltype"), t)) & (F.col("ltype") != "")
    hits = hits.withColumn("score", F.when((F.col("base") > 0) & typed, F.col("base") + TYPE_BONUS).otherwise(F.col("base")))
    hits = hits.filter(F.col("score") >= MIN_SCORE).withColumn("score", F.least("score", F.lit(100)).cast("bigint"))
    order = Window.partitionBy("q_id").orderBy(
        F.desc("score"), F.desc(F.col("resolution").isNotNull()), F.desc("last_seen"), "issue_id"
    )
    best = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("q_id", "place", "issue_id", "score")
    return q.select("query_id", "q_id").join(best, "q_id").select("query_id", "place", "issue_id", "score")
