"""Scalar rules as Column expressions: text, hashes, dates, rounding, URLs, JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
LITERALS = r"(?U)'[^']*'|:\w+|\b\d+\b"
LITERALS_BOTH_QUOTES = r"(?U)'[^']*'|\"[^\"]*\"|:\w+|\b\d+\b"
RECORD_ID = r"(?U)\b(?=[a-zA-Z]*\d)[a-zA-Z0-9]{15}(?:[a-zA-Z0-9]{3})?\b"
WORD = r"[a-z_][a-z0-9_.]{2,}"
STOP_WORDS = (
    "the and for with this that was are not from line column class trigger attempt error "
    "exception system"
).split()
EXCEPTION_TYPE = r"\b(?:[A-Za-z]+\.)?[A-Za-z]*(?:Exception|Error)\b"
LABEL_UNSAFE = r"[^A-Za-z0-9_.:\-/ ()@+]"
LOG_LEVELS = "NONE ERROR WARN INFO DEBUG FINE FINER FINEST".split()
JOB_NAME = r"(?i)queu|queable|job|batch|schedul|async|future|worker"
UNASSIGNED = "__unassigned__"
MAX_ACCOUNT = 80
MAX_LABEL = 120
EMPTY_INFO_LINE = r"(?im)^[^\n]{0,80}:-[ \t]*(No Information Available|N/?A|None)?[ \t]*$"
# -----------------------------------------------------------------------------


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def compact_time(text: Column) -> Column:
    """The leading ``yyyyMMddTHHmmssZ`` of an id."""
    return F.try_to_timestamp(F.split(text, "_")[0], F.lit("yyyyMMdd'T'HHmmss'Z'"))


def age_days(seconds: Column) -> Column:
    return F.bround(seconds / F.lit(86400.0), 1)


def half_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


def ratio(top: Column, bottom: Column, places: int, scale: float = 1.0) -> Column:
    """Rounded quotient; 0 where there is nothing to divide by."""
    return F.coalesce(
        F.bround(top / F.nullif(bottom, F.lit(0)) / F.lit(scale), places), F.lit(0.0)
    )


def whole(text: Column) -> Column:
    """Lenient whole number: fractions are cut, anything unreadable is 0."""
    cut = F.expr("try_cast(NULL AS BIGINT)")
    as_double = text.try_cast("double")
    return F.coalesce(as_double.cast("bigint"), cut, F.lit(0).cast("bigint"))


def mask_literals(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, LITERALS, "?"))


def mask_for_matching(text: Column) -> Column:
    masked = F.regexp_replace(F.coalesce(text, F.lit("")), RECORD_ID, "?")
    masked = F.regexp_replace(masked, LITERALS_BOTH_QUOTES, "?")
    return F.lower(F.trim(F.regexp_replace(masked, r"\s+", " ")))


def words(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(WORD), 0)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def exception_types(text: Column) -> Column:
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(EXCEPTION_TYPE), 0), F.lower)
    )


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, n: int = 180) -> Column:
    s = squeeze(text)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def slug(text: Column, fallback: str = "log") -> Column:
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\-_]", "_")
    kept = F.regexp_replace(kept, "^_+|_+$", "")
    return F.when(kept == "", fallback).otherwise(kept)


def account_name(text: Column) -> Column:
    name = squeeze(text)
    return F.when(name == "", None).otherwise(name)


def account_key(text: Column) -> Column:
    return F.coalesce(F.lower(account_name(text)), F.lit(UNASSIGNED))


def account_problem(text: Column) -> Column:
    """Why an account name is refused; null when it is fine."""
    name = account_name(text)
    return (
        F.when(name.rlike(r"[\x00-\x1f\x7f]"), "control characters")
        .when(F.length(name) > MAX_ACCOUNT, "too long")
    )


def safe_label(text: Column, limit: int = 60) -> Column:
    kept = F.regexp_replace(F.substring(F.trim(text), 1, limit), LABEL_UNSAFE, "")
    return F.when(kept == "", None).otherwise(kept)


def host(url: Column) -> Column:
    text = F.trim(F.coalesce(url, F.lit("")))
    text = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    text = F.regexp_extract(text, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(text)


def my_domain(url: Column) -> Column:
    h = host(url)
    first = F.split(h, r"\.")[0]
    known = h.contains(".my.salesforce.com") | h.contains(".my.site.com") | h.contains(".force.com")
    name = F.split(first, "--")[0]
    return F.when(known & ~first.rlike(r"^(na|cs|eu|ap|um|gs)\d+$") & (name != ""), name)


def environment(url: Column) -> Column:
    h = host(url)
    sandbox = (
        h.contains(".sandbox.") | h.startswith("test.") | h.rlike(r"^cs\d+\.")
        | F.split(h, r"\.")[0].contains("--")
    )
    return (
        F.when(h == "", "unknown")
        .when(h.contains(".scratch."), "scratch")
        .when(h.contains(".develop."), "developer")
        .when(sandbox, "sandbox")
        .when(h.contains("salesforce.com") | h.contains("force.com"), "production")
        .otherwise("unknown")
    )


def field_namespace(field: Column) -> Column:
    ns = F.regexp_extract(field, r"^([A-Za-z0-9]+)__.+__c$", 1)
    return F.when(ns != "", ns)


def bracket_line(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^\[(\d+)\]$", 1).try_cast("bigint")


def callee(signature: Column) -> Column:
    return F.trim(F.split(signature, r"\(")[0])


def query_object(query: Column) -> Column:
    name = F.regexp_extract(query, r"(?i)\bFROM\s+([A-Za-z0-9_]+)", 1)
    return F.when(name != "", name)


def header_version(header: Column) -> Column:
    first = F.split(F.trim(header), r"\s+")[0]
    return F.when(first.rlike(r"^\d+(\.\d+)?$"), first)


def header_levels(header: Column) -> Column:
    """Level map of a log's first line; pieces without a comma are dropped."""
    flags = F.regexp_replace(F.trim(header), r"^\d+(\.\d+)?(\s+|$)", "")
    pieces = F.filter(F.transform(F.split(flags, ";"), lambda x: F.trim(x)), lambda p: p.rlike(r"^\s*[^,\s][^,]*,"))
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, r"^([^,]*),", 1)).alias("k"),
            F.trim(F.regexp_extract(p, r"^[^,]*,(.*)$", 1)).alias("v"),
        ),
    )
    return F.map_from_entries(pairs)


def level_at_least(levels: Column, category: str, want: str) -> Column:
    order = F.array(*[F.lit(x) for x in LOG_LEVELS])
    have = F.array_position(order, F.upper(F.coalesce(F.element_at(levels, category), F.lit("NONE"))))
    return (have > 0) & (have >= LOG_LEVELS.index(want) + 1)


def version_parts(text: Column) -> Column:
    ok = text.rlike(r"^\s*\d+(\.\d+)*\s*$")
    parts = F.transform(F.split(text, r"\."), lambda p: F.trim(p).cast("int"))
    return F.when(ok, parts).otherwise(F.array(F.lit(0)))


def signature_hash(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 16)


def source_literal(text: Column) -> Column:
    """Type of a right-hand side: boolean, null, number, string, else a reference."""
    t = F.trim(text)
    return (
        F.when(F.lower(t).isin("true", "false"), "boolean")
        .when(F.lower(t) == "null", "null")
        .when(t.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(t.startswith("'") & t.endswith("'"), "string")
        .otherwise("reference")
    )


def shown_value(value: Column) -> Column:
    """Display text of a value node."""
    return F.when(value["is_blank_assignment"], "(blank)").otherwise(
        F.coalesce(value["value"], value["expression"], value["kind"])
    )


def json_size(value: Column) -> Column:
    return F.length(F.to_json(value))


def without_empty_lines(text: Column) -> Column:
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), EMPTY_INFO_LINE, "")
    return F.regexp_replace(F.regexp_replace(cleaned, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches; start is the true offset from 0, in characters.

    Offsets are the lengths of what lies between the matches and of the matches before.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def upto(lengths: Column, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, x: a + x)

    return F.transform(hits, lambda h, i: F.struct((upto(F.transform(gaps, F.length), i + 1) + upto(F.transform(hits, F.length), i)).alias("start"), h.alias("value")))
