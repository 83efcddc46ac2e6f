"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Entities (e-mail and IP addresses, card and phone numbers) are found by pattern
in every whole text.  Which other terms give an entity away is estimated from
the corpus: a term t beside an entity e discloses the share PMI(t; e) / IC(e)
of it, where IC(e) = log(N / df(e)) and PMI(t; e) = log(N n(t, e) / (df(t) df(e))),
counted in whole documents.  1 means that t never occurs without e.  Terms above
the threshold, seen beside e in enough different contexts (so copies of one
document don't count), are spans of their own wherever they stand in the
documents of e.  A span is generalised if its general form (the domain, the
network, the shape of a word) discloses less than the threshold, else removed.

A term is a run of letters, or several joined by apostrophes or hyphens; a
joined word counts both as a whole and by its runs, without a possessive s.

Pairs are proposed by contexts of bounded length beside the mentions.  Those
whose document counts can't reach the threshold are left out, and for the
others the documents that hold both are counted.  All counts are partial before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Patterns fixed by the task.  Possessive forms and look-behinds find the same matches
# without backtracking: no match can start inside a run whose start failed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# share of an entity's information that a term may give away
DISCLOSURE = 0.8
LEAST_CONTEXTS = 3
# code points of context on each side of a mention
REACH = 120
# contexts that agree so close to the mention are one, as in repeated lines
NEAR = 24
# values of one stretch of a running sum, code points of one piece of a text
STRETCH = 256
PIECE = 512
_LETTER = r"[\p{L}\p{M}]"
_JOINED = rf"(?:['’‐-](?![sS](?!{_LETTER})){_LETTER}++)"
WORD = rf"{_LETTER}++{_JOINED}*+"
JOINED_WORD = rf"(?<!{_LETTER}){_LETTER}++{_JOINED}++"
LEAST_LETTERS = 3
# a letter that stands for each code point of an address where terms are sought
BLANK = "\u16a0"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, step: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each place of an int array what ``step`` makes of 0 and all values before it; by stretches, so that no long list is copied value by value."""

    def follow(first: Column, some: Column) -> Column:
        return F.aggregate(some, F.array(first.cast("int")).cast("array<int>"), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x)).cast("array<int>")))

    def combine(stretches: Column) -> Column:
        totals = F.transform(stretches, lambda some: F.aggregate(some, F.lit(0), step))
        inside = lambda heads: F.flatten(F.transform(stretches, lambda some, i: F.slice(follow(heads[i], some), F.lit(1), F.size(some))))
        return _with(follow(F.lit(0), totals), inside)

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / STRETCH).cast("int")), lambda i: F.slice(v, i * STRETCH + 1, F.lit(STRETCH)))
    return _with(values, lambda v: _with(cut(v), combine))


def _pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, for ``_part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (from 0) on; no more than the pieces that hold them are read."""
    first = F.floor(start / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, F.floor((start + length) / PIECE).cast("int") - first + 1), "")
    return F.substring(near, (start - first * PIECE + 1).cast("int"), length.cast("int"))


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<start, value>> of a pattern's matches; start in code points from 0."""

    def place(hits: Column, gaps: Column) -> Column:
        before = _before(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
        starts = F.zip_with(before, gaps, lambda b, g: b + F.length(g))
        return F.zip_with(starts, hits, lambda at, h: F.struct(at.alias("start"), h.alias("value")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _with(hits, lambda h: _with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)), lambda g: place(h, g)))
    return F.when(possible, found).otherwise(F.array().cast("array<struct<start: int, value: string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second from the right doubled and cast out by nines, is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.cast("bigint"), F.lit(0))) % 10 == 0


def _valid_ip(value: Column) -> Column:
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.when(F.length(plain(p)) <= 3, plain(p).cast("int")).otherwise(256) <= 255))


def _entities(text: Column) -> Column:
    """array<struct<start, rank, kind, end, value>> of all valid matches, in order."""
    number = lambda v: F.length(_digits(v))
    rules = (
        (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (IP, F.rlike(text, F.lit(IP)), _valid_ip),
        (CARD, F.rlike(text, F.lit(CARD)), lambda v: number(v).between(14, 19) & _luhn(_digits(v))),
        (PHONE, F.contains(text, F.lit("+")), lambda v: number(v).between(10, 15)),
    )
    def entity(rank: int):
        kind = F.lit(KINDS[rank]).alias("kind")
        return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), kind, (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"))

    def passes(valid):
        return lambda m: valid(m["value"])

    lists = [
        F.transform(F.filter(_matches(text, pattern, possible), passes(valid)), entity(rank))
        for rank, (pattern, possible, valid) in enumerate(rules)
    ]
    return F.array_sort(F.concat(*lists))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _general(kind: Column, value: Column) -> Column:
    """The general form of an entity: domain, network, leading digits."""
    return (
        F.when(kind == "email", F.concat(F.lit("@"), F.lower(F.regexp_extract(value, "@(.*)$", 1))))
        .when(kind == "ip", F.concat(F.regexp_extract(value, r"^([0-9]+\.[0-9]+)", 1), F.lit(".*.*")))
        .when(kind == "card", F.concat(F.substring(_digits(value), 1, 4), F.lit("*")))
        .otherwise(F.concat(F.lit("+"), F.substring(_digits(value), 1, 2), F.lit("*")))
    )


def _identity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _shape(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "X"), r"\p{Ll}", "x")


def _terms(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    low = F.lower(text)
    found = F.array_distinct(F.concat(F.split(low, r"[^\p{L}\p{M}]+"), F.regexp_extract_all(low, F.lit(JOINED_WORD), F.lit(0))))
    return F.filter(found, lambda w: F.length(w) >= LEAST_LETTERS)


def _occurrences(text: Column, terms: Column) -> Column:
    """array<struct<start, end, surface>> of all places of ``terms`` in a text, in order; of a joined word the whole goes before its runs.

    Words that overlap an e-mail address are none: the address is overwritten
    by letters of no term.
    """
    known = lambda w: F.array_contains(terms, F.lower(w))
    nothing = F.array().cast("array<struct<start: int, end: int, surface: string>>")
    place = lambda at, w: F.struct(at.cast("int").alias("start"), (at + F.length(w)).cast("int").alias("end"), w.alias("surface"))

    def places(m: Column) -> Column:
        at, word = m["start"], m["value"]
        runs = F.filter(_matches(word, _LETTER + "++", F.lit(True)), lambda r: known(r["value"]))
        return (
            F.when(known(word), F.array(place(at, word)))
            .when(F.rlike(word, F.lit("['’‐-]")), F.transform(runs, lambda r: place(at + r["start"], r["value"])))
            .otherwise(nothing)
        )

    hits = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    cover = lambda g, h: F.concat(g, F.coalesce(F.repeat(F.lit(BLANK), F.length(h)), F.lit("")))
    plain = F.when(F.contains(text, F.lit("@")), F.array_join(F.zip_with(F.split(text, EMAIL, -1), hits, cover), "")).otherwise(text)
    return _with(plain, lambda t: F.flatten(F.transform(_matches(t, WORD, F.lit(True)), places)))


def find_entities(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: uid, key, entities with their contexts, and the text t, null without entities unless all are kept (stored)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), whole_text(text).alias("t"))
    rows = rows.withColumn("found", _entities(F.col("t")))
    left = lambda p, s: F.when(s["start"] > REACH, F.regexp_replace(_part(p, s["start"] - REACH, F.lit(REACH)), r"^\S+", "")).otherwise(_part(p, F.lit(0), s["start"]))
    right = lambda p, n, s: F.when(s["end"] + REACH < n, F.regexp_replace(_part(p, s["end"], F.lit(REACH)), r"\S+$", "")).otherwise(_part(p, s["end"], F.lit(REACH)))
    context = lambda p, n, s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), left(p, s).alias("left"), right(p, n, s).alias("right"))
    around = _with(_pieces(F.col("t")), lambda p: _with(F.length("t"), lambda n: F.transform("found", lambda s: context(p, n, s))))
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int, value: string, left: string, right: string>>")
    around = F.when(F.size("found") > 0, around).otherwise(none)
    return stored(rows.select("uid", "key", around.alias("entities"), F.when(F.lit(keep_text) | (F.size("found") > 0), F.col("t")).alias("t")), "pii-entities")


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, df): in how many documents each term occurs, over the whole corpus."""
    words = docs.select(F.explode(_terms(whole_text(text))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def disclosing_terms(docs: DataFrame, entities: DataFrame, text: str = "text", threshold: float = DISCLOSURE, least_contexts: int = LEAST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """Spans (uid, start, end, general) of terms that give away an entity of their document; and entity counts."""
    mentions = entities.filter(F.size("entities") > 0).select("uid", F.explode("entities").alias("m")).select(
        "uid", _identity(F.col("m.kind"), F.col("m.value")).alias("entity"), _general(F.col("m.kind"), F.col("m.value")).alias("general"), "m.left", "m.right"
    )
    # other entities in a context are no terms
    around = F.regexp_replace(F.concat_ws(" ", "left", "right"), EMAIL, " ")
    beside = mentions.select("entity", F.xxhash64(F.right("left", F.lit(NEAR)), F.left("right", F.lit(NEAR))).alias("context"), F.explode(_terms(around)).alias("term")).distinct()
    corpus = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    per_entity = stored(mentions.select("uid", "entity", "general").distinct(), "pii-mentions")
    df_entity = stored(per_entity.groupBy(F.col("entity").alias("e")).agg(F.count(F.lit(1)).alias("df_e"), F.min("general").alias("general")), "pii-entity-counts")
    counts = stored(document_frequency(docs, text), "pii-df")
    n = F.lit(float(max(corpus, 1)))
    proposed = beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= least_contexts)
    proposed = proposed.join(df_entity.select("e", "df_e"), F.col("entity") == F.col("e")).join(counts, F.col("term") == F.col("word"))
    # both stand together in no more documents than the rarer alone: pairs that can't reach the threshold even so need no count
    most = F.log(n / F.greatest("df", "df_e")) / F.log(n / F.col("df_e"))
    proposed = stored(proposed.filter((F.col("df_e") < n) & (most >= threshold - 1e-9)).select(F.col("entity").alias("e2"), F.col("term").alias("t2"), "df", "df_e"), "pii-pairs")
    words = entities.filter(F.size("entities") > 0).select("uid", F.explode(_terms(F.col("t"))).alias("term"))
    # a term meets the entities it is proposed with, then those stay that are in the document: never all terms x all entities of one document
    pairs = words.join(proposed.select("e2", "t2"), F.col("term") == F.col("t2")).select("uid", F.col("e2").alias("entity"), "term")
    held = per_entity.select(F.col("uid").alias("u"), F.col("entity").alias("e"))
    pairs = stored(pairs.join(held, (F.col("uid") == F.col("u")) & (F.col("entity") == F.col("e")), "left_semi"), "pii-together")
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    share = F.log(n * F.col("n_te") / (F.col("df") * F.col("df_e"))) / F.log(n / F.col("df_e"))
    telling = together.join(proposed, (F.col("entity") == F.col("e2")) & (F.col("term") == F.col("t2"))).filter(share >= threshold).select(F.col("entity").alias("e3"), F.col("term").alias("t3"), "df_e")
    # a general form stands for at least as many documents as its most frequent word
    shapes = counts.groupBy(_shape(F.col("word")).alias("shape")).agg(F.max("df").alias("df_shape"))
    telling = telling.join(shapes, _shape(F.col("t3")) == F.col("shape"), "left")
    vague = F.log(n / F.greatest("df_shape", "df_e")) / F.log(n / F.col("df_e")) < threshold
    telling = telling.select("e3", "t3", F.coalesce(vague, F.lit(False)).alias("vague"))
    sought = pairs.join(telling, (F.col("entity") == F.col("e3")) & (F.col("term") == F.col("t3"))).groupBy(F.col("uid").alias("u")).agg(
        F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("vague"), F.col("term"))).alias("vague")
    )
    marked = entities.filter(F.size("entities") > 0).join(sought, F.col("uid") == F.col("u"))
    spans = marked.select("uid", "vague", F.explode(_occurrences(F.col("t"), F.col("terms"))).alias("x"))
    general = F.when(F.array_contains("vague", F.lower("x.surface")), _shape(F.col("x.surface")))
    return stored(spans.select("uid", "x.start", "x.end", general.alias("general")), "pii-terms"), df_entity


def _with_terms(entities: DataFrame, terms: DataFrame) -> DataFrame:
    listed = terms.groupBy(F.col("uid").alias("u")).agg(
        F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit(TERM).alias("kind"), "end")).alias("terms")
    )
    return entities.join(listed, F.col("uid") == F.col("u"), "left").drop("u")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``base`` and ``spans`` (arrays of start, rank, kind, end), in order.

    ``base`` holds the entities; ``spans`` the same and, anywhere in the text,
    the terms that disclose them.  A null text counts as empty; null keys and repeated rows are rows
    like any other; an empty table gives none; other columns take no part.
    Two entities of different kinds may overlap; terms overlap no entity.
    """
    entities = find_entities(docs, key, text)
    terms, _ = disclosing_terms(docs, entities, text)
    rows = _with_terms(entities, terms)
    base = _plain(F.col("entities"))
    both = F.array_sort(F.concat(base, F.coalesce("terms", F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>"))))
    return rows.select(F.col("key").alias(key), base.alias("base"), both.alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = DISCLOSURE) -> DataFrame:
    """Per row: key and ``text`` with every span generalised, or removed where its general form still discloses too much.

    A removed span leaves its kind in square brackets.  Of overlapping spans
    the one that starts first is replaced, and the others with it.
    """
    entities = find_entities(docs, key, text, keep_text=True)
    terms, counts = disclosing_terms(docs, entities, text, threshold)
    n = float(max(docs.count(), 1))
    mentions = entities.filter(F.size("entities") > 0).select("uid", F.explode("entities").alias("m")).select(
        "uid", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.kind").alias("kind"),
        _identity(F.col("m.kind"), F.col("m.value")).alias("entity"), _general(F.col("m.kind"), F.col("m.value")).alias("form"),
    )
    spread = mentions.select("uid", "form").distinct().groupBy(F.col("form").alias("f")).agg(F.count(F.lit(1)).alias("df_form"))
    judged = mentions.join(spread, F.col("form") == F.col("f")).join(counts.select("e", "df_e"), F.col("entity") == F.col("e"))
    safe = F.log(n / F.col("df_form")) < threshold * F.log(n / F.col("df_e"))
    replaced = judged.select("uid", "start", "end", F.when(safe, F.col("form")).otherwise(F.concat(F.lit("["), F.col("kind"), F.lit("]"))).alias("new"))
    replaced = replaced.unionByName(terms.select("uid", "start", "end", F.coalesce("general", F.lit(f"[{TERM}]")).alias("new")))
    listed = replaced.groupBy(F.col("uid").alias("u")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("spans"))

    def put(pieces: Column) -> Column:
        ends = F.transform("spans", lambda s: s["end"])
        # a span that starts before the end of an earlier one goes with it
        new = F.zip_with("spans", _before(ends, lambda a, x: F.greatest(a, x)), lambda s, at: F.when(s["start"] >= at, F.concat(_part(pieces, at, s["start"] - at), s["new"])).otherwise(""))
        return F.concat(F.array_join(new, ""), _with(F.array_max(ends), lambda end: _part(pieces, end, F.length("t") - end)))

    folded = _with(_pieces(F.col("t")), put)
    joined = entities.join(listed, F.col("uid") == F.col("u"), "left")
    return joined.select(F.col("key").alias(key), F.when(F.col("spans").isNull(), F.col("t")).otherwise(folded).alias(text))
