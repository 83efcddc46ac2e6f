"""Entities against the stated patterns, terms by hand, and sanitised texts."""

import random
import re

from pyspark.sql import functions as F

from faultline.llm import pii

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def entities(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_entities_by_pattern(spark):
    rng = random.Random(4)
    parts = ["a.b@c.d", "x", "@", ".", " ", "+1 (555) 123-4567", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4", "-", "é", "😀", "a_", "@e.f", "%", "(", "\n", "+", "3782822463100050", "001.02.3.255"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(900)]
    texts += [None, "", "a" * 60_000, "1" * 60_000, "a." * 20_000 + "@", "@a" * 20_000, "+1" + " " * 30_000, "x@" + "a." * 20_000 + "b", "1.2.3.4 " * 400]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.detect(table).collect()}
    assert all(got[i] == entities(t) for i, t in enumerate(texts))


def story(spark):
    rows = [(1, "Call Zorgon at a.b@mail.com or come by"), (2, None), (3, "then zorgon wrote to a.b@mail.com at last"), (4, "so a.b@mail.com is Zorgon, indeed"), (5, "Zorgon 10.1.2.3"), (6, "Zorgon")]
    rows += [(i, "call then wrote indeed come last y@mail.com") for i in range(7, 40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_terms_that_disclose(spark):
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.detect(story(spark)).collect()}
    assert got[1] == [(5, 4, "term", 11), (15, 0, "email", 27)] and got[4] == [(3, 0, "email", 15), (19, 4, "term", 25)]
    # common words beside the entity, and the term where no entity is, stay
    assert got[2] == [] and got[6] == [] and got[5] == [(7, 1, "ip", 15)] and len(got[7]) == 1


def test_sanitised_texts(spark):
    got = {r.doc_id: r.text for r in pii.sanitise(story(spark)).collect()}
    assert got[1] == "Call Xxxxxx at @mail.com or come by" and got[4] == "so @mail.com is Xxxxxx, indeed"
    assert got[2] == "" and got[6] == "Zorgon" and got[5] == "Zorgon [ip]"


def test_odd_rows(spark, odd_documents, no_documents):
    assert all(r.spans == [] for r in pii.detect(odd_documents).collect()) and pii.detect(odd_documents).count() == 10
    assert pii.detect(no_documents).count() == 0 and pii.sanitise(no_documents).count() == 0
    assert sorted(r.text for r in pii.sanitise(odd_documents).collect()) == sorted(r.text or "" for r in odd_documents.collect())


def test_terms_far_from_the_entity(spark):
    gap = " and so on" * 30
    names = ["Zorgon", "O'Brien", "Anna-Lena", "Blorb"]
    mails = ["a.b@mail.com", "c.d@mail.com", "e.f@mail.com", "g.h@mail.com"]
    rows = []
    for k, (name, mail) in enumerate(zip(names, mails)):
        # beside the entity in three documents, further apart in five more
        rows += [(10 * k + i, f"{word} we {name} at {mail} or {word}") for i, word in enumerate(("call", "meet", "hire"))]
        rows += [(10 * k + 3 + i, f"{name.upper()} was here{gap} {mail}{gap} and \"{name}'s ({name})/{name}, {name}ing.") for i in range(5)]
    rows += [(100 + i, f"call we at or meet hire was here and so on ing Anna and Lena {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [r_ for r_ in r.spans if r_.kind == "term"] for r in pii.detect(docs).collect()}
    texts = dict(rows)
    for k, name in enumerate(names):
        for i in range(8):
            text = texts[10 * k + i]
            want = [m.start() for m in re.finditer(re.escape(name) + r"(?![a-z]{2})", text, re.I)]
            assert len(want) == (1 if i < 3 else 4)
            assert [(s.start, text[s.start : s.end].lower()) for s in got[10 * k + i]] == [(at, name.lower()) for at in want]
    assert not any(got[100 + i] for i in range(100))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(name in clean[10 * k + i].replace(f"{name}ing", "") for k, name in enumerate(names) for i in range(8))


def test_very_many_matches_in_one_text(spark):
    import time

    cards = " ".join(f"n{i}@m{i}.example.com 10.{i % 200}.{i // 200 % 200}.7" for i in range(50_000))
    texts = [cards, "é😀 " * 700 + "a@b.c" + " ü😀" * 700, "x@y.z " * 3_000]
    started = time.time()
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert time.time() - started < 100
    assert all(got[i] == entities(t) for i, t in enumerate(texts))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert "@" not in clean[1].replace("@b.c", "") and clean[1].startswith("é😀 " * 700) and clean[1].endswith(" ü😀" * 700)
    assert clean[0].count(" ") == cards.count(" ")


def test_contexts_and_parts_of_texts(spark):
    rng = random.Random(11)
    rows = [("".join(rng.choice("aé😀 \n") for _ in range(rng.choice((0, 5, 511, 512, 513, 1_500)))), rng.randint(0, 1_600), rng.randint(0, 700)) for _ in range(200)]
    table = spark.createDataFrame(rows, "t string, start int, n int")
    for r in table.select("*", pii._part(pii._pieces(F.col("t")), F.col("start"), F.col("n")).alias("part")).collect():
        assert r.part == r.t[r.start : r.start + r.n]
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 900)]
    sums = spark.createDataFrame([(x,) for x in lists], "v array<int>").select("v", pii._before(F.col("v")).alias("b"), pii._before(F.col("v"), lambda a, x: F.greatest(a, x)).alias("m")).collect()
    for r in sums:
        assert r.b == [sum(r.v[:i]) for i in range(len(r.v))] and r.m == [max([0, *r.v[:i]]) for i in range(len(r.v))]


def test_terms_overlap_no_address(spark):
    rows = [(i, f"{w} Zorgon at zorgon@mail.com or xzorgon@mail.comzorgon {w}, éZorgon@mail.com") for i, w in enumerate(("call", "meet", "hire", "so"))]
    rows += [(100 + i, f"call meet hire so at or com mail {i}") for i in range(100)]
    for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("doc_id < 100").collect():
        text = dict(rows)[r.doc_id]
        terms = [(s.start, text[s.start : s.end]) for s in r.spans if s.kind == "term"]
        assert terms == [(text.index("Zorgon"), "Zorgon")]
