"""Single edits by their definition, variants against all pairs, halves of every size, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from faultline.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = []
    forms = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        forms[w] = (form, n, len(near), -near[0][0] if form else None)
    for w, (form, n, k, form_n) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, n, k, form_n))
    return sorted(out)


def plain_words(rows, noise):
    counts = Counter()
    for key, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_single_edits_of_all_pairs():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(150)})
    near, prefix = spelling.single_edits(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert near[i, j] == one_edit(a, b), (a, b)
            assert prefix[i, j] == len([k for k in range(1, min(len(a), len(b)) + 1) if a[:k] == b[:k]])


@pytest.mark.parametrize("block,tile,cells", [(2_048, 64, 1 << 22), (6, 3, 1 << 22), (5, 4, 40), (9, 1, 1)])
def test_variants_against_all_pairs(spark, monkeypatch, block, tile, cells):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "_CELLS", cells)
    rng = random.Random(block)
    words = {"".join(rng.choice("abñ") for _ in range(rng.randint(5, 9))) for _ in range(220)}
    words |= {"stammstamm" + c for c in "abcdefghijklmnopqrstuvwxyzé"} | {c + "endend" for c in "abcdefghijklmn"}
    counts = {w: rng.choice([5, 5, 6, 25, 26, 130, 700, 4_000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert sorted((tuple(r) for r in spelling.variants(table).collect())) == plain_variants(counts)


def test_roots_over_many_steps(spark):
    counts = {"a" * (20 - i): 5 ** (i + 1) for i in range(14)}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = sorted(tuple(r) for r in spelling.variants(table).collect())
    assert got == plain_variants(counts)
    assert {r[2] for r in got} == {"a" * 7}


@pytest.mark.parametrize("noise", [3, 199])
def test_documents(spark, noise):
    rng = random.Random(noise)
    words = ["Question", "questiön", "letters", "letter", "letterss", "ÀÉÎÕü", "ÀÉÎÕüx", "abcdef", "x×y÷zabc", "naïveté", "Naïvete"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) + ".") for i in range(60)] + [(None, "letters " * 30), (7, None), (8, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(tuple(r) for r in spelling.spelling_variants(table, noise=noise).collect()) == plain_variants(plain_words(rows, noise))


def test_very_long_words_and_odd_rows(spark, odd_documents, no_documents):
    long = "ab" * 30_000
    rows = [(1, " ".join([long] * 30 + [long[:-1]] * 5 + ["abcdefg"] * 5))]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[long[:-1]]["form"] == long and got[long]["n_near"] == 1 and got["abcdefg"]["root"] == "abcdefg"
    found = {r["word"]: r["n"] for r in spelling.spelling_variants(odd_documents, least=1).collect()}
    assert found == {"epsilon": 4}
    assert spelling.spelling_variants(no_documents).count() == 0
