"""Fingerprints by their definition, components against all pairs, slots of every size, and odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, distance=4):
    """Smallest member's place of the class of each value, by all pairs."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", " \t", "one", "A b\tC", "Zürich ÉTÉ a b c\x0bd\x0ce\rf\ng   h", "x y " * 300, "Ünïcode 👍 words go here and there and " * 7])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_long_text_in_portions(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_UNPACK", 64)
    assert simhash.fingerprint(text) == whole
    assert whole % (1 << 64) == plain_fingerprint(text)


def test_segments_cover_the_bits():
    assert simhash.segments(4, 3) == [(0, 21, 1), (21, 21, 1), (42, 22, 0)]
    assert simhash.segments(4, 5) == [(0, 12, 0), (12, 13, 0), (25, 13, 0), (38, 13, 0), (51, 13, 0)]
    for distance, count in ((4, 2), (1, 1)):
        with pytest.raises(ValueError):
            simhash.segments(distance, count)


def crowd(rng, centres, around, flips):
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(around):
            value = centre
            for b in rng.sample(range(64), rng.randint(0, flips)):
                value ^= 1 << b
            found.add(value)
    return sorted(found)


@pytest.mark.parametrize("block,pairs,segments,distance", [(2_048, 16, 3, 4), (16, 3, 3, 4), (5, 2, 5, 4), (40, 4, 4, 3), (9, 2, 2, 3)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, block, pairs, segments, distance):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(block)
    values = crowd(rng, 12, 9, 4) + crowd(rng, 2, 60, 7) + crowd(rng, 1, 50, 3)
    values = sorted(set(values) | {0, (1 << 64) - 1, 1, 1 << 63})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(3)
    up = {v: v for v in signed}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in simhash.links(table, distance, segments).collect():
        up[root(a)] = root(b)
    want = classes(values, distance)
    got = [root(v) for v in signed]
    # the same partition
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_forest_is_a_forest():
    rng = random.Random(4)
    values = np.array([v - (1 << 64) if v >> 63 else v for v in crowd(rng, 3, 40, 3)], np.int64)
    want = len(set(classes([int(v) % (1 << 64) for v in values])))
    assert len(simhash.forest(values, np.ones(len(values), bool), 4)) == len(values) - want


def test_documents_against_all_pairs(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts, start=100))
    rng.shuffle(rows)
    want_class = classes([plain_fingerprint(t) for _, t in sorted(rows)])
    keys = sorted(k for k, _ in rows)
    want = {k: (f"{plain_fingerprint(t):016x}", keys[c]) for (k, t), c in zip(sorted(rows), want_class, strict=True)}
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r[0]: (r[1], r[2]) for r in simhash.near_components(table).collect()} == want


def test_odd_documents(spark, odd_documents, no_documents):
    found = [tuple(r) for r in simhash.near_components(odd_documents).collect()]
    assert len(found) == odd_documents.count()
    by_key = {}
    for key, digits, component in found:
        by_key.setdefault(key, set()).add((digits, component))
    assert all(len(v) == 1 for v in by_key.values())
    assert by_key[3] == by_key[4] == {("0" * 16, 3)}
    assert by_key[1] == {(next(iter(by_key[2]))[0], 1)} and by_key[5] == {(next(iter(by_key[6]))[0], 5)}
    assert simhash.near_components(no_documents).count() == 0
    alone = odd_documents.filter("doc_id IS NULL")
    assert [r["component_id"] for r in simhash.near_components(alone).collect()] == [None]
    assert simhash.near_components(odd_documents.withColumn("text", F.lit(None).cast("string"))).select("component_id").distinct().collect() == [(1,)]
