"""Radix groups against a dictionary of texts."""

import random
from collections import Counter

import pytest

from faultline.llm.exact_dedup import keep_one, radix_groups


def expected(rows):
    keep, size = {}, Counter()
    for key, text in rows:
        t = text or ""
        size[t] += 1
        keep[t] = max((x for x in (keep.get(t), key) if x is not None), default=None)
    return Counter((key, keep[text or ""], size[text or ""]) for key, text in rows), len(size)


def check(spark, rows, **options):
    got = radix_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()
    want, groups = expected(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("first", [1, 4, 512])
def test_groups_are_those_of_equal_texts(spark, first):
    rng = random.Random(first)
    stems = ["", "a", "ab", "abc", "é", "éa", "a" * 300, "a" * 300 + "b", "a" * 512, "a" * 513]
    rows = [(i, rng.choice(stems) + rng.choice(["", "x", "xy"])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, None)]
    check(spark, rows, first_bytes=first)


def test_hot_group_with_one_key(spark):
    check(spark, [(5, "same text")] * 400 + [(i, f"own {i}") for i in range(20)])


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = radix_groups(odd_documents, carry=["source"]).collect()
    want, groups = expected(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == groups
    kept = keep_one(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == groups
    assert radix_groups(no_documents).count() == 0 and keep_one(no_documents).count() == 0
