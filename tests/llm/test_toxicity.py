"""Held-out accuracy on the given labels, and odd texts."""

import zlib

from faultline.llm import toxicity
from faultline.llm.queries import op6_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    got = {r.doc_id: r for r in op6_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[k].predicted, y) for k, y in labels.items() if k in got and got[k].held_out]
    right = sum(p == y for p, y in held)
    caught = sum(p for p, y in held if y)
    assert right / len(held) > 0.95 and caught / sum(y for _, y in held) > 0.75


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (6, 1), (6, 0), (7, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(odd_documents, labels)
    rows = toxicity.score_documents(odd_documents, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    unlabelled = toxicity.train(odd_documents, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(odd_documents, unlabelled).collect()} == {0.5}
    assert toxicity.score_documents(no_documents, model).count() == 0
    only_ordinary = toxicity.train(odd_documents, labels.filter("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score_documents(odd_documents, only_ordinary).collect())


def test_window_distance_prefers_own_dictionary():
    ordinary = ("the quick brown fox jumps over the lazy dog while rain falls on the plain " * 20).encode()
    distance = toxicity.Distance(ordinary, b" grumblebert  snorkface ", b" meadowlark  riverbank ")
    assert distance("snorkface") > 2 > -2 > distance("riverbank")
    assert distance("quick") == 0
