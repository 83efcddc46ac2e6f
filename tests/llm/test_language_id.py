"""Held-out accuracy on the given documents, and odd texts."""

import zlib

import pytest

from faultline.llm import language_id
from faultline.llm.queries import op7_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op7_language_id(spark, SF).collect()}
    known = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in known)
    held = [r for r in known if got[r.doc_id].held_out]
    assert len(held) > 100
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark, odd_documents, no_documents):
    model = language_id.train(odd_documents)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r.language for r in language_id.language_columns(odd_documents, model).collect()}
    for without_letters in (3, 4, 7):
        assert got[without_letters].lang_pred == "und" and got[without_letters].score == 0
    assert got[1].lang_pred == "en" and got[5].lang_pred == "de"
    nothing = language_id.train(no_documents)
    assert [r.language.lang_pred for r in language_id.language_columns(odd_documents, nothing).collect()] == ["und"] * 10
    assert language_id.language_columns(no_documents, model).count() == 0


def test_blocks_of_a_long_text_hold_every_ngram(monkeypatch):
    text = "Ein Text über Blöcke, 👍 in two languages. " * 7
    whole = sorted(int(x) for part in language_id.ngram_buckets(text) for x in part)
    assert len(whole) == 3 * (len(text) + 2) - 3
    for size in (1, 2, 3, 7, 64, len(text) + 1):
        monkeypatch.setattr(language_id, "BLOCK_CHARS", size)
        assert sorted(int(x) for part in language_id.ngram_buckets(text) for x in part) == whole


def test_too_many_languages_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "x", f"l{i}") for i in range(3)], "doc_id int, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(docs)
