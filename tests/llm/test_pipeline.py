"""Every stage against a plain version of it on its own input, on the given documents."""

import hashlib
from collections import Counter

import sentencepiece

import corpus_pipeline
from faultline.llm.common import stored
from faultline.llm.queries import model_path
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        kept.append(docs.collect())
        if name != "SentencePiece":
            assert docs.columns == columns
    given, lang, exact, near, mixed, encoded = kept
    assert {r.doc_id for r in lang} == {r.doc_id for r in given if any(c.isalpha() for c in r.text or "")}
    largest = {}
    for r in lang:
        largest[r.text] = max(largest.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(largest.values())
    assert sorted(r.doc_id for r in near) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in exact])})
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= {r.doc_id for r in near} and max(times.values()) <= 3
    total = sum(len(r.text.split()) for r in near)
    assert abs(sum(len(r.text.split()) for r in mixed) - total) < 0.1 * total
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = {r.doc_id: r.text for r in near}
    assert Counter(r.doc_id for r in encoded) == times
    for r in encoded:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "test-stage")
            if name != "SentencePiece":
                assert docs.columns == odd_documents.columns


def test_no_labelled_row(spark, odd_documents):
    docs = odd_documents.drop("lang").selectExpr("*", "cast(null as string) AS lang").select(odd_documents.columns)
    kept = corpus_pipeline.language_stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "2", "5", "6", "8", "None"])
