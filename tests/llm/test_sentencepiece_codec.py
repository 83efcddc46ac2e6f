"""The prefix table against the sentencepiece library, text by text."""

import hashlib
import random

import pytest
import sentencepiece

from faultline.llm.queries import model_path
from faultline.llm.sentencepiece_codec import Codec, encode_documents


@pytest.fixture(scope="module")
def pair():
    return Codec(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())


def same(pair, text):
    own, library = pair
    want = library.encode(text, add_eos=True)
    n, ids, decoded = own.encoded(text)
    assert [int(i) for i in ids.split()] == want == own.encode(text), repr(text[:60])
    assert n == len(want) and decoded == library.decode(want) == own.decode(want), repr(text[:60])


def test_texts_by_alphabet(pair):
    rng = random.Random(7)
    for letters in ("aab ", "theranion ", "éàü漢 \n", "0123456789 .,", "   a", "{}()[];=", "ÀÇÉ😀🎉 x▁", "</s>< 0x41>"):
        for _ in range(120):
            same(pair, "".join(rng.choice(letters) for _ in range(rng.randint(0, 50))))


def test_texts_of_pieces(pair):
    rng, pieces = random.Random(8), sorted(pair[0].ids)
    for _ in range(800):
        same(pair, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 10))).replace("▁", " "))


def test_very_long_words_and_spaces(pair):
    for text in ("a" * 20_000, " " * 5_000, "=" * 3_333 + "x", "ab" * 9_999, "", " ", "\n \t"):
        same(pair, text)


def test_decoding_any_ids(pair):
    own, library = pair
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.choice([*own.pieces, *own.bytes.values(), own.end_id]) for _ in range(8)]
        assert own.decode(ids) == library.decode(ids)


def test_odd_rows(spark, pair, odd_documents, no_documents):
    library = pair[1]
    got = encode_documents(odd_documents, model_path(), with_ids=True).collect()
    texts = {(r.doc_id, r.text or "") for r in odd_documents.collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}
    want = set()
    for key, text in texts:
        ids = library.encode(text, add_eos=True)
        want.add((key, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert found == want and len(got) == 10
    assert encode_documents(no_documents, model_path()).count() == 0


def test_parts_of_words_are_remembered(pair):
    own = Codec(model_path())
    same((own, pair[1]), "haus,baum haus.baum (haus) haus***")
    # words differ, the runs of letters in them are encoded once
    assert {"▁haus", "baum", "haus"} <= own._words.keys()
    assert own._parts.findall("▁haus,baum***\n漢字") == ["▁haus", ",", "baum", "***", "\n", "漢", "字"]
    for text in ("a.b" * 50 + ",", "x" * 70 + "..." + "y" * 70, "漢字仮名 ,漢字a", "▁▁ ,▁", "á.é"):
        same((own, pair[1]), text)


def test_borders_from_halves_are_those_of_merging(pair):
    own, rng = pair[0], random.Random(10)
    pieces = [p for p in sorted(own.ids) if p in own.automaton]
    few = [p for p in pieces if len(set(p)) <= 2]
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(4000)] + [(rng.choice(few), rng.choice(few)) for _ in range(4000)] + [(p, p) for p in few]
    for a, b in pairs:
        if not own._tied.search(a + b):
            assert own._apart(a, b) == (own._merge(a + b) == [a, b]), (a, b)
