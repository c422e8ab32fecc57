import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.conftest import rows_of

from halfstar.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(PATH)


def test_encodes_like_the_library(model, vocabulary):
    rng = random.Random(5)
    texts = ["", " ", "  a", "a  b ", "<s> </s> <0x0A> <unk>", "▁a ▁", "\n\n\t", "a" * 3000, "ab " * 3000, "ॐ🏳️‍🌈"]
    texts += [" " * n + "q" + " " * (40 - n) for n in range(40)]
    texts += ["".join(rng.choice("ab ▁\nthe inér😀ह#%") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(vocabulary.pieces[rng.randrange(259, 32000)] for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    assert pieces._Texts(vocabulary).batch(texts).to_pylist() == model.encode(texts)


def test_decodes_like_the_library(model, vocabulary):
    rng = random.Random(6)
    texts = pieces._id_texts(vocabulary)
    lists = [[rng.randrange(0, 300) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    assert [pieces.decode_ids(vocabulary, texts, ids) for ids in lists] == [model.decode(ids) for ids in lists]


def test_forgets_words_and_cuts_long_texts(model, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 50)
    monkeypatch.setattr(pieces, "SLICE_WORDS", 20)
    texts = [" ".join(f"w{i * j % 97}" for i in range(100)) for j in range(1, 9)]
    assert pieces._Texts(vocabulary).batch(texts).to_pylist() == model.encode(texts)


def test_tables(model, hard_docs, no_docs, make_docs):
    kept = hard_docs.select("doc_id", "text", "_id", "kept")
    encoded = pieces.encode_texts(kept, PATH)
    decoded = pieces.decode_texts(encoded, PATH)
    assert encoded.columns == ["doc_id", "_id", "kept", "ids"]
    want = sorted(repr((r.doc_id, model.encode(r.text or ""), model.decode(model.encode(r.text or "")))) for r in kept.collect())
    assert sorted(repr((r.doc_id, r.ids, r.decoded)) for r in decoded.collect()) == want
    assert pieces.encode_texts(no_docs, PATH).count() == 0
    nulls = make_docs(rows_of(["a"])).selectExpr("doc_id", "cast(null as array<int>) as ids")
    assert [r.decoded for r in pieces.decode_texts(nulls, PATH).collect()] == [""]
