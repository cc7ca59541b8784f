import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokenization as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.DEFAULT_VOCABULARY), reason="needs the vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.serialise_model(T.read_ranks()))


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(T.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_tokenizer_and_round_trip(encoder, known, text):
    ids = encoder.encode(text)
    assert ids == known.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == text


@pytest.mark.parametrize("text", ["<|endoftext|> ▁x", "a  b \t\n\n c", " 　", "don't WE'LL", "0" * 500, "\U0001f469\U0001f3fd‍\U0001f4bb", "x" * 20_000])
def test_hard_texts(encoder, known, text):
    assert encoder.encode(text) == known.encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same(known, monkeypatch):
    monkeypatch.setattr(T, "CACHE_ENTRIES", 3)
    e = T.Encoder(T.serialise_model(T.read_ranks()))
    text = "one two three four five six one two seven"
    assert e.encode(text) == e.encode(text) == known.encode(text, add_special_tokens=False).ids


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (None, "a", 0)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in T.encode_corpus(spark, df).collect()}
    assert got[1] == [15496, 995] and got[2] == [] and got[3] == [] and len(got[None]) == 1
    assert {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(spark, df).collect()} == {1: 2, 2: 0, 3: 0, None: 1}
    assert T.encode_corpus(spark, df.where("false")).count() == 0


def test_long_batches_are_passed_on_in_parts(spark, monkeypatch):
    rows = [(i, "Hello world " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {r["doc_id"]: r["ids"] for r in T.encode_corpus(spark, df).collect()}
    code = T.encode_corpus
    monkeypatch.setattr(T, "FLUSH_IDS", 5)
    assert {r["doc_id"]: r["ids"] for r in code(spark, df).collect()} == whole and len(whole) == 200


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        T.serialise_model({b"a": 0, b"b": 2})
