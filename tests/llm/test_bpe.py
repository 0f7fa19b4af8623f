from __future__ import annotations

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrand.llm.bpe import VOCABULARY, Encoder, count_tokens, encode_corpus, encoder
from tokenizers import Tokenizer

reference = Tokenizer.from_file(VOCABULARY)
reference.encode_special_tokens = True


def ids(text):
    flat, offsets = encoder(VOCABULARY).encode([text])
    assert offsets.tolist() == [0, len(flat)]
    return flat.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ac\nthe", max_size=80))
def test_runs_of_few_letters(text):
    assert ids(text) == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 100_001, "ab" * 20_000, "<|endoftext|> it's ½ ²٣", " \n\n  b\t\t", "ё" * 5000, ""])
def test_long_words_and_special_strings(text):
    assert ids(text) == reference.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("lodestrand.llm.bpe.REMEMBERED", 50)
    code, rng = Encoder(VOCABULARY), random.Random(1)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(5)]
        flat, at = code.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_corpus(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(None, "x"), (7, None), (7, ""), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    want = sorted(((d, reference.encode(t or "", add_special_tokens=False).ids) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()), key=str) == want
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in count_tokens(df).collect()), key=str) == sorted(((d, len(i)) for d, i in want), key=str)
    assert encode_corpus(df.limit(0)).count() == 0
