"""Encoding and decoding against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from repoaudit.llm import bpe, wordbpe

ODD = ["İstanbul", "ﬁn", "éa", "日本語テキスト", "a b", "x\x1cy", "ŉ", "ſt", "K", "½3²", "'S'll''s", "it's",
       "<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "<|", "🙂🙂", "﻿q", "×÷", "ÀÉÎõÿĿžſ", "don't123's", "\x00", "\x80", "¡hola!"]
TEXTS = [None, "", " ", "\t\n", "one", "One  TWO\tthree", "a b " * 50, " ".join(ODD), *ODD, "aaaa" * 40, "abcabc" * 30 + "'s" * 40,
         "x " + "né" * 60 + " y", "word " * 30 + "Zz" * 70 + "!?" * 40 + " end", " " * 80, " " * 90, "<|endoftext|>" * 9]


@pytest.fixture(scope="module")
def model():
    return wordbpe.load()


def expected(model, text):
    ids = model.library.encode(text or "", add_special_tokens=False).ids
    return ids, model.library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abeinst'ld 01.,-#é ßÉÿĿİ日é\n<|>S"), max_size=30), max_size=8))
def test_texts_in_bulk(texts):
    model = wordbpe.load()
    ids, starts = model.texts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == expected(model, text)[0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abceinorstz", min_size=2, max_size=120), st.integers(1, 9), st.data())
def test_pieces_of_a_word_join_to_its_encoding(word, leaf, data):
    model = wordbpe.load()
    pieces = list(bpe._unsplit(word, leaf, model))
    nodes = [bpe._encode_leaf(kind, piece, model) for kind, _, piece in pieces]
    assert bpe.join_all(nodes, [p[1] for p in pieces], model).tolist() == expected(model, word)[0]


def test_repeated_letters_shift_a_whole_side(model):
    """The window has to grow over a whole side where letters repeat."""
    for n in (5, 17, 63, 200, 1001):
        for leaf in (3, 7, 50):
            word = "a" * n
            found = list(bpe.leaves(word, leaf, model))
            nodes = [bpe._encode_leaf(kind, piece, model) for kind, _, piece in found]
            assert bpe.join_all(nodes, [f[1] for f in found], model).tolist() == expected(model, word)[0]


@pytest.mark.parametrize("leaf,fan", [(7, 2), (20, 3), (bpe.LEAF, bpe.FAN)])
def test_rows_equal_the_library(spark, monkeypatch, model, leaf, fan):
    monkeypatch.setattr(bpe, "FAN", fan)
    rows = list(enumerate(TEXTS)) + [(None, "null key"), (None, "null key"), (3, "repeated " * 9)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id int, text string, _row string").repartition(3)
    got = bpe.decode(bpe.encode(docs, leaf=leaf)).collect()
    want = [(k, expected(model, t)) for k, t in rows]
    assert sorted(((r.doc_id is None, r.doc_id or 0, list(r.ids), r.decoded) for r in got)) == sorted(
        (k is None, k or 0, ids, text) for k, (ids, text) in want
    )


def test_digest(spark, model):
    docs = spark.createDataFrame([(1, "Some text, some MORE"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.bpe_digest(docs).collect()}
    for key, text in ((1, "Some text, some MORE"), (2, "")):
        ids, back = expected(model, text)
        assert rows[key].n_tokens == len(ids)
        assert rows[key].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[key].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table_and_null_ids(spark):
    assert bpe.bpe_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    ids = spark.createDataFrame([(None,), ([],), ([320],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(ids.coalesce(1)).collect()] == ["", "", "a</w>"]


def test_long_text_without_white_space(spark, model):
    """More leaves than one task joins, over parts of several kinds."""
    rng = random.Random(5)
    text = "".join(rng.choice("etaoin") for _ in range(60_000)) + "12" * 500 + "<|endoftext|>" + "é" * 9_000
    docs = spark.createDataFrame([(1, text), (2, text + " " + "tail " * 4_000)], "doc_id long, text string")
    for row in bpe.encode(docs, leaf=1_000).collect():
        whole = text if row.doc_id == 1 else text + " " + "tail " * 4_000
        assert np.array_equal(row.ids, expected(model, whole)[0])
