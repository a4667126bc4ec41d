"""Alignment of two tokenizers against a plain version with the libraries as they are."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, decoders

from repoaudit.llm import align

TEXTS = [None, "", " ", "one", "Hello world, hello again.", "Hello world, hello again.", "été à la façon de l'œuvre", "日本語 テキスト 🙂🙂",
         "<s> not special </s> <|endoftext|> <unk>", "a▁b has the sign itself", "tabs\tand\nlines\r\n  spaces   ", "\x00\x01", "﻿mark",
         "don't 12345 3.14 <0x41>", "ab" * 300, "the the the the", "é combining", "word " * 200]


def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}
    return a, b, spelled


def brute(texts):
    a, b, spelled = libraries()
    rows, holders = [], defaultdict(set)
    for at, text in enumerate(texts):
        whole = (" " + (text or "")).encode()
        tokens_a = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in a.encode(whole.decode(), add_special_tokens=False).ids]
        tokens_b = []
        for i in b.encode(text or ""):
            piece = b.id_to_piece(i)
            tokens_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(t for _, t in tokens_a) != whole or b"".join(t for _, t in tokens_b) != whole:
            rows.append((0, 0, [], Counter()))
            continue
        spans = []
        for tokens in (tokens_a, tokens_b):
            end, side = 0, []
            for i, t in tokens:
                side.append((i, end, end + len(t)))
                end += len(t)
            spans.append(side)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in spans))
            low = high
        links = Counter((i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e)
        for pair in links:
            holders[pair].add(at)
        rows.append((len(tokens_a), len(tokens_b), groups, links))
    best = defaultdict(int)
    for (i, _), docs in holders.items():
        best[i] = max(best[i], len(docs))
    result = []
    for n_a, n_b, groups, links in rows:
        n_best = sum(n for (i, j), n in links.items() if len(holders[i, j]) == best[i])
        total = sum(n * len(holders[p]) for p, n in links.items())
        text = ";".join(groups)
        result.append((n_a, n_b, len(groups), sum(links.values()), n_best, total, hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return result


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("run,docs,fan,block,at_once", [(1 << 21, 1 << 16, 128, 1 << 14, 1 << 20), (40, 3, 2, 5, 200), (1, 1, 3, 2, 1)])
def test_rows_equal_brute_force(spark, monkeypatch, run, docs, fan, block, at_once):
    for name, value in (("RUN", run), ("DOCS", docs), ("FAN", fan), ("BLOCK", block), ("AT_ONCE", at_once)):
        monkeypatch.setattr(align, name, value)
    texts = TEXTS + [t for t in TEXTS if t and len(t) < 60] * 2
    rows = [(k if k % 4 else None, t, "x") for k, t in enumerate(texts)]
    found = align.link_counts(spark.createDataFrame(rows, "doc_id int, text string, _run string").repartition(3)).collect()
    want = [(r[0], *w[:-1]) for r, w in zip(rows, brute(texts))]
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in found), key=repr) == sorted(want, key=repr)


def test_groups_as_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r.groups for r in align.groups(docs).collect()}
    assert got == {k: w[-1] for k, w in enumerate(brute(TEXTS))}


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, ""), (None, "")]):
        found = align.align_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(found) == len(rows)
        assert all(tuple(r[c] for c in COLUMNS) == (0,) * 6 + ("",) for r in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 300), st.integers(1, 2**33), max_size=60), max_size=9), st.integers(1, 20))
def test_merge_sums_and_maxima(runs, block):
    before, align.BLOCK = align.BLOCK, block
    try:
        packed = []
        for run in runs:
            keys = np.array(sorted(run), np.int64)
            packed.append(align._pack(keys, *align._halves(np.array([run[k] for k in sorted(run)], np.int64))))
        merged = [(int(k), int(c), bool(b)) for blocks in align.with_best(align.merge_runs(packed), 3) for k, c, b in zip(*blocks)]
    finally:
        align.BLOCK = before
    total = Counter()
    for run in runs:
        total.update(run)
    best = {k >> 3: max(c for j, c in total.items() if j >> 3 == k >> 3) for k in total}
    assert merged == [(k, total[k], total[k] == best[k >> 3]) for k in sorted(total)]
