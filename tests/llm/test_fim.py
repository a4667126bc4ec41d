"""Fill-in-the-middle against a plain per-row version and DuckDB."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from repoaudit.llm import fim, oracles
from repoaudit.llm.queries import op12_fill_in_middle
from tests.oracle_check import difference

TEXTS = [None, "", "a", "añ日🙂 b", "has <P> in it", "x <S>", "<M>", "<<P", "P><", "ends <", "two  words\nand lines\n\n", " ",
         "日" * 300 + "a" * 500 + "🙂é" * 400, "a" * 5000, "mixed é " * 700]


def plain(key, text, cut):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    bounds = cut(text)
    n = len(bounds) - 1
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[: bounds[a]], text[bounds[a] : bounds[b]], text[bounds[b] :]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def starts(pattern):
    def cut(text):
        found = [m.start() for m in re.finditer(pattern, text)]
        return [0, *found[1:], len(text)] if found else [0]

    return cut


CUTS = {"char": lambda text: list(range(len(text) + 1)), "word": starts(r"[^\x20\x09-\x0D]+"), "line": starts(r"(?:\A|(?<=\n))(?s:.)")}


@pytest.mark.parametrize("unit", sorted(CUTS))
@pytest.mark.parametrize("stretch", [fim.STRETCH, 64])
def test_rows_equal_the_plain_version(spark, monkeypatch, unit, stretch):
    monkeypatch.setattr(fim, "STRETCH", stretch)
    rows = [(k, t) for k in range(60) for t in [TEXTS[k % len(TEXTS)]]] + [(None, "null key"), (None, "null key"), (3, "again")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id int, text string, output string").repartition(2)
    got = fim.restore(fim.transform(docs, unit=unit)).collect()
    want = [(k, *plain(k, t, CUTS[unit]), t or "") for k, t in rows]
    key = repr
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=600), st.integers(1, 200), st.integers(2, 127))
def test_index_is_exact(gaps, stretch, error):
    offsets = np.cumsum(gaps)
    index = fim.RankIndex(error)
    for at in range(0, len(offsets), stretch):
        index.add(offsets[at : at + stretch])
    ranks = np.arange(len(offsets))
    assert np.array_equal(index.lookup(ranks), offsets)
    assert index.rests[0].dtype == np.int8


def test_even_offsets_are_one_segment():
    index = fim.RankIndex()
    index.add(np.arange(0, 300_000, 3))
    assert len(index.firsts) == 1 and not index.lookup(np.zeros(0, int)).size


def test_query_equals_sql(spark, tmp_path):
    assert difference(spark, "/root/testdata/sf0.001", op12_fill_in_middle, oracles.fill_in_middle()) is None


def test_other_sentinels_and_shares(spark):
    docs = spark.createDataFrame([(k, f"text number {k} <P>") for k in range(40)], "doc_id long, text string")
    marks = ("[PRE]", "[SUF]", "[MID]")
    rows = fim.restore(fim.transform(docs, plain_percent=0, spm_percent=100, sentinels=marks), sentinels=marks).collect()
    assert all(r.form == "spm" and r.restored == r.text and r.output.startswith("[SUF]") for r in rows)
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aa", "b", "c"), ("<P", "<P>", "x"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)
    with pytest.raises(ValueError):
        fim.transform(docs, unit="page")


def test_empty_table(spark):
    assert fim.fim_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
