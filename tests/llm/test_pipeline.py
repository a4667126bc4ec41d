"""The stages of the pipeline on the smallest tables, each against its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from repoaudit.llm import mixing
from tests.llm.test_operators import TestJaccard, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        steps[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns

    before, after = (df.collect() for df in steps["ngram_jaccard"])
    groups = TestJaccard.brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups.values()})

    before, after = ({r.doc_id: r for r in df.collect()} for df in steps["pii"])
    assert set(before) == set(after)
    changed = [k for k in after if after[k].text != before[k].text]
    assert changed and all("[" in after[k].text and after[k].n_chars == len(after[k].text) for k in changed)

    before, after = steps["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == copies

    before, after = (df.collect() for df in steps["packing"])
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after if r.piece == 0)
    assert all(r.text is None or words(r.text) is not None for r in before)
    used = Counter()
    for r in after:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_null_and_repeated_ids(spark):
    def text(name, n=12):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(None, text("a")), (None, text("b", 15)), (7, text("c")), (7, text("d", 20)), (3, text("e")), (9, text("e"))]
    rows += [(None, text("e")), (5, text("f")), (5, text("f")), (None, text("g")), (8, text("g")), (None, None), (4, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], schema)
    gone = Counter([(9, text("e")), (None, text("e")), (5, text("f")), (None, text("g"))])
    kept = corpus_pipeline.remove_near_copies(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows) - gone

    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r["size"]] += r.copies
    after = corpus_pipeline.repeat_by_source(spark, docs, "")
    found = Counter((r.doc_id, len(words(r.text))) for r in after.collect())
    assert found == +copies and found[None, 15] and found[7, 12] and found[7, 20]
