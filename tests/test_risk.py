import pytest
from pyspark.sql import functions as F

from repoaudit.operators import risk
from repoaudit.schemas import API_FINDINGS, DEPENDENCY_FINDINGS, SECURITY_FINDINGS


def _dep(repo, package, exists, risk_=None, pos=0):
    return (repo, 0, pos, package, "requirements.txt", "pypi", exists, None, risk_, [], None)


def _sec(repo, severity, line=1):
    return (repo, "a.py", line, "c", 0, severity, "x", "d")


def _api(repo, line=1):
    return (repo, "a.py", line, 0, "requests", "nope", False, "s")


@pytest.fixture(scope="module")
def summarize(spark):
    def make(repos, dep=(), sec=(), api=()):
        spine = spark.createDataFrame([(r,) for r in repos], "repo string")
        tables = (
            spark.createDataFrame(list(dep), DEPENDENCY_FINDINGS),
            spark.createDataFrame(list(sec), SECURITY_FINDINGS),
            spark.createDataFrame(list(api), API_FINDINGS),
        )
        return risk.risk_summary(spine, *tables), tables

    return make


def test_score_bands(spark):
    scores = [-5, 0, 19, 20, 49, 50, 79, 80, 100, 220]
    rows = spark.createDataFrame([(s,) for s in scores], "s int").select(
        "s", risk.risk_level(risk.clamp(F.col("s"))).alias("level"), risk.clamp(F.col("s")).alias("c")
    )
    assert [(r.level, r.c) for r in rows.collect()] == [
        ("Low", 0), ("Low", 0), ("Low", 19), ("Medium", 20), ("Medium", 49), ("High", 50),
        ("High", 79), ("Critical", 80), ("Critical", 100), ("Critical", 100),
    ]


def test_weights(summarize):
    dep = [
        _dep("d", "gone", False, "high"),  # 20 + 15
        _dep("d", "null", None, None),
        _dep("d", "fine", True, "none"),
        _dep("d", "alike", True, "medium"),  # 15
    ]
    sec = [_sec("s", s) for s in ("critical", "high", "medium", "low")] + [_sec("s", None)]
    api = [_api("a"), _api("a", 2)]
    summary, _ = summarize("dsan", dep, sec, api)
    rows = {r.repo: r for r in summary.collect()}
    assert rows["d"].risk_score == 50
    assert (rows["d"].dependency_issues, rows["d"].non_existent, rows["d"].typosquats) == (4, 1, 2)
    assert rows["s"].risk_score == 15 + 10 + 5 + 2 + 2
    assert rows["a"].risk_score == 20
    assert (rows["n"].risk_score, rows["n"].risk_level, rows["n"].total_issues) == (0, "Low", 0)


def test_status_column_counts_as_missing(spark, summarize):
    _, (dep, _, _) = summarize("x", [_dep("x", "a", None)])
    dep = dep.withColumn("status", F.lit("NOT_FOUND"))
    summary = risk.risk_summary(spark.createDataFrame([("x",)], "repo string"), dep)
    assert summary.collect()[0].risk_score == 20


def test_absent_findings(spark):
    summary = risk.risk_summary(spark.createDataFrame([("x", "/a/b/")], "repo string, root string"))
    row = summary.collect()[0]
    assert (row.risk_score, row.repository, row.files_scanned) == (0, "b", 0)


def test_recommendations_in_order(summarize):
    dep = [_dep("all", "gone", False, "high", 1), _dep("all", "b", True, "medium", 2),
           _dep("typo", "c", True, "medium")]
    sec = [_sec("all", s) for s in ("critical", "high", "medium")] + [_sec("low", "low")]
    summary, (dep, _, _) = summarize(["all", "typo", "low", "none"], dep, sec, [_api("all")])
    rows = risk.recommendations(summary, dep).orderBy("repo", "rec_no").collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.repo, []).append((r.rec_no, r.text))
    assert [n for n, _ in texts["all"]] == [1, 2, 3, 4, 5, 6]
    assert texts["all"][0][1].startswith("**Remove non-existent packages** (`gone`). These")
    assert texts["all"][1][1].startswith("**Verify potentially typosquatted packages** (`gone`, `b`). Confirm")
    starts = ["**Immediately", "**Fix high", "**Address", "**Fix hallucinated"]
    assert all(t.startswith(s) for (_, t), s in zip(texts["all"][2:], starts))
    assert texts["typo"][0][0] == 1 and "(`c`)" in texts["typo"][0][1]
    assert texts["none"] == texts["low"] == [
        (1, "No critical issues found — keep following security best practices! 🎉")
    ]


def test_long_package_lists_go_on_in_parts(summarize):
    dep = [_dep("r", f"p{i:02d}", False, None, i) for i in range(25)]
    summary, (dep, _, _) = summarize("r", dep)
    whole = risk.recommendations(summary, dep).collect()
    parts = risk.recommendations(summary, dep, part_rows=10).orderBy("part").collect()
    assert len(whole) == 1 and len(parts) == 3
    assert " ".join(p.text for p in parts) == whole[0].text
