import random

from pyspark.sql import functions as F

from repoaudit.operators import ordering
from repoaudit.operators.ordering import in_parts, number_rows


def _rows(spark, n=5000):
    """One repository holds most rows; some keys are null."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        repo = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c", None])
        rows.append((repo, rng.randint(0, 3), f"f{rng.randint(0, 50)}", i))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "repo string, section int, file string, line int")


def test_numbers_equal_a_sequential_count(spark):
    rows, df = _rows(spark)
    got = number_rows(
        df, {"at": ["repo"], "row": ["repo", "section"]}, ["section", "file", "line"]
    ).collect()
    assert len(got) == len(rows)
    by_key = {(r.repo, r.section, r.file, r.line): r for r in got}
    at, row = {}, {}
    for key in sorted(rows, key=lambda r: (r[0] or "", *r[1:])):
        at[key[0]] = at.get(key[0], 0) + 1
        row[key[:2]] = row.get(key[:2], 0) + 1
        found = by_key[key]
        assert (found["at"], found["row"]) == (at[key[0]], row[key[:2]])
    for key in rows:
        found = by_key[key]
        assert (found.at_total, found.row_total) == (at[key[0]], row[key[:2]])


def test_a_large_group_is_split_over_partitions(spark):
    _, df = _rows(spark, 20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_rows(df, {"at": ["repo"]}, ["section", "file", "line"])
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 14_000


def test_many_groups_move_rows_once(spark):
    """Groups are many, the table that is broadcast has a row per partition, and no other step
    moves rows."""
    rows = [(f"r{i % 700}" if i % 3 else "hot", i % 5 if i % 11 else None, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "repo string, section int, line int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = number_rows(df, {"at": ["repo"], "row": ["repo", "section"]}, ["section", "line"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Above the broadcast, rows come straight from where they are stored.
    assert plan.lstrip().startswith("*") and "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    at, row, size = {}, {}, {}
    for key in rows:
        size[key[0]] = size.get(key[0], 0) + 1
    want = set()
    for key in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2])):
        at[key[0]] = at.get(key[0], 0) + 1
        row[key[:2]] = row.get(key[:2], 0) + 1
        want.add((*key, at[key[0]], row[key[:2]], size[key[0]]))
    assert {(r.repo, r.section, r.line, r["at"], r.row, r.at_total) for r in found} == want


def test_equal_rows_and_empty_partitions(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [(None, 2)] * 3, "repo string, line int")
    got = number_rows(df, {"at": ["repo"]}, ["line"]).collect()
    assert sorted(r["at"] for r in got if r.repo == "a") == list(range(1, 501))
    assert sorted((r["at"], r.at_total) for r in got if r.repo is None) == [(1, 3), (2, 3), (3, 3)]


def test_lists_in_parts_are_whole(spark):
    rows, df = _rows(spark, 1000)
    parts = in_parts(df, ["repo"], ["section", "file", "line"], F.col("line"), 64).collect()
    for repo in {r[0] for r in rows}:
        own = sorted((p for p in parts if p.repo == repo), key=lambda p: p.part)
        want = [r[3] for r in sorted((r for r in rows if r[0] == repo), key=lambda r: r[1:])]
        assert [x for p in own for x in p["items"]] == want
        assert all(len(p["items"]) <= 64 for p in own)
        assert {(p.parts, p.total) for p in own} == {(len(own), len(want))}


def test_no_rows(spark):
    _, df = _rows(spark, 10)
    assert number_rows(df.limit(0), {"at": ["repo"]}, ["line"]).count() == 0


def test_a_task_counts_in_one_python_worker(spark, monkeypatch):
    """What is frozen, and so computed in one task per partition, holds one count at most."""
    _, df = _rows(spark, 100)
    counts, freeze = [], ordering.freeze

    def counted(rows):
        counts.append(rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return freeze(rows)

    monkeypatch.setattr(ordering, "freeze", counted)
    number_rows(df, {"at": ["repo"], "row": ["repo", "section"]}, ["section", "file", "line"]).collect()
    assert sum(counts) == 2 and max(counts) == 1
