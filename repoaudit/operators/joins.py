"""Joins whose left side may be dominated by a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 1000
HOT_ROWS = 100_000


def join_hot_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a right side that has one row per key.

    The keys with at least ``HOT_ROWS`` rows on the left, at most the ``HOT_KEYS`` most
    frequent ones, are joined by broadcast: the right side of that part has at most one
    row for each. Any other key is rare or holds less than 1/HOT_KEYS of the left rows,
    so the shuffle of the rest is even. Without such keys it is a plain join.

    The left side is read more than once, so callers freeze a costly one.
    """
    frequent = (
        left.groupBy(*keys)
        .count()
        .where(F.col("count") >= HOT_ROWS)
        .orderBy(F.desc("count"), *keys)
        .limit(HOT_KEYS)
        .select(*keys)
    )
    found = frequent.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys))).collect()
    if not found:
        return left.join(right, keys, "left")
    hot = F.broadcast(left.sparkSession.createDataFrame(found, frequent.schema))
    hot_right = F.broadcast(right.join(hot, keys, "left_semi"))
    often = left.join(hot, keys, "left_semi").join(hot_right, keys, "left")
    seldom = left.join(hot, keys, "left_anti").join(right, keys, "left")
    return often.unionByName(seldom)
