"""Positions in an order, and lists in bounded parts, when one key may hold most rows."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from repoaudit.session import freeze

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_ROWS = 1000


def _starts(batch: pa.RecordBatch, key: str, before: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one above it; null equals null."""
    column = batch.column(batch.schema.get_field_index(key))
    above = column[:1] if before is None else pa.array([before.as_py()], column.type)
    above = pa.concat_arrays([above, column[:-1]])
    both_null = pc.and_(pc.is_null(column), pc.is_null(above))
    same = pc.or_(pc.fill_null(pc.equal(column, above), False), both_null)
    return ~same.to_numpy(zero_copy_only=False)


def _counted(groups: dict[str, list[str]]):
    """A function that counts rows within runs of equal keys, one new column per group. Batches of
    a partition come one after the other; only the last row of a batch is kept."""

    def count(batches):
        before: dict[str, pa.Scalar] = {}
        reached = dict.fromkeys(groups, 0)
        for batch in batches:
            size = batch.num_rows
            if size == 0:
                continue
            at = np.arange(size)
            columns, fields = list(batch.columns), list(batch.schema)
            for name, keys in groups.items():
                new = np.zeros(size, bool)
                for key in keys:
                    new |= _starts(batch, key, before.get(key))
                # The place of the last start above each row; -1 goes on with the batch before.
                start = np.maximum.accumulate(np.where(new, at, -1))
                place = np.where(start < 0, reached[name] + at + 1, at - start + 1)
                reached[name] = int(place[-1])
                columns.append(pa.array(place.astype(np.int64)))
                fields.append(pa.field(name, pa.int64()))
            last = batch.slice(size - 1)
            before = {k: last.column(last.schema.get_field_index(k))[0] for ks in groups.values() for k in ks}
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return count


def _count_runs(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    added = df.select("*", *[F.lit(0).cast("bigint").alias(name) for name in groups])
    return df.mapInArrow(_counted(groups), added.schema)


def number_rows(df: DataFrame, groups: dict[str, list[str]], order: list[str]) -> DataFrame:
    """Add 1-based positions of the rows in ``order``, one column per group.

    ``groups`` maps a new column to its key columns, outermost group first; the keys of
    each group extend those of the one before, and are texts, whole numbers, dates or booleans.
    A column ``<name>_total`` holds the size of the group.

    A window would pull a whole group into one task. Here rows are range-partitioned, which splits
    a group of any size, and moved only this once. Where a partition is made, its rows are counted
    within each group in both directions, each after a sort of its own, which gives positions and
    sizes inside the partition. Rows are frozen after each count, so a task has one Python worker at a time. Only the first and the last group of a
    partition can go on in others, so one row per partition tells all that is missing. That table
    is broadcast; it grows with the number of partitions, not with that of groups.
    """
    names = list(groups)
    inner = groups[names[-1]]
    keys = inner + [c for c in order if c not in inner]
    up = {f"_up_{n}": groups[n] for n in names}
    down = {f"_down_{n}": groups[n] for n in names}
    ranged = df.repartitionByRange(*keys).withColumn("_id", F.monotonically_increasing_id())
    falling = ranged.sortWithinPartitions(*[F.col(c).desc() for c in [*keys, "_id"]])
    rising = freeze(_count_runs(falling, down)).sortWithinPartitions(*keys, "_id")
    rows = freeze(_count_runs(rising, up).withColumn("_part", F.shiftright("_id", 33)).drop("_id"))
    size = {n: F.col(f"_up_{n}") + F.col(f"_down_{n}") - 1 for n in names}
    joined = rows.join(F.broadcast(_edges(rows, groups, size)), "_part")
    added = []
    for name in names:
        key = F.struct(*groups[name])
        first, last = F.col(f"_first_{name}"), F.col(f"_last_{name}")
        at_first, at_last = key.eqNullSafe(first["key"]), key.eqNullSafe(last["key"])
        before = F.when(at_first, first["before"]).otherwise(F.lit(0))
        total = F.when(at_first, first["total"]).when(at_last, last["total"]).otherwise(size[name])
        added += [(F.col(f"_up_{name}") + before).alias(name), total.alias(f"{name}_total")]
    return joined.select(*df.columns, *added)


def _edges(rows: DataFrame, groups: dict[str, list[str]], size: dict[str, Column]) -> DataFrame:
    """Per partition and group column, ``(key, before, total)`` of its first and of its last group:
    the rows that earlier partitions have of that group, and those that all have."""
    names = list(groups)
    inner = groups[names[-1]]
    edge = F.struct(*inner, *[size[n].alias(f"_size_{n}") for n in names])
    ends = rows.groupBy("_part").agg(F.min(edge).alias("_min"), F.max(edge).alias("_max"))
    # Read once per group, and no larger than the number of partitions.
    ends = freeze(ends)
    found = ends.select("_part")
    for name in names:

        def piece(end: str) -> Column:
            key = F.struct(*[F.col(end)[c].alias(c) for c in groups[name]])
            return F.struct(key.alias("key"), F.col(end)[f"_size_{name}"].alias("rows"))

        both = F.array_distinct(F.array(piece("_min"), piece("_max")))
        pieces = ends.select("_part", F.posexplode(both).alias("_at", "_piece")).select("_part", "_at", "_piece.*")
        of_group = Window.partitionBy("key")
        earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        placed = pieces.select(
            "_part",
            "_at",
            F.struct(
                "key",
                F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
                F.sum("rows").over(of_group).alias("total"),
            ).alias("_edge"),
        )
        of_part = placed.groupBy("_part").agg(
            F.min_by("_edge", "_at").alias(f"_first_{name}"), F.max_by("_edge", "_at").alias(f"_last_{name}")
        )
        found = found.join(of_part, "_part")
    return found


def in_parts(
    df: DataFrame, group: list[str], order: list[str], value: Column, part_rows: int = PART_ROWS
) -> DataFrame:
    """Ordered lists of ``value`` per group as ``(group, part, parts, total, items)``.

    A list holds at most ``part_rows`` values; longer groups continue in further parts,
    so nothing is lost and no row grows without bound.
    """
    plain = df.select(*group, *[c for c in order if c not in group], value.alias("_value"))
    numbered = number_rows(plain, {"_at": group}, order)
    return _collect(numbered, group, part_rows)


def _collect(numbered: DataFrame, group: list[str], part_rows: int) -> DataFrame:
    part = ((F.col("_at") - 1) / part_rows).cast("bigint")
    parts = F.ceil(F.col("_at_total") / part_rows)
    lists = numbered.groupBy(
        *group, part.alias("part"), parts.alias("parts"), F.col("_at_total").alias("total")
    ).agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_items"))
    return lists.select(
        *group, "part", "parts", "total", F.col("_items._value").alias("items")
    )
