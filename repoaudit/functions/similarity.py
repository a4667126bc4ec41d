"""Name similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def close_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance of two lower-case names if it is 1 to ``limit``, else null.

    Names whose lengths differ by more cannot be that close and cost nothing.
    """
    distance = F.levenshtein(a, b, limit)
    possible = (F.abs(F.length(a) - F.length(b)) <= limit) & (a != b)
    return F.when(possible & distance.between(1, limit), distance)


def equal_positions(a: Column, b: Column) -> Column:
    """Number of positions at which two names hold the same letter, case ignored."""
    shorter = F.least(F.length(a), F.length(b))
    return F.size(
        F.filter(
            F.sequence(F.lit(0), shorter),
            lambda i: (i > 0) & (F.substr(F.lower(a), i, F.lit(1)) == F.substr(F.lower(b), i, F.lit(1))),
        )
    )
