"""Registry lookups: metadata, age and popularity of packages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import times
from repoaudit.operators.joins import join_hot_keys

_KEYS = ["registry", "name"]


def one_per_package(meta: DataFrame) -> DataFrame:
    """Snapshot rows with each package once: of several, one that exists goes before one that
    does not, then the greatest version as text, then the latest creation."""
    first = [c for c in ("exists", "version", "created_at") if c in meta.columns]
    rest = [c for c in meta.columns if c not in (*_KEYS, *first)]
    best = F.max(F.struct(*first, *rest)).alias("_best")
    return meta.groupBy(*_KEYS).agg(best).select(*_KEYS, "_best.*")


def _looked_up(names: DataFrame, meta: DataFrame, registry: str | None) -> DataFrame:
    """Names with their metadata, if any. ``registry`` says where all of them are looked up."""
    if registry is not None:
        names = names.withColumn("registry", F.lit(registry))
    return join_hot_keys(names, one_per_package(meta), _KEYS)


def _lookup_error(registry: Column, missing: str) -> Column:
    label = F.when(registry == "npm", "npm").otherwise("PyPI")
    failed = F.concat(label, F.lit(" request failed: "), F.coalesce("lookup_error", F.lit("")))
    absent = F.concat(F.lit(missing), label)
    return F.when(F.coalesce("exists", F.lit(False)), None).when(
        F.col("lookup_status") == "error", failed
    ).otherwise(absent)


def check_registry(names: DataFrame, meta: DataFrame, registry: str) -> DataFrame:
    """Existence and metadata of each row of a table with a column ``name``.

    ``registry`` is ``pypi`` or ``npm``; ``meta`` comes from ``parse_snapshot``. The
    description of an npm package is in ``summary``; it has no ``home_page``.
    """
    rows = _looked_up(names, meta, registry)
    exists = F.coalesce(F.col("exists"), F.lit(False))

    def known(column: str) -> Column:
        return F.when(exists, F.col(column))

    return rows.select(
        "registry",
        F.col("name").alias("package_name"),
        exists.alias("exists"),
        F.when(exists, F.col("reported_name")).otherwise(F.col("name")).alias("name"),
        *[known(c).alias(c) for c in ("version", "summary", "author", "home_page", "license")],
        _lookup_error(F.col("registry"), "Package not found on ").alias("error"),
    )


def downloads_estimate(release_count: Column) -> Column:
    """A rough popularity from the number of releases."""
    return F.when(release_count > 50, "high").when(release_count > 10, "medium").otherwise("low")


def package_age(
    names: DataFrame, meta: DataFrame, as_of: datetime | None = None, registry: str = "pypi"
) -> DataFrame:
    """Age and popularity of each row of a table with a column ``name``.

    Any ``registry`` but ``npm``, whatever its case, means ``pypi``. A missing package
    keeps only its name, its registry and an error.
    """
    where = "npm" if registry.lower() == "npm" else "pypi"
    rows = _looked_up(names, meta, where)
    exists = F.coalesce(F.col("exists"), F.lit(False))
    age = times.age_in_days(F.col("created_at"), times.as_utc(as_of))
    return rows.select(
        F.when(exists, F.col("reported_name")).otherwise(F.col("name")).alias("name"),
        "registry",
        F.when(exists, F.col("created_date")).alias("created_date"),
        F.when(exists, F.col("version")).alias("latest_version"),
        F.when(exists, age).alias("age_days"),
        F.when(exists, downloads_estimate(F.col("release_count"))).alias("downloads_estimate"),
        _lookup_error(F.col("registry"), "Package not found on ").alias("error"),
    )
