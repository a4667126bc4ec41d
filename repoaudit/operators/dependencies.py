"""Dependency audit: the dependencies of each repository against a registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import times
from repoaudit.operators import manifests
from repoaudit.operators.joins import join_hot_keys
from repoaudit.operators.ordering import PART_ROWS, in_parts
from repoaudit.operators.registry import one_per_package
from repoaudit.operators.typosquat import risk_level, typosquat_candidates, with_similar
from repoaudit.rules import NEW_PACKAGE_DAYS, POPULAR_PACKAGES
from repoaudit.session import freeze

FINDING_ORDER = ["file_ord", "source_file", "pos", "package"]


def is_new(age_days: Column) -> Column:
    return F.coalesce(age_days < NEW_PACKAGE_DAYS, F.lit(False))


def is_nonexistent(findings: DataFrame) -> Column:
    """Known not to exist; a null ``exists`` does not count."""
    missing = F.coalesce(~F.col("exists"), F.lit(False))
    if "status" in findings.columns:
        missing = missing | (F.lower(F.coalesce("status", F.lit(""))) == "not_found")
    return missing


def has_typosquat_risk() -> Column:
    return F.coalesce(F.col("typosquat_risk") != "none", F.lit(False))


def check_dependencies(
    deps: DataFrame, meta: DataFrame, as_of: datetime | None = None, known=POPULAR_PACKAGES
) -> DataFrame:
    """Findings for a table of distinct dependencies, one row each.

    Lookup and age come from one join. The comparison with a list of known names needs
    none; a ``(name, ord)`` table of them is joined once per distinct package. Several rows of
    a package in ``meta`` count as one.
    """
    deps = freeze(deps)
    columns = meta.select("registry", "name", "exists", "version", "created_at")
    wanted = one_per_package(columns).withColumnRenamed("name", "package")
    rows = join_hot_keys(deps, wanted, ["registry", "package"])
    if isinstance(known, DataFrame):
        names = deps.select(F.col("package").alias("name")).distinct()
        risks = typosquat_candidates(names, known).select(
            F.col("name").alias("package"), "similar_to"
        )
        rows = join_hot_keys(rows, risks, ["package"])
    else:
        rows = with_similar(rows, "package", known or POPULAR_PACKAGES)
    exists = F.coalesce(F.col("exists"), F.lit(False))
    return rows.select(
        "repo",
        "file_ord",
        "pos",
        "package",
        "source_file",
        "registry",
        exists.alias("exists"),
        F.when(exists, F.col("version")).alias("version"),
        risk_level(F.col("similar_to")).alias("typosquat_risk"),
        F.col("similar_to").alias("typosquat_similar_to"),
        F.when(exists, times.age_in_days(F.col("created_at"), times.as_utc(as_of))).alias("age_days"),
    )


def scan_dependencies(
    files: DataFrame, meta: DataFrame, as_of: datetime | None = None, known=POPULAR_PACKAGES
) -> DataFrame:
    """Dependency findings of the ``source_files`` table."""
    return check_dependencies(manifests.dependencies(files), meta, as_of, known)


def warnings(findings: DataFrame) -> DataFrame:
    """One row per finding and kind of warning, ``kind`` being one of
    ``hallucinated``, ``typosquat`` and ``new``."""
    kinds = F.array_compact(
        F.array(
            F.when(~F.coalesce("exists", F.lit(False)), F.lit("hallucinated")),
            F.when(F.size("typosquat_similar_to") > 0, F.lit("typosquat")),
            F.when(is_new(F.col("age_days")), F.lit("new")),
        )
    )
    return findings.select("repo", *FINDING_ORDER, F.explode_outer(kinds).alias("kind")).where(
        "kind is not null"
    )


def warning_lists(findings: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Packages of each warning in finding order: ``(repo, kind, part, parts, total, items)``."""
    return in_parts(
        warnings(findings), ["repo", "kind"], FINDING_ORDER, F.col("package"), part_rows
    )


def dependency_counts(findings: DataFrame) -> DataFrame:
    """Counts per repository, aggregated before the shuffle."""
    return findings.groupBy("repo").agg(
        F.count("*").alias("total_packages"),
        F.count_if(~F.coalesce("exists", F.lit(False))).alias("hallucinated_packages"),
        F.count_if(F.size("typosquat_similar_to") > 0).alias("typosquat_warnings"),
        F.count_if(is_new(F.col("age_days"))).alias("new_package_warnings"),
    )


def dependency_summary(files: DataFrame, findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per requested repository, also for those without manifests or missing.

    ``repos`` has ``repo``, ``root`` and ``found``.
    """
    counted = manifests.manifest_list(files).groupBy("repo").agg(
        F.count("*").alias("manifest_count")
    )
    rows = repos.join(counted, "repo", "left").join(dependency_counts(findings), "repo", "left")
    counts = ["manifest_count", "total_packages", "hallucinated_packages",
              "typosquat_warnings", "new_package_warnings"]
    return rows.select(
        "repo",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.when(
            F.col("found") & F.col("manifest_count").isNull(),
            "No dependency files found in the repository.",
        ).alias("message"),
        F.when(
            ~F.col("found"), F.concat(F.lit("Repository path does not exist: "), "root")
        ).alias("error"),
    )
