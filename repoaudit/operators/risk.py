"""Risk score, level and recommendations of each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import paths
from repoaudit.operators.dependencies import FINDING_ORDER, has_typosquat_risk, is_nonexistent
from repoaudit.operators.ordering import PART_ROWS, in_parts
from repoaudit.operators.security import severity_counts
from repoaudit.rules import MAX_RISK_SCORE, RISK_BANDS, SCORE_WEIGHTS

_COUNTS = [
    "dependency_issues", "non_existent", "typosquats",
    "security_issues", "critical", "high", "medium", "low",
    "api_hallucinations", "files_scanned",
]

# Texts of the recommendations, in order; two of them list packages.
_NON_EXISTENT = (
    "**Remove non-existent packages** (",
    "). These were likely hallucinated by an AI code generator and will cause "
    "installation failures or, worse, install a malicious package.",
)
_TYPOSQUAT = (
    "**Verify potentially typosquatted packages** (",
    "). Confirm these are the intended packages and not malicious look-alikes.",
)
_FIXED = (
    (
        "critical",
        "**Immediately rotate any exposed secrets.** Hardcoded API keys and passwords must "
        "be moved to environment variables or a secrets manager (e.g., AWS Secrets Manager, "
        "HashiCorp Vault).",
    ),
    (
        "high",
        "**Fix high-severity issues** including SQL injection risks, dangerous `eval`/`exec` "
        "usage, and insecure deserialization. Use parameterized queries, avoid `eval`, and "
        "use safe loaders.",
    ),
    (
        "medium",
        "**Address medium-severity issues** such as disabled TLS verification, debug mode in "
        "production, and weak crypto algorithms.",
    ),
    (
        "api_hallucinations",
        "**Fix hallucinated API calls.** Replace non-existent function calls with the correct "
        "API. Consult official package documentation.",
    ),
)
_NOTHING = "No critical issues found — keep following security best practices! 🎉"


def clamp(value: Column, low: int = 0, high: int = MAX_RISK_SCORE) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _banded(score: Column, field: int) -> Column:
    result = F.lit(RISK_BANDS[-1][field])
    for band in reversed(RISK_BANDS):
        result = F.when(score >= band[0], F.lit(band[field])).otherwise(result)
    return result


def risk_level(score: Column) -> Column:
    return _banded(score, 2)


def risk_badge(score: Column) -> Column:
    return _banded(score, 1)


def risk_score(dep_counts: dict, sec_counts: dict, api_calls: Column) -> Column:
    w = SCORE_WEIGHTS
    total = (
        dep_counts["non_existent"] * w["non_existent_package"]
        + dep_counts["typosquats"] * w["typosquat_risk"]
        + sec_counts["critical"] * w["critical_security"]
        + sec_counts["high"] * w["high_security"]
        + sec_counts["medium"] * w["medium_security"]
        + sec_counts["low"] * w["low_security"]
        + api_calls * w["hallucinated_api"]
    )
    return clamp(total)


def risk_summary(
    repos: DataFrame,
    dep: DataFrame | None = None,
    sec: DataFrame | None = None,
    api: DataFrame | None = None,
    parsed: DataFrame | None = None,
) -> DataFrame:
    """One row per repository with counts, score and level; absent findings count as none.

    ``repos`` has ``repo`` and, for the display name, ``root``. ``parsed`` has ``repo`` and
    a boolean ``parsed`` per Python file. All counts aggregate before their shuffle, so a
    repository with most of the findings costs no more than another.
    """
    if "root" not in repos.columns:
        repos = repos.withColumn("root", F.col("repo"))
    rows = repos.select("repo", "root").distinct()
    if dep is not None:
        counted = dep.groupBy("repo").agg(
            F.count("*").alias("dependency_issues"),
            F.count_if(is_nonexistent(dep)).alias("non_existent"),
            F.count_if(has_typosquat_risk()).alias("typosquats"),
        )
        rows = rows.join(counted, "repo", "left")
    if sec is not None:
        counted = severity_counts(sec).withColumnRenamed("total_issues", "security_issues")
        rows = rows.join(counted.drop("other"), "repo", "left")
    if api is not None:
        counted = api.groupBy("repo").agg(F.count("*").alias("api_hallucinations"))
        rows = rows.join(counted, "repo", "left")
    if parsed is not None:
        counted = parsed.groupBy("repo").agg(F.count_if("parsed").alias("files_scanned"))
        rows = rows.join(counted, "repo", "left")
    rows = rows.select(
        "repo",
        "root",
        *[
            (F.coalesce(c, F.lit(0)) if c in rows.columns else F.lit(0)).cast("bigint").alias(c)
            for c in _COUNTS
        ],
    )
    count = {c: F.col(c) for c in _COUNTS}
    rows = rows.withColumn("risk_score", risk_score(count, count, count["api_hallucinations"]))
    return rows.select(
        "repo",
        "root",
        paths.base_name(F.col("root")).alias("repository"),
        F.col("risk_score").cast("int").alias("risk_score"),
        risk_level(F.col("risk_score")).alias("risk_level"),
        risk_badge(F.col("risk_score")).alias("badge"),
        (count["dependency_issues"] + count["security_issues"] + count["api_hallucinations"])
        .alias("total_issues"),
        *_COUNTS,
    )


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _package_texts(dep: DataFrame, part_rows: int) -> DataFrame:
    """The texts that list packages; more than ``part_rows`` continue in further parts."""
    kinds = F.array_compact(
        F.array(
            F.when(is_nonexistent(dep), F.lit("missing")),
            F.when(has_typosquat_risk(), F.lit("lookalike")),
        )
    )
    flagged = dep.select("repo", *FINDING_ORDER, F.explode_outer(kinds).alias("kind"))
    parts = in_parts(
        flagged.where("kind is not null"), ["repo", "kind"], FINDING_ORDER, F.col("package"), part_rows
    )
    quoted = F.transform("items", lambda p: F.concat(F.lit("`"), p, F.lit("`")))

    def either(at: int) -> Column:
        return F.when(F.col("kind") == "missing", _NON_EXISTENT[at]).otherwise(_TYPOSQUAT[at])

    head = F.when(F.col("part") == 0, either(0)).otherwise("")
    tail = F.when(F.col("part") == F.col("parts") - 1, either(1)).otherwise(",")
    return parts.select(
        "repo", "kind", "part", F.concat(head, F.array_join(quoted, ", "), tail).alias("text")
    )


def recommendations(
    summary: DataFrame, dep: DataFrame | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """Numbered recommendations as ``(repo, rec_no, part, text)``.

    A recommendation is one row; only one that names more than ``part_rows`` packages
    goes on in further parts.
    """
    missing, lookalike = _one(F.col("non_existent") > 0), _one(F.col("typosquats") > 0)
    number = missing + lookalike
    entries, any_fixed = [], F.lit(0)
    for column, words in _FIXED:
        here = _one(F.col(column) > 0)
        any_fixed = any_fixed + here
        entries.append(
            F.when(
                F.col(column) > 0,
                F.struct((number + any_fixed).alias("rec_no"), F.lit(words).alias("text")),
            )
        )
    entries.append(
        F.when(
            number + any_fixed == 0,
            F.struct(F.lit(1).alias("rec_no"), F.lit(_NOTHING).alias("text")),
        )
    )
    rows = (
        summary.select("repo", F.explode_outer(F.array_compact(F.array(*entries))).alias("_entry"))
        .where("_entry is not null")
        .select("repo", "_entry.rec_no", F.lit(0).cast("bigint").alias("part"), "_entry.text")
    )
    if dep is None:
        return rows
    listed = _package_texts(dep, part_rows).join(
        summary.select("repo", missing.alias("before")), "repo"
    )
    number = F.when(F.col("kind") == "missing", 1).otherwise(F.col("before") + 1)
    return rows.unionByName(listed.select("repo", number.alias("rec_no"), "part", "text"))
