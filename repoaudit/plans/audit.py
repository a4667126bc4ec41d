"""The whole audit: three checks, one summary, two reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from repoaudit.operators import apicheck, dependencies, risk, security
from repoaudit.operators.ordering import PART_ROWS
from repoaudit.plans import json_report, lines, markdown
from repoaudit.rules import POPULAR_PACKAGES, known_api_table
from repoaudit.session import freeze

_MISSING_ROOT = "Repository path does not exist or is not a directory: "


@dataclass
class Findings:
    """Results of the checks. Each table is computed once and may feed several reports."""

    repos: DataFrame
    files: DataFrame
    dependencies: DataFrame
    security: DataFrame
    parsed: DataFrame
    api: DataFrame


@dataclass
class Report:
    summary: DataFrame
    recommendations: DataFrame
    markdown_lines: DataFrame
    json_lines: DataFrame


def repositories(files: DataFrame) -> DataFrame:
    """The repositories that have files, for callers without a list of their own."""
    return files.select("repo").distinct().select(
        "repo", F.col("repo").alias("root"), F.lit(True).alias("found")
    )


def audit(
    files: DataFrame,
    meta: DataFrame,
    repos: DataFrame | None = None,
    as_of: datetime | None = None,
    rules=None,
    known=POPULAR_PACKAGES,
    known_apis=None,
) -> Findings:
    """Run the three checks over the ``source_files`` table.

    Source text is read once per check; from there on only findings move, a small part of
    the data. They are frozen, since summary and reports each read them again.
    """
    found = repositories(files) if repos is None else repos
    modules = apicheck.literal_modules(known_apis)
    parsed = freeze(apicheck.parse_python(files, modules))
    table = known_api_table(files.sparkSession, known_apis)
    return Findings(
        repos=freeze(found),
        files=files,
        dependencies=freeze(dependencies.scan_dependencies(files, meta, as_of, known)),
        security=freeze(security.scan_security(files, rules)),
        parsed=parsed,
        api=freeze(apicheck.check_calls(apicheck.py_calls(parsed), table)),
    )


def report(
    found: Findings,
    as_of: datetime | None = None,
    product: str = markdown.PRODUCT,
    part_rows: int = PART_ROWS,
) -> Report:
    """Score, recommendations and both reports of each repository, as tables."""
    summary = freeze(
        risk.risk_summary(
            found.repos, found.dependencies, found.security, found.api, found.parsed
        )
    )
    recs = freeze(risk.recommendations(summary, found.dependencies, part_rows))
    tables = (summary, recs, found.dependencies, found.security, found.api)
    numbered = report_lines(*tables, found.files, as_of, product)
    return Report(
        summary=summary,
        recommendations=recs,
        markdown_lines=markdown.finished(numbered),
        json_lines=json_report.finished(numbered),
    )


def report_lines(
    summary: DataFrame,
    recs: DataFrame,
    dep: DataFrame | None,
    sec: DataFrame | None,
    api: DataFrame | None,
    files: DataFrame | None,
    as_of: datetime | None = None,
    product: str = markdown.PRODUCT,
) -> DataFrame:
    """The numbered lines of both reports, computed and stored once."""
    tables = (summary, recs, dep, sec, api)
    return lines.numbered(
        {
            markdown.REPORT: markdown.markdown_parts(*tables, as_of, product),
            json_report.REPORT: json_report.json_parts(*tables, files, as_of, product),
        }
    )


def write_report(result: Report, path: str) -> dict[str, str]:
    """Write both reports below a folder; returns where they went."""
    saved = {"markdown": f"{path}/markdown", "json": f"{path}/json"}
    lines.write_lines(result.markdown_lines, saved["markdown"])
    lines.write_lines(result.json_lines, saved["json"])
    return saved


def security_result(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Totals per requested repository; a root that is missing has an ``error``."""
    counts = security.severity_counts(findings)
    names = ["total_issues", "critical", "high", "medium", "low"]
    return repos.join(counts, "repo", "left").select(
        "repo", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], _missing_root()
    )


def api_result(parsed: DataFrame, findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Totals per requested repository; a root that is missing has an ``error``."""
    counts = apicheck.api_counts(parsed, findings)
    names = ["total_hallucinated_calls", "total_files_scanned"]
    return repos.join(counts, "repo", "left").select(
        "repo", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], _missing_root()
    )


def _missing_root():
    return F.when(~F.col("found"), F.concat(F.lit(_MISSING_ROOT), "root")).alias("error")
