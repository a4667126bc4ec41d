"""The JSON report: lines that together form one JSON object per repository."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import times
from repoaudit.operators import dependencies, manifests
from repoaudit.operators.dependencies import FINDING_ORDER
from repoaudit.operators.security import severity_rank
from repoaudit.plans import lines as ln
from repoaudit.plans.markdown import PRODUCT, VERSION

REPORT = "json"

(OPEN, DEP_ROWS, DEP_FILES, FILE_ROWS, MISSING, MISSING_ROWS, TYPOS, TYPO_ROWS, NEW, NEW_ROWS,
 SECURITY, SEC_ROWS, API, API_ROWS, RECS, REC_ROWS, CLOSE) = range(17)
_WARNING_ROWS = {"hallucinated": MISSING_ROWS, "typosquat": TYPO_ROWS, "new": NEW_ROWS}
_LIST_ROWS = [DEP_ROWS, FILE_ROWS, MISSING_ROWS, TYPO_ROWS, NEW_ROWS, SEC_ROWS, API_ROWS, REC_ROWS]


def _json(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _text(value: Column) -> Column:
    """A string as JSON, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)


def _opened(json: Column) -> Column:
    """An object without its closing brace."""
    return F.substring(json, F.lit(1), F.length(json) - 1)


def _fixed_lines(summary: DataFrame, stamp: str, product: str) -> DataFrame:
    head = _json(
        F.lit("1.0").alias("report_version"),
        F.lit(f"{product} v{VERSION}").alias("generator"),
        F.lit(stamp).alias("timestamp"),
        "repository",
        "risk_score",
        "risk_level",
        F.struct(
            "total_issues", "dependency_issues", "security_issues", "api_hallucinations"
        ).alias("summary"),
    )
    dep = _json(F.col("root").alias("repo_path"), F.col("dependency_issues").alias("total_packages"))
    breakdown = _json(
        F.col("security_issues").alias("total_issues"),
        F.struct("critical", "high", "medium", "low").alias("severity_breakdown"),
    )
    api = _json(
        F.col("api_hallucinations").alias("total_hallucinated_calls"),
        F.col("files_scanned").alias("total_files_scanned"),
    )

    def one(*parts) -> Column:
        return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    return ln.block(
        summary,
        {
            OPEN: one(_opened(head), ',"dependency_audit":', _opened(dep), ',"findings":['),
            DEP_FILES: one('],"dependency_files_found":['),
            MISSING: one('],"hallucinated_packages":['),
            TYPOS: one('],"typosquat_warnings":['),
            NEW: one('],"new_package_warnings":['),
            SECURITY: one(']},"security_scan":', _opened(breakdown), ',"findings":['),
            API: one(']},"api_check":', _opened(api), ',"findings":['),
            RECS: one(']},"recommendations":['),
            CLOSE: one("]}"),
        },
    )


def json_parts(
    summary: DataFrame,
    recs: DataFrame,
    dep: DataFrame | None = None,
    sec: DataFrame | None = None,
    api: DataFrame | None = None,
    files: DataFrame | None = None,
    as_of: datetime | None = None,
    product: str = PRODUCT,
) -> list[DataFrame]:
    """Lines of the JSON reports before they are numbered; ``files`` gives the list of manifests."""
    stamp = times.as_utc(as_of).isoformat()
    parts = [
        _fixed_lines(summary, stamp, product),
        ln.items(recs, REC_ROWS, _text(F.col("text")), F.col("rec_no"), k3=F.col("part")),
    ]
    dep_order = [F.col(c) for c in FINDING_ORDER[:3]]
    if dep is not None:
        finding = _json(
            "package", "source_file", "registry", "exists", "version", "typosquat_risk",
            "typosquat_similar_to", "age_days",
        )
        parts.append(ln.items(dep, DEP_ROWS, finding, *dep_order))
        warned = dependencies.warnings(dep)
        section = F.lit(None).cast("int")
        for kind, number in _WARNING_ROWS.items():
            section = F.when(F.col("kind") == kind, F.lit(number)).otherwise(section)
        parts.append(ln.items(warned, section, _text(F.col("package")), *dep_order))
    if files is not None:
        listed = manifests.manifest_list(files)
        parts.append(ln.items(listed, FILE_ROWS, _text(F.col("source_file")), *dep_order[:2]))
    if sec is not None:
        finding = _json(
            "file", "line_number", "category", "severity", "code_snippet", "description"
        )
        parts.append(
            ln.items(sec, SEC_ROWS, finding, severity_rank(F.col("severity")), F.col("file"),
                     F.col("line_number"), F.col("category_ord"))
        )
    if api is not None:
        finding = _json(
            "file", "line_number", "module", "called_function", "exists_in_api", "suggestion"
        )
        parts.append(
            ln.items(api, API_ROWS, finding, None, F.col("file"), F.col("line_number"),
                     F.col("walk_ord"))
        )
    return parts


def finished(numbered: DataFrame) -> DataFrame:
    """The JSON lines among numbered ones."""
    comma = F.when(
        F.col("section").isin(*_LIST_ROWS) & (F.col("row") < F.col("row_total")), ","
    ).otherwise("")
    return numbered.where(F.col("report") == REPORT).select(
        "repo", "line_number", F.concat("line", comma).alias("line"), "line_number_total",
        "section", "row",
    )


def json_lines(*tables: DataFrame | None, as_of: datetime | None = None, product: str = PRODUCT) -> DataFrame:
    """Lines of the JSON reports; ``tables`` are those of ``json_parts``.

    Each finding is one line, with its ``section`` and its ``row`` in it. A recommendation that
    goes on in parts is several strings.
    """
    return finished(ln.numbered({REPORT: json_parts(*tables, as_of=as_of, product=product)}))
