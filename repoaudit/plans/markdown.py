"""The Markdown report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import times
from repoaudit.operators.dependencies import has_typosquat_risk, is_new
from repoaudit.operators.security import severity_rank, top_severe
from repoaudit.plans import lines as ln
from repoaudit.rules import SEVERITY_BADGES, UNKNOWN_SEVERITY_BADGE

PRODUCT, VERSION = "RepoAudit", "0.1.0"
REPORT = "markdown"

(HEADER, SUMMARY, DEP_HEAD, DEP_ROWS, SEC_HEAD, SEC_ROWS, SEVERE_HEAD, SEVERE_ROWS,
 API_HEAD, API_ROWS, REC_HEAD, REC_ROWS, FOOTER) = range(13)


def _fill(template: str, **values) -> Column:
    """A text with ``{name}`` places filled by columns of that name or given ones.

    A missing value leaves its place empty.
    """
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.col(name) if name not in values else values[name]]
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in [*parts, F.lit(rest)]])


def _lines(*texts) -> Column:
    columns = [F.lit(t) if isinstance(t, str) else t for t in texts]
    return F.array(*columns)


def severity_badge(severity: Column) -> Column:
    badge = F.lit(UNKNOWN_SEVERITY_BADGE)
    for name, mark in SEVERITY_BADGES.items():
        badge = F.when(severity == name, F.lit(mark)).otherwise(badge)
    return badge


def _fixed_lines(summary: DataFrame, stamp: str, product: str) -> DataFrame:
    name = F.when(F.col("repository") == "", F.col("root")).otherwise(F.col("repository"))
    stamp_, product_ = F.lit(stamp), F.lit(product)

    def either(condition: Column, yes: Column, no: Column) -> Column:
        return F.when(condition, yes).otherwise(no)

    header = _lines(
        _fill("# {badge} {product} Security Report", product=product_),
        "",
        _fill("**Repository:** `{name}`  ", name=name),
        _fill("**Scan Date:** {stamp}  ", stamp=stamp_),
        _fill("**Risk Score:** **{risk_score}/100** — {badge} {risk_level}  "),
        "",
    )
    overview = _lines(
        "## Executive Summary",
        "",
        _fill(
            "{product} scanned **`{name}`** and identified **{total_issues}** issue(s) "
            "across three audit dimensions:",
            product=product_,
            name=name,
        ),
        "",
        "| Category | Issues |",
        "|---|---|",
        _fill("| 📦 Dependency Audit | {dependency_issues} |"),
        _fill("| 🔒 Security Scan | {security_issues} |"),
        _fill("| 🤖 API Hallucination Check | {api_hallucinations} |"),
        _fill("| **Total** | **{total_issues}** |"),
        "",
    )
    dep_head = F.concat(
        _lines("## 📦 Dependency Audit Results", ""),
        either(
            F.col("dependency_issues") > 0,
            _lines("| Package | Status | Risk | Details |", "|---|---|---|---|"),
            _lines("*No dependency issues detected.*"),
        ),
    )
    sec_head = F.concat(
        _lines("", "## 🔒 Security Scan Results", ""),
        either(
            F.col("security_issues") > 0,
            _lines(
                _fill(
                    "**Severity Breakdown:** 🔴 Critical: {critical} · 🟠 High: {high} · "
                    "🟡 Medium: {medium} · 🟢 Low: {low}"
                ),
                "",
                "| # | File | Line | Severity | Category | Description |",
                "|---|---|---|---|---|---|",
            ),
            _lines("*No security vulnerabilities detected.* ✅"),
        ),
    )
    severe_head = either(
        F.col("critical") + F.col("high") > 0,
        _lines("", "### Critical & High Severity Details", ""),
        _lines(""),
    )
    api_head = F.concat(
        _lines(
            "## 🤖 API Hallucination Check",
            "",
            _fill("Files scanned: **{files_scanned}**"),
            "",
        ),
        either(
            F.col("api_hallucinations") > 0,
            _lines("| File | Line | Module | Called Function | Suggestion |", "|---|---|---|---|---|"),
            _lines("*No hallucinated API calls detected.* ✅"),
        ),
    )
    footer = _lines(
        "",
        "---",
        _fill("*Report generated by {product} v{version} at {stamp}*",
              product=product_, version=F.lit(VERSION), stamp=stamp_),
    )
    return ln.block(
        summary,
        {
            HEADER: header,
            SUMMARY: overview,
            DEP_HEAD: dep_head,
            SEC_HEAD: sec_head,
            SEVERE_HEAD: severe_head,
            API_HEAD: api_head,
            REC_HEAD: _lines("", "## 📋 Recommendations", ""),
            FOOTER: footer,
        },
    )


def dependency_detail(exists: Column) -> Column:
    """What to say on a dependency: missing, then new, then look-alike, else nothing."""
    names = F.transform("typosquat_similar_to", lambda s: F.coalesce(s["name"], F.lit("?")))
    return (
        F.when(~exists, "Package does not exist in the registry (hallucinated)")
        .when(is_new(F.col("age_days")), _fill("Suspiciously new ({age_days} days old)"))
        .when(
            F.size("typosquat_similar_to") > 0,
            F.concat(F.lit("Looks like: "), F.array_join(names, ", ")),
        )
        .otherwise("")
    )


def _dependency_lines(dep: DataFrame) -> DataFrame:
    exists = F.coalesce("exists", F.lit(False))
    line = _fill(
        "| `{package}` | {status} | {typo} | {detail} |",
        package=F.coalesce("package", F.lit("unknown")),
        status=F.when(exists, "✅ Found").otherwise("❌ Not found"),
        typo=F.when(has_typosquat_risk(), _fill("⚠️ Typosquat ({typosquat_risk})")).otherwise("—"),
        detail=dependency_detail(exists),
    )
    return ln.items(dep, DEP_ROWS, line, F.col("file_ord"), F.col("source_file"), F.col("pos"))


def _security_lines(sec: DataFrame) -> DataFrame:
    # The number in front is added once the position is known.
    line = _fill(
        "| `{file}` | {line_number} | {mark} {title} | {category} | {description} |",
        mark=severity_badge(F.col("severity")),
        title=F.initcap("severity"),
    )
    return ln.items(
        sec, SEC_ROWS, line, severity_rank(F.col("severity")), F.col("file"),
        F.col("line_number"), F.col("category_ord"),
    )


def _severe_lines(sec: DataFrame) -> DataFrame:
    head = _fill("**{file}:{line_number}** — {description}")
    fence = F.lit("```")
    texts = F.when(
        F.col("code_snippet") != "", F.array(head, fence, F.col("code_snippet"), fence, F.lit(""))
    ).otherwise(F.array(head, F.lit("")))
    rows = top_severe(sec).select("repo", "n", F.posexplode(texts).alias("at", "text"))
    return ln.items(rows, SEVERE_ROWS, F.col("text"), F.col("n"), k3=F.col("at"))


def _api_lines(api: DataFrame) -> DataFrame:
    line = _fill("| `{file}` | {line_number} | `{module}` | `{called_function}` | {suggestion} |")
    rows = ln.items(
        api, API_ROWS, line, None, F.col("file"), F.col("line_number"), F.col("walk_ord")
    )
    return rows


def _recommendation_lines(recs: DataFrame) -> DataFrame:
    number = F.when(F.col("part") == 0, _fill("{rec_no}. ")).otherwise("")
    return ln.items(
        recs, REC_ROWS, F.concat(number, F.col("text")), F.col("rec_no"), k3=F.col("part")
    )


def markdown_parts(
    summary: DataFrame,
    recs: DataFrame,
    dep: DataFrame | None = None,
    sec: DataFrame | None = None,
    api: DataFrame | None = None,
    as_of: datetime | None = None,
    product: str = PRODUCT,
) -> list[DataFrame]:
    """Lines of the Markdown reports before they are numbered."""
    stamp = times.as_utc(as_of).strftime("%Y-%m-%d %H:%M:%S UTC")
    parts = [_fixed_lines(summary, stamp, product), _recommendation_lines(recs)]
    if dep is not None:
        parts.append(_dependency_lines(dep))
    if sec is not None:
        parts += [_security_lines(sec), _severe_lines(sec)]
    if api is not None:
        parts.append(_api_lines(api))
    return parts


def finished(numbered: DataFrame) -> DataFrame:
    """The Markdown lines among numbered ones."""
    line = F.when(
        F.col("section") == SEC_ROWS, F.concat(F.lit("| "), F.col("row"), F.lit(" "), F.col("line"))
    ).otherwise(F.col("line"))
    return numbered.where(F.col("report") == REPORT).select(
        "repo", "line_number", line.alias("line"), "line_number_total"
    )


def markdown_lines(*tables: DataFrame | None, as_of: datetime | None = None, product: str = PRODUCT) -> DataFrame:
    """Lines of the Markdown reports as ``(repo, line_number, line)`` and more keys. ``tables`` are
    those of ``markdown_parts``."""
    return finished(ln.numbered({REPORT: markdown_parts(*tables, as_of=as_of, product=product)}))
