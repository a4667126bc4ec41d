"""Registered queries: each check over the driver's tables, with flat result columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repoaudit import fixtures as fx
from repoaudit.functions import paths, text
from repoaudit.operators import apicheck, dependencies, manifests, registry, risk, security
from repoaudit.operators.ordering import number_rows
from repoaudit.operators.typosquat import typosquat_candidates
from repoaudit.plans import audit, json_report, markdown
from repoaudit.rules import POPULAR_PACKAGES, known_api_table, popular_table
from repoaudit.session import freeze
from repoaudit.sources.registry import parse_snapshot

AS_OF = datetime.fromisoformat(fx.AS_OF).replace(tzinfo=timezone.utc)


def _similar_text(similar: str) -> Column:
    return F.array_join(
        F.transform(similar, lambda s: F.concat(s["name"], F.lit(":"), s["distance"])), ","
    )


def _security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.scan_security(fx.source_files(spark, sf_dir))


def security_findings(spark, sf_dir):
    return _security(spark, sf_dir).select(
        "repo", "file", "line_number", "category", "severity", "code_snippet", "description"
    )


def security_severity_breakdown(spark, sf_dir):
    return security.severity_counts(_security(spark, sf_dir)).drop("other")


def security_category_counts(spark, sf_dir):
    return security.category_counts(_security(spark, sf_dir))


def security_ranked_top10(spark, sf_dir):
    return security.top_severe(_security(spark, sf_dir)).select(
        "repo", "n", "file", "line_number", "category", "severity", "code_snippet"
    )


def security_numbered(spark, sf_dir):
    found = freeze(_security(spark, sf_dir)).withColumn(
        "rank", security.severity_rank(F.col("severity"))
    )
    order = ["rank", "file", "line_number", "category_ord"]
    return number_rows(found, {"n": ["repo"]}, order).select(
        "repo", "n", F.col("n_total").alias("total"), "file", "line_number", "category", "severity"
    )


def own_rules(spark, sf_dir):
    """Rules of a caller, more of them than a plan takes as expressions, on whole documents."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    found = security.match_lines(fx.spread(rows), fx.own_rules())
    return found.select("doc_id", "line_number", "category", "severity", "code_snippet")


def raw_text_rules(spark, sf_dir):
    def texts(table: str, key: str, column: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
            F.lit(table).alias("source"), F.expr(key).alias("key"), F.col(column).alias("content")
        )
        return fx.spread(rows)

    rows = (
        texts("documents", "cast(doc_id as string)", "text")
        .unionByName(texts("pages", "cast(page_id as string)", "html"))
        .unionByName(texts("conversations", "concat(conv_id, '-', turn)", "text"))
    )
    return security.match_lines(rows).select(
        "source", "key", "line_number", "category", "severity", "code_snippet"
    )


def path_filter_files(spark, sf_dir):
    path = F.col("path")
    return fx.source_files(spark, sf_dir).select(
        "repo",
        "path",
        paths.extension(path).alias("extension"),
        paths.in_skipped_directory(path).alias("skipped"),
        paths.is_scanned_code(path).alias("scanned"),
        paths.is_python(path).alias("python"),
        F.split_part(paths.file_name(path), F.lit("."), F.lit(1)).alias("stem"),
    )


def code_lines(spark, sf_dir):
    rows = security.code_lines(fx.source_files(spark, sf_dir))
    return rows.select("repo", "file", "line_number", text.strip(F.col("line")).alias("line"))


def _packages(spark, sf_dir, condition) -> DataFrame:
    rows = manifests.all_packages(fx.manifests(spark, sf_dir)).where(condition)
    return rows.select("repo", "source_file", "pos", "package", "registry")


def manifest_files(spark, sf_dir):
    return manifests.manifest_list(fx.manifests(spark, sf_dir))


def manifest_requirements(spark, sf_dir):
    return _packages(spark, sf_dir, F.col("source_file").endswith(".txt"))


def manifest_setup_py(spark, sf_dir):
    return _packages(spark, sf_dir, F.col("source_file") == "setup.py")


def manifest_pyproject(spark, sf_dir):
    return _packages(spark, sf_dir, F.col("source_file") == "pyproject.toml")


def manifest_package_json(spark, sf_dir):
    return _packages(spark, sf_dir, F.col("source_file") == "package.json")


def dependencies_dedup(spark, sf_dir):
    return manifests.dependencies(fx.manifests(spark, sf_dir))


def _meta(spark, sf_dir) -> DataFrame:
    return parse_snapshot(fx.registry_docs(spark, sf_dir))


def registry_lookup(spark, sf_dir):
    names = fx.package_names(spark, sf_dir)
    return registry.check_registry(names, _meta(spark, sf_dir), "pypi")


def registry_npm(spark, sf_dir):
    names = fx.package_names(spark, sf_dir)
    return registry.check_registry(names, _meta(spark, sf_dir), "npm").drop("home_page")


def package_age_downloads(spark, sf_dir):
    names = fx.package_names(spark, sf_dir)
    return registry.package_age(names, _meta(spark, sf_dir), AS_OF)


def package_age_npm(spark, sf_dir):
    names = fx.package_names(spark, sf_dir)
    return registry.package_age(names, _meta(spark, sf_dir), AS_OF, "NPM")


def typosquat_popular(spark, sf_dir):
    rows = typosquat_candidates(fx.look_alikes(spark, sf_dir))
    return rows.withColumn("similar_to", _similar_text("similar_to"))


def typosquat_known_table(spark, sf_dir):
    rows = typosquat_candidates(fx.package_names(spark, sf_dir), fx.known_names(spark, sf_dir))
    return rows.withColumn("similar_to", _similar_text("similar_to"))


def typosquat_long_names(spark, sf_dir):
    """Long names of all parts against a long table of known ones that share most of their letters."""
    rows = typosquat_candidates(fx.long_names(spark, sf_dir), fx.known_long_names(spark, sf_dir))
    return rows.withColumn("similar_to", _similar_text("similar_to"))


def _dependencies(spark, sf_dir, known=POPULAR_PACKAGES) -> DataFrame:
    """Findings; look-alikes of the popular packages unless other names are given."""
    # The audit may read the metadata twice, so they are parsed before; a real snapshot is
    # stored in parsed form.
    meta = freeze(_meta(spark, sf_dir))
    return dependencies.scan_dependencies(fx.manifests(spark, sf_dir), meta, AS_OF, known)


# Known names of the query that takes them from a table: two of the parts', the others popular.
KNOWN = ("old-bolt", "new-gear", "pytest", "express", "gitt")


def _flat(findings: DataFrame) -> DataFrame:
    similar = _similar_text("typosquat_similar_to")
    return findings.withColumn("typosquat_similar_to", similar).drop("file_ord", "pos")


def dependency_findings(spark, sf_dir):
    return _flat(_dependencies(spark, sf_dir))


def dependency_findings_known_table(spark, sf_dir):
    return _flat(_dependencies(spark, sf_dir, popular_table(spark, KNOWN)))


def dependency_summary(spark, sf_dir):
    # The sources of the documents have no manifests; one root does not exist.
    repos = fx.repositories(spark, sf_dir).withColumn("found", F.col("repo") != "src0")
    rows = _dependencies(spark, sf_dir)
    return dependencies.dependency_summary(fx.manifests(spark, sf_dir), rows, repos)


def dependency_warnings(spark, sf_dir):
    parts = dependencies.warning_lists(_dependencies(spark, sf_dir), part_rows=20)
    return parts.withColumn("items", F.array_join("items", ","))


def api_imports(spark, sf_dir):
    return apicheck.py_imports(apicheck.parse_python(fx.py_sources(spark, sf_dir))).drop("walk_ord")


def api_calls(spark, sf_dir):
    return apicheck.py_calls(apicheck.parse_python(fx.py_sources(spark, sf_dir))).drop("walk_ord")


def api_findings(spark, sf_dir):
    return apicheck.check_api_calls(fx.py_sources(spark, sf_dir)).drop("walk_ord")


def api_summary(spark, sf_dir):
    parsed = freeze(
        apicheck.parse_python(fx.py_sources(spark, sf_dir), apicheck.literal_modules())
    )
    found = apicheck.check_calls(apicheck.py_calls(parsed), known_api_table(spark))
    return apicheck.api_counts(parsed, found)


def _audited(spark, sf_dir, read_again=("dep", "sec", "api", "summary")):
    """Findings of all checks: dependencies of ``V2``, code of ``V1``, calls of ``V4``. What
    the caller reads besides the summary is frozen."""

    def kept(name: str, rows: DataFrame) -> DataFrame:
        return freeze(rows) if name in read_again else rows

    dep = kept("dep", _dependencies(spark, sf_dir))
    sec = kept("sec", _security(spark, sf_dir))
    parsed = freeze(
        apicheck.parse_python(fx.py_sources(spark, sf_dir), apicheck.literal_modules())
    )
    api = kept("api", apicheck.check_calls(apicheck.py_calls(parsed), known_api_table(spark)))
    repos = fx.repositories(spark, sf_dir)
    return dep, sec, api, kept("summary", risk.risk_summary(repos, dep, sec, api, parsed))


def risk_score(spark, sf_dir):
    *_, summary = _audited(spark, sf_dir, read_again=())
    return summary


def recommendations(spark, sf_dir):
    dep, _, _, summary = _audited(spark, sf_dir, read_again=("dep", "summary"))
    return risk.recommendations(summary, dep, part_rows=20)


def markdown_report(spark, sf_dir):
    dep, sec, api, summary = _audited(spark, sf_dir)
    recs = risk.recommendations(summary, dep)
    return markdown.markdown_lines(summary, recs, dep, sec, api, as_of=AS_OF).select(
        "repo", "line_number", "line"
    )


def json_report_fields(spark, sf_dir):
    dep, sec, api, summary = _audited(spark, sf_dir)
    recs = risk.recommendations(summary, dep)
    files = fx.manifests(spark, sf_dir)
    return _json_fields(json_report.json_lines(summary, recs, dep, sec, api, files, as_of=AS_OF))


def audit_reports(spark, sf_dir):
    """Both reports from one table of numbered lines: the fields of the JSON report next to the
    number of lines of the Markdown one, its characters, and these times their line numbers."""
    dep, sec, api, summary = _audited(spark, sf_dir)
    recs = freeze(risk.recommendations(summary, dep))
    numbered = audit.report_lines(summary, recs, dep, sec, api, fx.manifests(spark, sf_dir), AS_OF)
    length = F.length("line").cast("bigint")
    text = markdown.finished(numbered).groupBy("repo").agg(
        F.count("*").alias("markdown_lines"),
        F.sum(length).alias("markdown_chars"),
        F.sum(length * F.col("line_number")).alias("markdown_places"),
    )
    return _json_fields(json_report.finished(numbered)).join(text, "repo")


def _json_fields(rows: DataFrame) -> DataFrame:
    section = F.col("section")

    # Fields come from the lines that hold them, so a report may have any number of lines.
    def only(condition: Column, text: Column, name: str) -> Column:
        return F.max(F.when(condition, text)).alias(name)

    def first(rows_of: int, name: str) -> Column:
        line = F.regexp_replace("line", ",$", "")
        return only((section == rows_of) & (F.col("row") == 1), line, name)

    def size(rows_of: int, name: str) -> Column:
        return F.count_if(section == rows_of).alias(name)

    opened = F.concat("line", F.lit("]}}"))
    held = rows.groupBy("repo").agg(
        only(section == json_report.OPEN, opened, "head"),
        only(section == json_report.SECURITY, F.concat(F.lit('{"before":{"it":['), opened), "scan"),
        first(json_report.DEP_ROWS, "package"),
        first(json_report.SEC_ROWS, "finding"),
        size(json_report.DEP_ROWS, "dependency_findings"),
        size(json_report.FILE_ROWS, "manifests"),
        size(json_report.MISSING_ROWS, "hallucinated"),
        size(json_report.SEC_ROWS, "security_findings"),
        size(json_report.API_ROWS, "api_findings"),
        size(json_report.REC_ROWS, "recommendations"),
    )

    def field(text: str, path: str, name: str) -> Column:
        return F.get_json_object(text, f"$.{path}").alias(name)

    return held.select(
        "repo",
        field("head", "repository", "repository"),
        field("head", "timestamp", "timestamp"),
        field("head", "risk_score", "risk_score"),
        field("head", "risk_level", "risk_level"),
        field("head", "summary.total_issues", "total_issues"),
        "dependency_findings",
        "manifests",
        "hallucinated",
        field("package", "package", "first_package"),
        "security_findings",
        field("scan", "security_scan.severity_breakdown.critical", "critical"),
        field("finding", "code_snippet", "first_snippet"),
        "api_findings",
        "recommendations",
    )


ALL = {
    f.__name__: f
    for f in (
        security_findings,
        security_severity_breakdown,
        security_category_counts,
        security_ranked_top10,
        security_numbered,
        raw_text_rules,
        own_rules,
        path_filter_files,
        code_lines,
        manifest_files,
        manifest_requirements,
        manifest_setup_py,
        manifest_pyproject,
        manifest_package_json,
        dependencies_dedup,
        registry_lookup,
        registry_npm,
        package_age_downloads,
        package_age_npm,
        typosquat_popular,
        typosquat_known_table,
        typosquat_long_names,
        dependency_findings,
        dependency_findings_known_table,
        dependency_summary,
        dependency_warnings,
        api_imports,
        api_calls,
        api_findings,
        api_summary,
        risk_score,
        recommendations,
        markdown_report,
        json_report_fields,
        audit_reports,
    )
}
