"""Security scan: every line of scanned code against every rule."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import paths, text
from repoaudit.functions.literals import grouped, minimal, one_of
from repoaudit.rules import (
    ONE_PASS_FORMS,
    SECURITY_RULES,
    SEVERITY_RANK,
    UNKNOWN_SEVERITY_RANK,
    all_of,
    any_of,
    valid_rules,
)


# Up to this many patterns of a caller are expressions of the plan; more are data.
FEW_PATTERNS = 64


def code_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of scanned code: ``(repo, file, line_number, line)``."""
    parts = text.split_lines(F.col("content"))
    # A final line break ends the last line and does not start another one.
    pieces = _scanned(files).select(
        "repo",
        "file",
        F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))
        .otherwise(parts)
        .alias("parts"),
    )
    lines = pieces.select("repo", "file", F.posexplode_outer("parts").alias("at", "line"))
    return lines.where("line is not null").select(
        "repo", "file", (F.col("at") + 1).alias("line_number"), "line"
    )


def _scanned(files: DataFrame) -> DataFrame:
    kept = paths.of_kind(files, "setup", "python", "script")
    kept = kept.where(paths.is_scanned_code(F.col("path")))
    return text.code_text(kept).select("repo", F.col("path").alias("file"), "content")


def _marks(rules) -> dict[str, str]:
    """A column name for each single-character needle."""
    needles = [
        n for r in rules for i in range(len(r.patterns)) for group in r.needles_of(i) for n in group
    ]
    single = dict.fromkeys(n for n in needles if len(n) == 1)
    return {char: f"_mark{i}" for i, char in enumerate(single)}


def category_match(line: Column, folded: Column, rule, marks: dict[str, str]) -> Column:
    """Whether one of the patterns of a category is found in the line.

    A pattern only runs on a line that holds its needles, found by plain substring search.
    """

    def held(needle: str) -> Column:
        return F.col(marks[needle]) if needle in marks else F.contains(folded, F.lit(needle))

    tests = []
    for i, pattern in enumerate(rule.patterns):
        gates = [any_of([held(n) for n in group]) for group in rule.needles_of(i)]
        search = line.rlike(text.ignore_case(ONE_PASS_FORMS.get(pattern, pattern)))
        tests.append(all_of([*gates, search]))
    return any_of(tests)


def _may_match(folded: Column, rules, marks: dict[str, str]) -> Column:
    """Whether any pattern can match a line at all: single characters first, then the
    needles of the patterns that need the same characters, each tested once."""

    def some(needles) -> Column:
        return any_of([F.contains(folded, F.lit(n)) for n in needles])

    needed: dict[tuple, dict[str, None]] = {}
    for rule in rules:
        for i in range(len(rule.patterns)):
            groups = rule.needles_of(i)
            single = tuple(g for g in groups if all(n in marks for n in g))
            first = next((g for g in groups if g not in single), None)
            if first is None:
                return folded.isNotNull()
            needed.setdefault(single, {}).update(dict.fromkeys(first))
    # A needle that contains another one adds nothing to the union.
    return any_of(
        [
            all_of(
                [
                    *map(some, single),
                    some([n for n in needles if not any(m != n and m in n for m in needles)]),
                ]
            )
            for single, needles in needed.items()
        ]
    )


def match_lines(files: DataFrame, rules=None) -> DataFrame:
    """Findings of all texts in a table, whatever its keys: one row per line and category.

    The work is one narrow stage. The rules are expressions built from the rule table, so
    each regex compiles once per task and nothing is joined; beyond ``FEW_PATTERNS`` patterns of
    a caller they are data, so that the generated code does not grow with them. A rule set
    without any valid pattern finds nothing.
    """
    rules = valid_rules(files.sparkSession, SECURITY_RULES if rules is None else rules)
    if not rules:
        return match_lines(files.limit(0))
    many = rules is not SECURITY_RULES and sum(len(rule.patterns) for rule in rules) > FEW_PATTERNS
    if any(not rule.needles_of(i) for rule in rules for i in range(len(rule.patterns))):
        # Such a pattern may match an empty line. A final line break does not start one.
        files = files.where("content <> ''").withColumn("content", text.without_last_break(F.col("content")))
    lines = _folded_lines(files)
    return _match_many(lines, rules) if many else _match_few(lines, rules)


def _folded_lines(files: DataFrame) -> DataFrame:
    """All lines with their folded form: the columns but ``content``, and ``line_number``, ``line``,
    ``folded``."""
    keys = [c for c in files.columns if c != "content"]
    pieces = files.select(*keys, "content", text.fold_case(F.col("content")).alias("folded"))
    # The folded text has the same line breaks, so both are cut alike. As columns of the
    # generator, line and folded line exist before the filter, which would otherwise fold
    # the line again for each needle. The outer form keeps Spark from adding a filter that
    # splits the texts once more.
    pairs = F.arrays_zip(
        text.split_lines(F.col("content")).alias("line"),
        text.split_lines(F.col("folded")).alias("folded"),
    )
    return pieces.select(*keys, F.posexplode_outer(pairs).alias("at", "_pair")).select(
        *keys,
        (F.col("at") + 1).alias("line_number"),
        F.col("_pair").getField("line").alias("line"),
        F.col("_pair").getField("folded").alias("folded"),
    )


def _match_few(lines: DataFrame, rules) -> DataFrame:
    """Findings of folded lines by rules that are expressions."""
    keys = [c for c in lines.columns if c not in ("line_number", "line", "folded")]
    marks = _marks(rules)
    lines = lines.where(_may_match(F.col("folded"), rules, marks)).select(
        "*", *[F.contains("line", F.lit(char)).alias(name) for char, name in marks.items()]
    )
    categories = [
        F.when(
            category_match(F.col("line"), F.col("folded"), rule, marks),
            F.struct(
                F.lit(rule.category).alias("category"),
                F.lit(i).alias("category_ord"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.description).alias("description"),
            ),
        )
        for i, rule in enumerate(rules)
    ]
    matched = F.array_compact(F.array(*categories))
    hits = lines.select(
        *keys, "line_number", "line", F.explode_outer(matched).alias("_hit")
    ).where("_hit is not null")
    return _findings(hits, keys)


def _findings(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.select(
        *keys,
        "line_number",
        "_hit.category",
        "_hit.category_ord",
        "_hit.severity",
        text.snippet(F.col("line")).alias("code_snippet"),
        "_hit.description",
    )


_RULE = (
    "array<struct<category:string,category_ord:int,severity:string,description:string,"
    "needles:array<string>,further:array<string>,pattern:string,earlier:string>>"
)


def _rules_as_data(rules) -> tuple[list[str], list[str], list[str], list[dict]]:
    """``(needles, free, every, rows)``: strings of which a line holds one if a pattern with known
    literals matches, patterns without any, all literals, and a row per pattern.

    A pattern counts with its two best groups of literals. A line is told by the longest literal
    that begins at each of its places, so a group is there if one of its strings, or a literal that
    begins with one, is among these. A pattern is tried on lines that hold one of its ``needles`` and one
    of its ``further`` strings; where these are null, on every line that comes so far. A line that
    the ``earlier`` patterns of its category are found in has been counted.
    """
    groups = {p: rule.needles_of(i)[-2:] for rule in rules for i, p in enumerate(rule.patterns)}
    every = sorted({n for own in groups.values() for group in own for n in group})
    begin_with: dict[str, list[str]] = {n: [] for n in every}
    for n in every:
        for k in range(1, len(n) + 1):
            begin_with.get(n[:k], []).append(n)
    rows = []
    for at, rule in enumerate(rules):
        java = [text.ignore_case(ONE_PASS_FORMS.get(p, p)) for p in rule.patterns]
        for i, p in enumerate(rule.patterns):
            needles, further = (
                sorted({m for n in groups[p][k] for m in begin_with[n]}) if groups[p] else None for k in (-1, 0)
            )
            rows.append(
                {
                    "category": rule.category,
                    "category_ord": at,
                    "severity": rule.severity,
                    "description": rule.description,
                    "needles": needles,
                    "further": further,
                    "pattern": grouped(java[i : i + 1]),
                    "earlier": grouped(java[:i]) if i else None,
                }
            )
    best = minimal(n for own in groups.values() if own for n in own[-1])
    return sorted(set(best.values())), [p for p, own in groups.items() if not own], every, rows


def _match_many(lines: DataFrame, rules) -> DataFrame:
    """Findings of folded lines by rules that are data: one literal, whatever their number.

    A line goes on if one regular expression finds any of the literals, or one alternation any of
    the patterns without literals. Such a line is taken once per pattern, and a pattern runs if its
    literals are in the line.
    """
    keys = [c for c in lines.columns if c not in ("line_number", "line", "folded")]
    needles, free, every, rows = _rules_as_data(rules)
    some = []
    found = F.array().cast("array<string>")
    if needles:
        some.append(F.rlike("folded", F.lit(one_of(needles))))
        found = F.array_distinct(F.regexp_extract_all("folded", F.lit(f"(?=({one_of(every)}))"), F.lit(1)))
    if free:
        some.append(F.rlike("line", F.lit(grouped([text.ignore_case(p) for p in free]))))
    kept = lines.where(any_of(some)).select(*keys, "line_number", "line", found.alias("_found"))
    table = F.from_json(F.lit(json.dumps(rows)), _RULE)
    tried = kept.select(*keys, "line_number", "line", "_found", F.explode(table).alias("_hit"))
    possible = F.col("_hit.needles").isNull() | (
        F.arrays_overlap("_found", "_hit.needles") & F.arrays_overlap("_found", "_hit.further")
    )
    first = F.col("_hit.earlier").isNull() | ~F.rlike("line", "_hit.earlier")
    return _findings(tried.where(possible).where(F.rlike("line", "_hit.pattern")).where(first), keys)


def scan_security(files: DataFrame, rules=None, redact: bool = False) -> DataFrame:
    """Security findings of the ``source_files`` table, one row per file, line, category.

    ``redact`` replaces letters and digits of the snippets of secrets by ``*``.
    """
    findings = match_lines(_scanned(files), rules)
    if redact:
        hidden = F.regexp_replace("code_snippet", r"[\p{L}\p{N}]", "*")
        findings = findings.withColumn(
            "code_snippet",
            F.when(F.col("severity") == "critical", hidden).otherwise(F.col("code_snippet")),
        )
    return findings


def severity_rank(severity: Column) -> Column:
    rank = F.lit(UNKNOWN_SEVERITY_RANK)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(severity == name, F.lit(value)).otherwise(rank)
    return rank


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings of each repository by severity, file and line, over range partitions."""
    return findings.orderBy(
        "repo", severity_rank(F.col("severity")), "file", "line_number", "category_ord"
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per repository: ``total_issues`` and the zero-filled counts of the severities.

    A missing severity counts as low. Severities outside the four, which only a caller's
    own rules can bring, are counted in ``other``.
    """
    level = F.coalesce(F.col("severity"), F.lit("low"))
    return findings.groupBy("repo").agg(
        F.count("*").alias("total_issues"),
        *[F.count_if(level == name).alias(name) for name in SEVERITY_RANK],
        F.count_if(~level.isin(*SEVERITY_RANK)).alias("other"),
    )


def other_severity_counts(findings: DataFrame) -> DataFrame:
    """Counts of severities outside the four, as ``(repo, severity, n)``."""
    return (
        findings.where(~F.col("severity").isin(*SEVERITY_RANK))
        .groupBy("repo", "severity")
        .agg(F.count("*").alias("n"))
    )


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "category", "severity").agg(F.count("*").alias("n"))


def top_severe(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` critical and high findings of each repository, with ``n``.

    Spark keeps at most ``limit`` rows per repository in each task before the shuffle,
    so a repository of any size sends only a few rows.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("repo").orderBy(
        severity_rank(F.col("severity")), "file", "line_number", "category_ord"
    )
    return (
        findings.where(F.col("severity").isin("critical", "high"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= limit)
    )
