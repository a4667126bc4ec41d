"""Reports as ordered lines.

A report is a table of lines, not one value per repository, so a repository with any
number of findings is written whole by many tasks. A line sorts by its repository, its
section and four keys within the section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.operators.ordering import number_rows

KEYS = ["section", "k1", "k2", "k3", "k4"]


def block(summary: DataFrame, sections: dict[int, Column]) -> DataFrame:
    """Lines that follow from the summary row: one array of texts per section."""

    def placed(n: int, texts: Column) -> Column:
        return F.transform(
            texts, lambda t, i: F.struct(F.lit(n).alias("section"), i.alias("at"), t.alias("line"))
        )

    pieces = [placed(n, texts) for n, texts in sections.items()]
    rows = summary.select("repo", F.explode_outer(F.concat(*pieces)).alias("_piece"))
    rows = rows.where("_piece is not null").select("repo", "_piece.*")
    return items(rows, F.col("section"), F.col("line"), F.col("at"))


def items(
    rows: DataFrame,
    section: Column | int,
    line: Column,
    k1: Column | None = None,
    k2: Column | None = None,
    k3: Column | None = None,
    k4: Column | None = None,
) -> DataFrame:
    """One line per row."""
    section = F.lit(section) if isinstance(section, int) else section

    def key(column: Column | None, kind: str) -> Column:
        return (F.lit("" if kind == "string" else 0) if column is None else column).cast(kind)

    return rows.select(
        "repo",
        section.alias("section"),
        key(k1, "int").alias("k1"),
        key(k2, "string").alias("k2"),
        key(k3, "bigint").alias("k3"),
        key(k4, "bigint").alias("k4"),
        line.alias("line"),
    )


def numbered(reports: dict[str, list[DataFrame]]) -> DataFrame:
    """All lines of the reports with ``line_number`` in the report, ``row`` in the section, and
    totals. The name of the report is the column ``report``; all of them are numbered in one pass,
    and the result is frozen, so each report selects its lines without computing the others' again.
    """
    lines = None
    for name, parts in reports.items():
        for part in parts:
            part = part.withColumn("report", F.lit(name))
            lines = part if lines is None else lines.unionByName(part)
    of_report = ["report", "repo"]
    return number_rows(lines, {"line_number": of_report, "row": [*of_report, "section"]}, KEYS)


def documents(lines: DataFrame, max_lines: int = 100_000) -> DataFrame:
    """Texts of reports as ``(repo, part, parts, text)``; the parts of one report, joined,
    are the report. Up to ``max_lines`` lines there is just one part."""
    part = ((F.col("line_number") - 1) / max_lines).cast("bigint")
    parts = F.ceil(F.col("line_number_total") / max_lines)
    texts = lines.groupBy("repo", part.alias("part"), parts.alias("parts")).agg(
        F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("all")
    )
    text = F.concat(F.array_join(F.col("all.line"), "\n"), F.lit("\n"))
    return texts.select("repo", "part", "parts", text.alias("text"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write each report as text files below ``repo=…``, in line order over the files.

    Nothing is written into the audited trees.
    """
    spread = lines.repartitionByRange("repo", "line_number").sortWithinPartitions(
        "repo", "line_number"
    )
    spread.select("repo", "line").write.partitionBy("repo").mode("errorifexists").text(path)
