"""Dependency extraction: package names from the manifests at repository roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import paths, text

# Where a list of requirements starts, and quoted strings in it.
SETUP_BLOCK = r"install_requires\s*=\s*\[([^\]]*)\]"
PYPROJECT_BLOCK = r"dependencies\s*=\s*\[([^\]]*)\]"
QUOTED = r"""['"]([^'"]+)['"]"""
# Lines of a requirements file that hold no package name.
SKIPPED_LINE = r"^(#|-|http)"


def manifests(files: DataFrame) -> DataFrame:
    """Manifests of each repository: ``(repo, source_file, file_ord, content)``."""
    found = paths.of_kind(files, "manifest", "setup").where(paths.is_manifest(F.col("path")))
    return text.manifest_text(found).select(
        "repo",
        F.col("path").alias("source_file"),
        paths.manifest_order(F.col("path")).alias("file_ord"),
        "content",
    )


def manifest_list(files: DataFrame) -> DataFrame:
    """Which manifests each repository has, in reading order; content is never read."""
    found = paths.of_kind(files, "manifest", "setup")
    found = found.select("repo", "path").where(paths.is_manifest(F.col("path")))
    return found.select(
        "repo",
        paths.manifest_order(F.col("path")).alias("file_ord"),
        F.col("path").alias("source_file"),
    )


def _json_keys(content: Column) -> Column:
    """Keys of ``dependencies``, then of ``devDependencies``, of a valid JSON object."""
    # As the only element of an array, a text with anything after its value is invalid. The
    # parser of tables, unlike that of paths, can refuse single quotes and raw control codes.
    alone = F.json_array_length(F.concat(F.lit("["), content, F.lit("]"))) == 1
    strict = F.from_json(content, "map<string, string>", {"allowSingleQuotes": "false"})
    valid = alone & strict.isNotNull()

    def keys(name: str) -> Column:
        found = F.json_object_keys(F.get_json_object(content, f"$.{name}"))
        return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))

    return F.when(valid, F.concat(keys("dependencies"), keys("devDependencies")))


def _blocks(content: Column, block: str) -> Column:
    return F.regexp_extract_all(content, F.lit("(?U)" + block), F.lit(1))


def _quoted(block: Column) -> Column:
    return F.regexp_extract_all(block, F.lit(QUOTED), F.lit(1))


def all_packages(files: DataFrame) -> DataFrame:
    """Every name in every manifest, repeats included, with its registry.

    - requirements files: one line each; comments, options and URLs are left out
    - ``setup.py``: quoted names of the first ``install_requires`` list
    - ``pyproject.toml``: quoted names of every ``dependencies`` list; the key is not
      anchored, so ``optional-dependencies`` and the like count too
    - ``package.json``: keys of two objects, their case kept

    The kinds share one pass over the files: each yields an array of items, and one
    generator turns all of them into rows.
    """
    name, content = F.col("source_file"), F.col("content")
    items = (
        F.when(name == "setup.py", _quoted(F.regexp_extract(content, "(?U)" + SETUP_BLOCK, 1)))
        .when(
            name == "pyproject.toml",
            F.flatten(F.transform(_blocks(content, PYPROJECT_BLOCK), _quoted)),
        )
        .when(name == "package.json", _json_keys(content))
        .otherwise(F.split(content, text.FILE_LINE_BREAK))
    )
    rows = manifests(files).select(
        "repo", "file_ord", "source_file", F.posexplode_outer(items).alias("pos", "item")
    ).where("item is not null")
    line = name.endswith(".txt")
    rows = rows.withColumn("item", F.when(line, text.strip(F.col("item"))).otherwise(F.col("item")))
    item = F.col("item")
    package = (
        F.when(line & item.rlike(SKIPPED_LINE), "")
        .when(name == "package.json", item)
        .otherwise(text.package_name(item))
    )
    return (
        rows.select(
            "repo",
            "file_ord",
            "source_file",
            F.col("pos").cast("bigint").alias("pos"),
            package.alias("package"),
            F.when(name == "package.json", "npm").otherwise("pypi").alias("registry"),
        )
        .where((F.col("package") != "") | (F.col("registry") == "npm"))
    )


def distinct_packages(packages: DataFrame) -> DataFrame:
    """First mention of each (package, registry) in a repository.

    A minimum over the order key aggregates before the shuffle, unlike a window.
    """
    first = F.min(F.struct("file_ord", "source_file", "pos")).alias("_first")
    return packages.groupBy("repo", "package", "registry").agg(first).select(
        "repo", "_first.file_ord", "_first.pos", "package", "_first.source_file", "registry"
    )


def dependencies(files: DataFrame) -> DataFrame:
    """The distinct dependencies of each repository."""
    return distinct_packages(all_packages(files))
