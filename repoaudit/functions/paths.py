"""Paths relative to a repository root, with '/' between components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Directories that are not source, and the extensions of scanned code.
SKIPPED_DIRECTORIES = (
    "node_modules", ".git", "__pycache__", ".venv", "venv",
    "env", ".tox", ".mypy_cache", "dist", "build",
)
SCANNED_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx")
# Manifest names in the order in which they are read.
MANIFEST_NAMES = ("requirements.txt", "setup.py", "pyproject.toml", "package.json")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last extension of the file name; leading dots do not start one."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def in_skipped_directory(path: Column) -> Column:
    """Whether a directory on the path (the file name excluded) is skipped."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(directories, F.array(*map(F.lit, SKIPPED_DIRECTORIES)))


def is_scanned_code(path: Column) -> Column:
    return extension(path).isin(*SCANNED_EXTENSIONS) & ~in_skipped_directory(path)


def is_python(path: Column) -> Column:
    return path.endswith(".py") & ~in_skipped_directory(path)


def is_manifest(path: Column) -> Column:
    at_root = ~F.contains(path, F.lit("/"))
    extra = path.startswith("requirements") & path.endswith(".txt")
    return at_root & (path.isin(*MANIFEST_NAMES) | extra)


def manifest_order(path: Column) -> Column:
    """0 to 3 for the named manifests, 4 for any other requirements file."""
    order = F.lit(len(MANIFEST_NAMES))
    for i, name in reversed(list(enumerate(MANIFEST_NAMES))):
        order = F.when(path == name, F.lit(i)).otherwise(order)
    return order


def kind(path: Column) -> Column:
    """A coarse class of files, used as the partition column of stored source files."""
    return (
        F.when(path == "setup.py", "setup")
        .when(is_manifest(path), "manifest")
        .when(is_python(path), "python")
        .when(is_scanned_code(path), "script")
        .otherwise("other")
    )


def of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    """Files of these kinds if the table has the column, so other partitions stay unread."""
    return files.where(F.col("kind").isin(*kinds)) if "kind" in files.columns else files


def base_name(root: Column) -> Column:
    """Last component of a root path after removal of trailing '/' and '/.'."""
    return F.substring_index(F.regexp_replace(root, r"(/+\.?)+$", ""), "/", -1)
