"""A registry snapshot may hold a package more than once."""

from repoaudit.operators.dependencies import check_dependencies
from repoaudit.operators.registry import one_per_package

DEPS = "repo string, file_ord int, pos int, package string, source_file string, registry string"
META = "registry string, name string, exists boolean, version string, created_at timestamp"


def test_doubled_row_gives_one_finding(spark):
    deps = spark.createDataFrame([("r", 0, 0, "left-pad", "package.json", "npm")], DEPS)
    meta = spark.createDataFrame(
        [
            ("npm", "left-pad", False, None, None),
            ("npm", "left-pad", True, "1.0", None),
            ("npm", "left-pad", True, "1.1", None),
            ("pypi", "left-pad", False, None, None),
        ],
        META,
    )
    (row,) = check_dependencies(deps, meta).collect()
    assert (row["exists"], row["version"]) == (True, "1.1")


def test_one_row_per_package_keeps_columns_and_nulls(spark):
    rows = [("npm", "a", None, None, None), ("npm", "b", True, "2", None), ("npm", "b", True, "1", None)]
    kept = one_per_package(spark.createDataFrame(rows, META))
    assert kept.columns == ["registry", "name", "exists", "version", "created_at"]
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[1]]
    assert one_per_package(spark.createDataFrame([], META)).count() == 0
