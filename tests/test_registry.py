import json
from datetime import datetime, timedelta, timezone

import pytest

from repoaudit.operators import dependencies, registry
from repoaudit.sources.registry import parse_snapshot, read_snapshot

AS_OF = datetime(2024, 2, 20, tzinfo=timezone.utc)
DOCS = "registry string, name string, doc string, lookup_status string, lookup_error string"


@pytest.fixture(scope="module")
def snapshot(spark):
    def make(*rows):
        full = [
            (reg, name, doc if doc is None or isinstance(doc, str) else json.dumps(doc), *rest)
            for reg, name, doc, *rest in rows
        ]
        full = [r if len(r) == 5 else (*r, "found", None) for r in full]
        return parse_snapshot(spark.createDataFrame(full, DOCS))

    return make


def _names(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_pypi_absent_null_and_missing(spark, snapshot):
    meta = snapshot(
        ("pypi", "a", {"info": {"name": "A", "version": "1", "author": None, "license": "MIT"}}),
        ("pypi", "b", {}),
        ("pypi", "c", None, "error", "boom"),
        ("pypi", "d", None, "not_found", None),
        ("npm", "e", {}),
    )
    rows = registry.check_registry(_names(spark, *"abcde"), meta, "pypi").collect()
    got = {r.package_name: r for r in rows}
    a, b = got["a"], got["b"]
    assert (a.name, a.version, a.summary, a.author, a.home_page, a.license, a.error) == (
        "A", "1", "", None, "", "MIT", None,
    )
    assert (b.exists, b.name, b.version, b.author, b.license) == (
        True, "b", "unknown", "unknown", "unknown",
    )
    assert (got["c"].exists, got["c"].error) == (False, "PyPI request failed: boom")
    assert (got["d"].exists, got["d"].error) == (False, "Package not found on PyPI")
    assert (got["e"].exists, got["e"].version) == (False, None)


@pytest.mark.parametrize(
    "version_author, doc_author, expected",
    [
        ({"name": "x"}, "y", "x"),
        ({"mail": "x"}, "y", "unknown"),
        ({"name": None}, "y", None),
        ("x", "y", "x"),
        ("{odd}", "y", "{odd}"),
        ("", "y", "y"),
        ({}, {"name": "y"}, "y"),
        (None, None, "None"),
        (..., ..., "unknown"),
        (..., "y", "y"),
        (..., None, "None"),
        (False, "y", "y"),
    ],
)
def test_npm_author(spark, snapshot, version_author, doc_author, expected):
    version = {} if version_author is ... else {"author": version_author}
    doc = {"dist-tags": {"latest": "1"}, "versions": {"1": version}}
    if doc_author is not ...:
        doc["author"] = doc_author
    meta = snapshot(("npm", "p", doc))
    assert registry.check_registry(_names(spark, "p"), meta, "npm").collect()[0].author == expected


@pytest.mark.parametrize(
    "doc, version, license_",
    [
        ({"dist-tags": {"latest": "2"}, "versions": {"2": {"license": "MIT"}}, "license": "X"}, "2", "MIT"),
        ({"dist-tags": {"latest": "2"}, "versions": {"1": {"license": "MIT"}}, "license": "X"}, "2", "X"),
        ({"dist-tags": {"latest": "1"}, "versions": {"1": {"license": None}}, "license": "X"}, "1", None),
        ({"dist-tags": {}, "license": None}, "unknown", None),
        ({"dist-tags": {"latest": None}}, None, "unknown"),
    ],
)
def test_npm_version_and_license(spark, snapshot, doc, version, license_):
    row = registry.check_registry(_names(spark, "p"), snapshot(("npm", "p", doc)), "npm").collect()[0]
    assert (row.exists, row.version, row.license) == (True, version, license_)


def _release(*times):
    return {"releases": {str(i): [{"upload_time_iso_8601": t}] for i, t in enumerate(times)}}


@pytest.mark.parametrize(
    "times, created, age",
    [
        (["2024-02-19T00:00:01Z"], "2024-02-19T00:00:01+00:00", 0),
        (["2024-02-21T00:00:00Z"], "2024-02-21T00:00:00+00:00", -1),
        (["2024-02-20T00:00:01Z"], "2024-02-20T00:00:01+00:00", -1),
        (["2024-02-01T12:00:00.25Z", "2024-02-01T11:00:00+00:00"], "2024-02-01T11:00:00+00:00", 18),
        (["2024-02-01T12:00:00+0200"], "2024-02-01T12:00:00+02:00", 18),
        (["2024-02-01 12:00Z"], "2024-02-01T12:00:00+00:00", 18),
        (["2024-02-01T12:00:00.1234567Z"], "2024-02-01T12:00:00.123456+00:00", 18),
        (["bad", "", None, "2024-01-01T00:00:00", "2024-02-01", "2024-13-01T00:00:00Z"], None, None),
        ([], None, None),
    ],
)
def test_pypi_age(spark, snapshot, times, created, age):
    meta = snapshot(("pypi", "p", _release(*times)))
    row = registry.package_age(_names(spark, "p"), meta, AS_OF).collect()[0]
    assert (row.created_date, row.age_days) == (created, age)


def test_npm_age_keeps_the_raw_date(spark, snapshot):
    meta = snapshot(
        ("npm", "a", {"time": {"created": "2024-02-01T00:00:00.000Z"}}),
        ("npm", "b", {"time": {"created": "yesterday"}}),
        ("npm", "c", {"time": {}}),
    )
    rows = registry.package_age(_names(spark, "a", "b", "c", "d"), meta, AS_OF, "NPM").collect()
    assert {r.name: (r.registry, r.created_date, r.age_days, r.error) for r in rows} == {
        "a": ("npm", "2024-02-01T00:00:00.000Z", 19, None),
        "b": ("npm", "yesterday", None, None),
        "c": ("npm", None, None, None),
        "d": ("npm", None, None, "Package not found on npm"),
    }
    other = registry.package_age(_names(spark, "a"), meta, AS_OF, "anything").collect()[0]
    assert (other.registry, other.error) == ("pypi", "Package not found on PyPI")


@pytest.mark.parametrize("count, bucket", [(0, "low"), (10, "low"), (11, "medium"), (50, "medium"), (51, "high")])
def test_popularity(spark, snapshot, count, bucket):
    meta = snapshot(("pypi", "p", {"releases": {str(i): [] for i in range(count)}}))
    assert registry.package_age(_names(spark, "p"), meta, AS_OF).collect()[0].downloads_estimate == bucket


def test_snapshot_from_json_lines(spark, tmp_path):
    row = {"registry": "pypi", "name": "a", "doc": '{"info": {"version": "9"}}', "lookup_status": "found"}
    (tmp_path / "s.json").write_text(json.dumps(row))
    meta = parse_snapshot(read_snapshot(spark, str(tmp_path), "json"))
    assert [(r.name, r.version) for r in meta.collect()] == [("a", "9")]


def test_dependency_audit(spark, files_of, snapshot):
    def young(days):
        return {"info": {"version": "1"}, **_release((AS_OF - timedelta(days=days)).isoformat())}

    meta = snapshot(
        ("pypi", "flask", young(400)), ("pypi", "flaks", young(29)), ("pypi", "new", young(-3)),
        ("pypi", "old", young(30)), ("npm", "express", {"dist-tags": {"latest": "4"}}),
    )
    files = files_of(
        {
            "requirements.txt": "flask\nflaks\nnew\nold\ncryptographic\nmade-up\n",
            "package.json": '{"dependencies": {"express": "1", "flask": "1"}}',
        }
    )
    found = dependencies.scan_dependencies(files, meta, AS_OF)
    got = {(r.package, r.registry): r for r in found.collect()}
    assert got["flaks", "pypi"].typosquat_risk == "medium"
    assert [tuple(s) for s in got["cryptographic", "pypi"].typosquat_similar_to] == [("cryptography", 2)]
    assert (got["flask", "npm"].exists, got["flask", "npm"].version) == (False, None)
    assert (got["express", "npm"].exists, got["express", "npm"].version) == (True, "4")
    assert got["new", "pypi"].age_days == -3
    lists = {(r.kind, r.part): r["items"] for r in dependencies.warning_lists(found, 2).collect()}
    assert lists == {
        ("hallucinated", 0): ["cryptographic", "made-up"],
        ("hallucinated", 1): ["flask"],
        ("typosquat", 0): ["flaks", "cryptographic"],
        ("new", 0): ["flaks", "new"],
    }
    known = spark.createDataFrame([("olds", 0), ("express", 1)], "name string, ord int")
    other = dependencies.scan_dependencies(files, meta, AS_OF, known).where("size(typosquat_similar_to) > 0")
    assert [(r.package, r.typosquat_risk) for r in other.collect()] == [("old", "high")]


def test_summary_of_missing_and_empty_repositories(spark, files_of, snapshot):
    files = files_of({"requirements.txt": "flask"})
    found = dependencies.scan_dependencies(files, snapshot(("pypi", "x", {})), AS_OF)
    repos = spark.createDataFrame(
        [("r", "/r", True), ("empty", "/e", True), ("gone", "/g", False)],
        "repo string, root string, found boolean",
    )
    rows = {r.repo: r for r in dependencies.dependency_summary(files, found, repos).collect()}
    assert (rows["r"].total_packages, rows["r"].hallucinated_packages, rows["r"].message) == (1, 1, None)
    assert rows["empty"].message == "No dependency files found in the repository."
    assert rows["gone"].error == "Repository path does not exist: /g"
    assert rows["gone"].message is None and rows["empty"].error is None
