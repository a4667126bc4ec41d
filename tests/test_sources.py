import os

import pytest
from pyspark.sql import functions as F

from repoaudit.operators import apicheck, manifests, security
from repoaudit.sources import tables, tree
from repoaudit.streaming import scan


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, content in {
        "a.py": b"eval(x)\n",
        "pkg/__init__.py": b"exec(y)\n",
        "pkg/_private/deep/down/z.js": b"eval(z)\n",
        ".github/w.ts": b"eval(w)\n",
        "node_modules/n.js": b"eval(n)\n",
        "requirements.txt": b"flask\nfl\xffask\n",
        "setup.py": b"install_requires=['a\xff']\neval(\xffx)\n",
        "README.md": b"eval(x)\n",
        "pkg/requirements.txt": b"no\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(root / "pkg", root / "linked")
    os.symlink(root / "nowhere.py", root / "dangling.py")
    os.symlink(root / "a.py", root / "link.py")
    return root


def test_tree_scan(spark, repo):
    roots = tree.roots_table(spark, {"one": str(repo), "two": repo.as_uri(), "gone": str(repo / "x")})
    checked = {r.repo: r.found for r in tree.check_roots(roots).collect()}
    assert checked == {"one": True, "two": True, "gone": False}
    files = tree.read_trees(roots.where("repo <> 'two'"))
    found = {(r.file, r.line_number) for r in security.scan_security(files).collect()}
    assert found == {
        ("a.py", 1), ("link.py", 1), ("pkg/__init__.py", 1), ("pkg/_private/deep/down/z.js", 1),
        (".github/w.ts", 1), ("setup.py", 2),
    }
    names = {r.package for r in manifests.all_packages(files).collect()}
    assert names == {"flask", "fl", "a"}
    snippet = security.scan_security(files).where("file = 'setup.py'").collect()[0].code_snippet
    assert snippet == "eval(x)"
    assert apicheck.parse_python(files).where("parsed").count() == 4


def test_names_that_are_not_utf8(spark, tmp_path):
    folder = os.path.join(os.fsencode(tmp_path), b"d\xe9")
    os.mkdir(folder)
    for name in (b"caf\xe9.py", b"lit\\xe9.py", "naïve.py".encode()):
        with open(os.path.join(folder, name), "wb") as stream:
            stream.write(b"eval(x)")
    files = tree.read_trees(tree.roots_table(spark, [str(tmp_path)]))
    assert {r.path for r in files.collect()} == {
        "d\\xe9/caf\\xe9.py", "d\\xe9/lit\\xe9.py", "d\\xe9/naïve.py",
    }


def test_one_repository_is_read_by_many_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i}.py").write_text("eval(x)")
    files = tree.read_trees(tree.roots_table(spark, [str(tmp_path)]))
    tasks = files.select(F.spark_partition_id().alias("t")).distinct().count()
    assert files.count() == 60 and tasks > 10


def test_stored_files_read_only_needed_partitions(spark, repo, tmp_path):
    files = tree.read_trees(tree.roots_table(spark, [str(repo)]))
    tables.write_source_files(files, str(tmp_path / "t1"))
    stored = tables.read_source_files(spark, str(tmp_path / "t1"))
    assert security.scan_security(stored).count() == security.scan_security(files).count()
    packages = manifests.all_packages(stored)
    assert {r.package for r in packages.collect()} == {"flask", "fl", "a"}
    plan = packages._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [kind" in plan


def test_unreadable_file_is_left_out(spark, tmp_path):
    (tmp_path / "a.py").write_text("eval(x)")
    listing = spark.createDataFrame(
        [("r", str(tmp_path), "a.py"), ("r", str(tmp_path), "vanished.py")],
        "repo string, root string, path string",
    )
    assert [r.path for r in tree.read_contents(listing).collect()] == ["a.py"]


def test_stream(spark, files_of, tmp_path):
    files = files_of({"a.py": "eval(x)", "b.md": "eval(x)"}).withColumn(
        "content", F.col("content").cast("binary")
    )
    files.write.parquet(str(tmp_path / "in"))

    def run():
        stream = scan.stream_source_files(spark, str(tmp_path / "in"))
        scan.write_findings(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r.file for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.py"]
    files.withColumn("path", F.concat(F.lit("new/"), "path")).write.mode("append").parquet(
        str(tmp_path / "in")
    )
    assert run() == ["a.py", "new/a.py"]
