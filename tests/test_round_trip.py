"""Source files written as trees, scanned from there, against the registered query over the table."""

import os

import pytest

from repoaudit import fixtures as fx
from repoaudit.operators import security
from repoaudit.plans.queries import ALL
from repoaudit.rules import SECURITY_RULES, SecurityRule
from repoaudit.sources import tree

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def trees(spark, tmp_path_factory):
    """A folder per repository, with every row of ``source_files`` as a file, and its roots."""
    root = tmp_path_factory.mktemp("trees")
    folders = {}
    for row in fx.source_files(spark, SF).collect():
        folder = folders.setdefault(row.repo, root / f"r{len(folders)}")
        path = folder / row.path
        path.parent.mkdir(parents=True, exist_ok=True)
        content = row.content
        path.write_bytes(content.encode() if isinstance(content, str) else bytes(content))
    return tree.check_roots(tree.roots_table(spark, {name: str(folder) for name, folder in folders.items()}))


def rows_of(findings):
    names = ("repo", "file", "line_number", "category", "severity", "code_snippet", "description")
    return sorted(tuple(r[n] for n in names) for r in findings.collect())


def test_a_scan_of_trees_equals_the_query(spark, trees):
    read = tree.read_trees(trees)
    got = rows_of(security.scan_security(read))
    assert got == rows_of(ALL["security_findings"](spark, SF)) and got
    # Paths are relative to the root of their repository, and texts come back as they were.
    files = {(r.repo, r.path): r.content for r in fx.source_files(spark, SF).collect()}
    back = {(r.repo, r.path): r.content for r in read.collect()}
    assert set(back) <= set(files) and len(back) > 50
    assert all(bytes(v) == files[k].encode() for k, v in back.items())


def test_a_broken_rule_changes_nothing(spark, trees):
    rules = (*SECURITY_RULES, SecurityRule("broken", "high", "Never", ("(unclosed",)))
    with pytest.warns(UserWarning):
        got = rows_of(security.scan_security(tree.read_trees(trees), rules))
    assert got == rows_of(security.scan_security(fx.source_files(spark, SF)))
