from pyspark.sql import functions as F

from repoaudit.operators import manifests


def _packages(files_of, files):
    rows = manifests.all_packages(files_of(files)).orderBy("file_ord", "source_file", "pos").collect()
    return [(r.source_file, r.package, r.registry) for r in rows]


def test_requirements(files_of):
    content = (
        "# deps\n-r base.txt\nhttpx==0.27\n  Git+https://x/y\r\nFlask[async]>=2 ; python_version\r"
        "./local\n\n_private\nruamel.yaml==1\nzope-\na\n\u00a0pandas\u2003\nhttp-parser\n"
    )
    assert _packages(files_of, {"requirements.txt": content}) == [
        ("requirements.txt", name, "pypi")
        for name in ["git", "flask", "ruamel.yaml", "zope", "a", "pandas"]
    ]


def test_setup_py_reads_the_first_list_to_its_first_bracket(files_of):
    content = (
        "setup(install_requires = [\n  'Alpha>=1', \"u[s]\", 'beta'],\n"
        "  extras={}, install_requires=['gamma'])"
    )
    assert _packages(files_of, {"setup.py": content}) == [("setup.py", "alpha", "pypi")]
    plain = "install_requires=['A==1', \" b\", 'c.d;x', '']"
    assert [p for _, p, _ in _packages(files_of, {"setup.py": plain})] == ["a", "c.d"]


def test_pyproject_reads_every_list(files_of):
    content = (
        '[project]\ndependencies = ["A>=1",\n \'b\']\n[x]\noptional-dependencies = ["c"]\n'
        'dev-dependencies=["d"]\n[tool.poetry.dependencies]\ne = "1"\n'
    )
    assert [p for _, p, _ in _packages(files_of, {"pyproject.toml": content})] == list("abcd")


def test_package_json(files_of):
    good = '{"devDependencies": {"C": "1"}, "dependencies": {"B": {"v": 1}, "a": "2", "B": "3"}}'
    assert _packages(files_of, {"package.json": good}) == [
        ("package.json", "B", "npm"), ("package.json", "a", "npm"), ("package.json", "C", "npm"),
    ]
    for bad in (
        '{"dependencies": {"a": 1}',
        '{"dependencies": {"a": 1}} trailing',
        '{"dependencies": {"a": 1}}, {}',
        '[{"dependencies": {"a": 1}}]',
        '{"dependencies": ["a"]}',
        '{"dependencies": null}',
        "",
        "not json",
        "{'dependencies': {'a': 1}}",
        '{"dependencies": {"a": "x\ty"}}',
        '{dependencies: {"a": 1}}',
        '\ufeff{"dependencies": {"a": 1}}',
    ):
        assert _packages(files_of, {"package.json": bad}) == [], bad


def test_only_root_manifests_in_reading_order(files_of):
    files = files_of(
        {n: "x" for n in [
            "requirements-z.txt", "requirements.txt", "package.json", "requirementsA.txt",
            "setup.py", "sub/setup.py", "pyproject.toml", "Requirements.txt", "setup.cfg",
        ]}
    )
    rows = manifests.manifest_list(files).orderBy("file_ord", "source_file").collect()
    assert [r.source_file for r in rows] == [
        "requirements.txt", "setup.py", "pyproject.toml", "package.json",
        "requirements-z.txt", "requirementsA.txt",
    ]


def test_first_mention_wins_per_registry(files_of):
    rows = manifests.dependencies(
        files_of(
            {
                "requirements.txt": "b\na\nb\n",
                "requirements-dev.txt": "a\nc\n",
                "package.json": '{"dependencies": {"a": "1"}}',
            }
        )
    ).collect()
    assert {(r.package, r.registry, r.source_file, r.pos) for r in rows} == {
        ("b", "pypi", "requirements.txt", 0),
        ("a", "pypi", "requirements.txt", 1),
        ("c", "pypi", "requirements-dev.txt", 1),
        ("a", "npm", "package.json", 0),
    }


def test_bad_bytes_stay_visible_in_manifests(spark):
    files = spark.createDataFrame(
        [("r", "requirements.txt", bytearray(b"fl\xffask\n\xffred\nok"))],
        "repo string, path string, content binary",
    )
    rows = manifests.all_packages(files).orderBy("pos").collect()
    assert [r.package for r in rows] == ["fl", "ok"]


def test_one_pass_over_the_files(files_of):
    files = files_of({"requirements.txt": "a"}).withColumn("kind", F.lit("manifest"))
    plan = manifests.all_packages(files)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Exchange" not in plan
