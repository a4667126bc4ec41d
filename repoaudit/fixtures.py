"""Inputs for the checks, derived from the driver's tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its oracle start
from the same rows. Only the ordered aggregate is spelled differently. The views grow with
their tables; the texts they aggregate stay bounded, since a repository of ``V2`` takes 500
consecutive parts and a package of ``V3`` takes its releases from 2000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One line per security rule, in rule order, then lines that must not match.
_SEED_LINES = (
    "'k = \"sk-' || repeat('a', 20) || '\"'",
    "'k = \"AKIA' || repeat('A', 16) || '\"'",
    "'k = \"ghp_' || repeat('a', 36) || '\"'",
    "'api_key = \"abcdef\"'",
    "'Authorization: Bearer abc.def'",
    "'k = \"xoxb-abc\"'",
    "'k = \"sk_live_' || repeat('a', 24) || '\"'",
    "'k = \"rk_live_' || repeat('a', 24) || '\"'",
    "'k = \"SK' || repeat('a', 32) || '\"'",
    "'k = \"AIza' || repeat('a', 35) || '\"'",
    "'-----BEGIN RSA PRIVATE' || ' KEY-----'",
    "'password = \"abcd\"'",
    "'u = \"mysql://u:p@h/db\"'",
    "'cur.execute(f\"x\")'",
    "'q = \"SELECT %s\" % (a, \"%\")'",
    "'q = \"x\".format(a) + \" UPDATE\"'",
    "'q = \"SELECT {}\".format(a)'",
    "'cur.execute(\"SELECT a\" + b)'",
    "'r = eval(x)'",
    "'exec(x)'",
    "'os.system(x)'",
    "'subprocess.call(x, shell=True)'",
    "'subprocess.Popen(x, shell=True)'",
    "'subprocess.run(x, shell=True)'",
    "'os.popen(x)'",
    "'commands.getoutput(x)'",
    "'pickle.loads(x)'",
    "'yaml.load(f, Loader=SafeLoader)'",
    "'marshal.load(f)'",
    "'shelve.open(f)'",
    "'jsonpickle.decode(x)'",
    "'request.args.get(\"a\")'",
    "'request.form.get(\"a\")'",
    "'b = request.json'",
    "'b = request.data'",
    "'u = \"http://x.example/\"'",
    "'get(u, verify=False)'",
    "'app.run(debug=True)'",
    "'DEBUG = True'",
    "'hashlib.md5(x)'",
    "'hashlib.sha1(x)'",
    "'cipher = DES'",
    "'cipher = RC4'",
    "'open(filename)'",
    "'os.path.join(a, user_input)'",
    "'u = \"http://localhost/x\"'",
    "'password = \"abc\"'",
    "'token = \"{x}\"'",
    "'evaluate(x)'",
    "'subprocess.run(x)'",
)


def _case(selector: str, values, numbered: bool = True) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} {arms} END"


# V1: documents as source files of 20 repositories, each with one line of code at its end.
V1_SOURCE_FILES = f"""
SELECT source AS repo,
       CASE lang WHEN 'en' THEN 'src/d' || CAST(doc_id AS STRING) || '.py'
                 WHEN 'fr' THEN 'web/d' || CAST(doc_id AS STRING) || '.ts'
                 WHEN 'de' THEN 'docs/d' || CAST(doc_id AS STRING) || '.md'
                 ELSE 'pkg/build/d' || CAST(doc_id AS STRING) || '.py' END AS path,
       text || chr(10) || '  ' || {_case(f"doc_id % {len(_SEED_LINES)}", _SEED_LINES)} AS content
FROM documents
"""

# Package names: 64 per 2000 parts, so that their number grows with the table.
PACKAGE = (
    "(replace(p_name, ' ', '-') || CASE WHEN p_partkey < 2000 THEN '' "
    "ELSE '-' || CAST(CAST(floor(p_partkey / 2000) AS BIGINT) AS STRING) END)"
)
_REPO = "(p_brand || '/' || CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING))"


def _joined(engine: str, value: str, separator: str, order: str = "p_partkey") -> str:
    if engine == "spark":
        return f"listagg({value}, {separator}) WITHIN GROUP (ORDER BY {order})"
    return f"string_agg({value}, {separator} ORDER BY {order})"


def v2_manifests(engine: str) -> str:
    """Six manifests per repository; the names of each come from a quarter of its parts."""
    size = "CAST(p_size AS STRING)"
    req = _joined(engine, f"package || '[extra]>=' || {size}", "chr(10)")
    setup = _joined(engine, f"'  \"' || package || '>=' || {size} || '\",'", "chr(10)")
    project = _joined(engine, "'\"' || package || '\"'", "', '")
    npm = _joined(engine, f"'\"' || package || '\": \"^' || {size} || '\"'", "', '")

    def one(path: str, m: int, content: str) -> str:
        return (
            f"SELECT repo, '{path}' AS path, {content} AS content "
            f"FROM p WHERE p_partkey % 4 = {m} GROUP BY repo"
        )

    files = [
        one(
            "requirements.txt",
            0,
            "'# deps' || chr(10) || '-r base.txt' || chr(10) || 'httpx==0.27' || chr(10) || "
            f"'  Git+https://x/y' || chr(10) || {req} || chr(10)",
        ),
        one("setup.py", 1, f"'setup(install_requires = [' || chr(10) || {setup} || chr(10) || '])'"),
        one(
            "pyproject.toml",
            2,
            f"'[project]' || chr(10) || 'dependencies = [' || {project} || ']' || chr(10) || "
            "'optional-dependencies = [\"pytest\"]'",
        ),
        one(
            "package.json",
            3,
            f"'{{\"dependencies\": {{' || {npm} || '}}, \"devDependencies\": {{\"Express\": \"1\"}}, "
            "\"peerDependencies\": {\"x\": \"1\"}}'",
        ),
        # Look-alikes of popular names, one or two edits away, in turns.
        "SELECT repo, 'requirements-dev.txt' AS path, 'pytest' || chr(13) || chr(10) || "
        "min(package) || chr(10) || CASE WHEN min(p_partkey) % 1000 < 500 THEN 'reqests' "
        "ELSE 'flaks' END AS content FROM p GROUP BY repo",
        "SELECT repo, 'sub/requirements.txt' AS path, 'ignored==1' AS content FROM p GROUP BY repo",
    ]
    source = f"SELECT {_REPO} AS repo, {PACKAGE} AS package, p_partkey, p_size FROM part"
    return f"WITH p AS ({source}) " + " UNION ALL ".join(files)


# V3: releases. Names with 'cold' do not exist; those with 'new' are young.
V3_RELEASES = f"""
SELECT {PACKAGE} AS name, r.registry, CAST(p_partkey AS STRING) AS version, p_partkey,
       timestamp '2023-01-01 00:00:00' + (p_partkey * 6) * interval '1' hour AS upload_time
FROM part EACH_REGISTRY
WHERE p_name NOT LIKE 'cold%'
  AND NOT (p_name LIKE 'new%' AND p_partkey % 2000 < 1500)
  AND (r.registry = 'pypi' OR p_partkey % 2 = 0)
"""


def v3_releases(engine: str) -> str:
    """npm knows the releases with even numbers only."""
    generated = (
        "LATERAL VIEW explode(array('pypi', 'npm')) r AS registry"
        if engine == "spark"
        else ", (SELECT unnest(['pypi', 'npm']) AS registry) r"
    )
    return V3_RELEASES.replace("EACH_REGISTRY", generated)


def v3_packages(engine: str) -> str:
    """One row per registry and name: what its document says."""
    return f"""
    SELECT registry, name, count(*) AS releases, min(upload_time) AS created,
           max(p_partkey) AS last_key, min(p_partkey) AS first_key
    FROM ({v3_releases(engine)}) v GROUP BY registry, name
    """


# Lookups that failed: the snapshot holds an error in place of a document.
FAILED = "name LIKE 'hot-rod%'"

AS_OF = "2024-02-20 00:00:00"

# V4: Python files. Each is a template of a few statements, with the whole text of a
# document as a string behind it, so that parsing works on real amounts of text. Each of the known
# modules has a bad call in one of them.
_TEMPLATES = (
    ("import requests", 'requests.secure_get("x")'),
    ("import pandas as pd", "pd.read_exel(3)", "pd.io.foo()"),
    ("from flask import request", 'request.args.get("a")'),
    ("import tensorflow.keras as K", "K.Sequential()"),
    ("import os.path", 'os.path.joinn("a")'),
    ("import pandas as pd", 'pd.read_csvs("x")', 'pd.read_csv("y")'),
    ("def broken(:",),
    ("import redis as t", "import requests as t", "t.sesion(1)"),
    ("import requests", "requests.a.b.c()", "requests.zzz()"),
    ("import redis", "def f():", "    return redis.\\", "        Redis()"),
    ("import numpy as np", "np.arrange(3)", "np.random.foo()"),
    ("import torch as t", "import numpy as t", "t.tensr(1)"),
    ("import torch", "torch.tensr(1)", "torch.nn.Linear(2)"),
    ("import httpx", "import flask", 'httpx.gets("x")', "flask.Flaskk(1)", "flask.jsonify()"),
    ("import fastapi, django", "fastapi.Depend()", "django.setups()", "django.db.connect()"),
    ("import openai as o", "import langchain as l", "o.OpenAl()", "l.LLMChains()", "l.tools.load()"),
    ("import transformers as tr, sqlalchemy as sa", "tr.AutoModels(1)", "sa.create_engin()", "tr.pipeline(2)"),
    ("import boto3", "import sklearn.svm", "import sklearn", 'boto3.clients("s3")', "sklearn.svmm.SVC()", "sklearn.svm.SVC()"),
    ("import pydantic, celery", "pydantic.BaseModels()", "celery.Celry()", 'celery.Celery("a")'),
    ("import pytest, PIL", "import pillow", "pytest.raise_(1)", "PIL.Imag()", "pillow.Imagee()", "pytest.raises(1)"),
)


def _template_sql(lines: tuple[str, ...]) -> str:
    parts = [
        "'" + line.removesuffix("\\") + "'" + (" || chr(92)" if line.endswith("\\") else "")
        for line in lines
    ]
    return " || chr(10) || ".join(parts)


V4_PY_SOURCES = f"""
SELECT source AS repo, 'm/f' || CAST(doc_id AS STRING) || '.py' AS path, doc_id,
       {_case(f"doc_id % {len(_TEMPLATES)}", [_template_sql(t) for t in _TEMPLATES])}
       || chr(10) || 'NOTE = ' || repeat(chr(34), 3)
       || replace(replace(text, chr(92), ' '), chr(34), ' ')
       || repeat(chr(34), 3) || chr(10) AS content
FROM documents
"""

# Syllables of the documents' languages, for the rules of a caller.
_SYLLABLES = ("tion", "eau", "ing", "ment", "sch", "ung", "ado", "the", "und", "que", "les", "oun")


def own_rules():
    """Rules of a caller: one for each pair of syllables, with two patterns and no literals given."""
    from repoaudit.rules import SecurityRule

    return tuple(
        SecurityRule(f"{a}_{b}", ("low", "medium")[len(a) % 2], f"'{a}' before '{b}'", (rf"{a}.{{2,3}}{b}[.,]", rf"{b}\s+{a}[a-e]+$"))
        for a in _SYLLABLES
        for b in _SYLLABLES
    )


# Names one edit or more away from a popular one, or equal to it.
V6_NAMES = """
SELECT p_partkey, CASE p_size % 6
    WHEN 0 THEN popular
    WHEN 1 THEN substr(popular, 1, length(popular) - 1)
    WHEN 2 THEN upper(popular) || 'x'
    WHEN 3 THEN 'py' || popular
    WHEN 4 THEN '  ' || replace(popular, 'e', 'a') || ' '
    ELSE replace(p_name, ' ', '-') END AS name
FROM (SELECT p_partkey, p_size, p_name, CASE p_partkey % 25 POPULAR END AS popular FROM part) t
"""


def v6_names() -> str:
    from repoaudit.rules import POPULAR_PACKAGES

    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(POPULAR_PACKAGES))
    return V6_NAMES.replace("POPULAR", arms)


# Long names with common beginnings; every other one is known, and the asked ones have up to three
# changes: at the front, in the middle, at the end.
LONG_NAME = (
    "('lib-' || replace(p_name, ' ', '-') || '-for-' || lower(p_type) || '-' "
    "|| CAST(p_partkey % 97 AS STRING) || '-' || substr(p_name, 1, 3) || CAST(p_size AS STRING))"
)
KNOWN_LONG_NAMES = f"SELECT DISTINCT {LONG_NAME} AS name FROM part WHERE p_partkey % 2 = 0"
LONG_NAMES = f"""
SELECT p_partkey, CASE p_partkey % 7
    WHEN 0 THEN upper(long)
    WHEN 1 THEN substr(long, 2)
    WHEN 2 THEN substr(long, 1, 9) || 'q' || substr(long, 10)
    WHEN 3 THEN 'x' || substr(long, 1, length(long) - 1)
    WHEN 4 THEN substr(long, 1, 6) || substr(long, 9)
    WHEN 5 THEN substr(long, 1, 12) || 'zz' || substr(long, 15)
    ELSE 'py' || substr(long, 1, 11) || '_' || substr(long, 13) END AS name
FROM (SELECT p_partkey, {LONG_NAME} AS long FROM part) t
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents")
    return spread(spark.sql(V1_SOURCE_FILES))


def py_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents")
    return spread(spark.sql(V4_PY_SOURCES).drop("doc_id"))


def spread(files: DataFrame) -> DataFrame:
    """Give every core a share of a small input; a large one has shares enough as it is."""
    enough = 2 * files.sparkSession.sparkContext.defaultParallelism
    if files.rdd.getNumPartitions() >= enough:
        return files
    return files.repartition(enough, *[c for c in files.columns if c != "content"])


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    return spark.sql(v2_manifests("spark"))


_STAMP = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"

_PYPI_DOC = f"""
'{{"info":{{"name":"' || upper(name) || '","version":"' || last_key
|| '","home_page":"https://x.example/' || name || '"'
|| CASE last_key % 2 WHEN 0 THEN ',"summary":"about ' || name || '"' ELSE ',"license":"MIT"' END
|| CASE last_key % 3 WHEN 0 THEN ',"author":"ann"' WHEN 1 THEN ',"author":null' ELSE '' END
|| '}},"releases":{{' || releases || '}}}}'
"""
_PYPI_RELEASE = f"""
'"' || version || '":[{{"upload_time_iso_8601":"' || {_STAMP.format("upload_time")}
|| '"}},{{"upload_time_iso_8601":"not a time"}},{{"upload_time_iso_8601":"2001-01-01T00:00:00"}}]'
"""
_NPM_DOC = f"""
'{{"name":"' || name || '","dist-tags":{{"latest":"' || last_key || '"}},"time":{{"created":"'
|| {_STAMP.format("created")} || '"}},'
|| CASE last_key % 4 WHEN 0 THEN '"author":{{"email":"e"}},"description":"js ' || name || '",'
                     ELSE '"author":null,' END
|| CASE last_key % 8 WHEN 0 THEN '"license":"Apache",' ELSE '' END
|| '"versions":{{' || releases || '}}}}'
"""
_NPM_RELEASE = """
'"' || version || '":{' || CASE p_partkey % 6
WHEN 0 THEN '"author":{"name":"ann"},"license":"MIT"'
WHEN 2 THEN '"author":"bob"'
ELSE '"author":null,"license":"BSD"' END || '}'
"""


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repositories of ``V1`` and ``V2``, one row each."""
    tables(spark, sf_dir, "documents", "part")
    return spark.sql(
        f"SELECT repo, '/data/' || repo AS root, true AS found FROM "
        f"(SELECT DISTINCT source AS repo FROM documents UNION SELECT DISTINCT {_REPO} FROM part) r"
    )


def registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of ``V3``: documents as the two registries would serve them."""
    tables(spark, sf_dir, "part")

    def docs(registry: str, release: str, doc: str) -> str:
        listed = _joined("spark", release, "','")
        return f"""
        SELECT '{registry}' AS registry, name, CASE WHEN NOT ({FAILED}) THEN {doc} END AS doc,
               CASE WHEN {FAILED} THEN 'error' ELSE 'found' END AS lookup_status,
               CASE WHEN {FAILED} THEN 'timed out' END AS lookup_error
        FROM (SELECT name, CAST(max(p_partkey) AS STRING) AS last_key,
                     min(upload_time) AS created, {listed} AS releases
              FROM ({v3_releases("spark")}) v WHERE registry = '{registry}' GROUP BY name) g
        """

    pypi = docs("pypi", _PYPI_RELEASE, _PYPI_DOC)
    return spark.sql(f"{pypi} UNION ALL {docs('npm', _NPM_RELEASE, _NPM_DOC)}")


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct package names of the parts."""
    tables(spark, sf_dir, "part")
    return spark.sql(f"SELECT DISTINCT {PACKAGE} AS name FROM part")


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package names that begin with 'old', in alphabetical order."""
    names = package_names(spark, sf_dir).where("name LIKE 'old%'")
    return names.selectExpr("name", "0 AS ord")


def look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    return spark.sql(v6_names())


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    return spark.sql(LONG_NAMES)


def known_long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    return spark.sql(KNOWN_LONG_NAMES).selectExpr("name", "0 AS ord")
