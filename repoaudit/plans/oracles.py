"""DuckDB SQL with the expected result of each registered query.

The SQL starts from the same fixture texts and states the expected result relationally, or
as the known outcome of each template. Differences of the regex dialect (no look-around,
ASCII classes) are written out.
"""

from __future__ import annotations

from repoaudit import fixtures as fx
from repoaudit.plans.queries import KNOWN
from repoaudit.rules import POPULAR_PACKAGES, SECURITY_RULES

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_NAME = "^([A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _snippet(column: str) -> str:
    text = _strip(column)
    return f"CASE WHEN length({text}) > 200 THEN left({text}, 200) || '…' ELSE {text} END"


def _matches(pattern: str, line: str) -> str:
    if "(?!localhost" in pattern:
        allowed = "http://(?:localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0)"
        return f"contains(lower(regexp_replace({line}, '(?i){allowed}', '!', 'g')), 'http://')"
    pattern = pattern.replace("[^)]*(?!Loader)", "")
    if pattern.startswith(r"\b"):
        pattern = r"(?:^|[^\p{L}\p{N}_])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?:[^\p{L}\p{N}_]|$)"
    pattern = pattern.replace(r"\s", f"[{_SPACE}]")
    return f"regexp_matches({line}, {_quote('(?i)' + pattern)})"


def _rule_rows(lines: str, keys: str, rules=SECURITY_RULES) -> str:
    """Findings of a relation with ``line`` and ``line_number``."""
    arms = []
    for i, rule in enumerate(rules):
        test = " OR ".join(_matches(p, "line") for p in rule.patterns)
        arms.append(
            f"SELECT {keys}, line_number, {_quote(rule.category)} AS category, {i} AS category_ord, "
            f"{_quote(rule.severity)} AS severity, {_snippet('line')} AS code_snippet, "
            f"{_quote(rule.description)} AS description FROM {lines} WHERE {test}"
        )
    return " UNION ALL ".join(arms)


def _numbered_lines(source: str, keys: str, content: str = "content") -> str:
    """Lines of texts; a final break starts no further line."""
    return f"""
    SELECT {keys}, unnest(CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END) AS line,
           generate_subscripts(CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END, 1) AS line_number
    FROM (SELECT *, string_split_regex({content}, '{_BREAK}') AS parts FROM ({source}) s0) s1
    """


_PATHS = f"""
SELECT *, regexp_extract(string_split(path, '/')[-1], '^\\.*[^.].*(\\.[^.]*)$', 1) AS extension,
  len(list_intersect(string_split(path, '/')[:-2],
    ['node_modules', '.git', '__pycache__', '.venv', 'venv', 'env', '.tox', '.mypy_cache',
     'dist', 'build'])) > 0 AS skipped
FROM ({fx.V1_SOURCE_FILES}) v1
"""
_SCANNED = f"""
SELECT repo, path AS file, content FROM ({_PATHS}) p1
WHERE extension IN ('.py', '.js', '.ts', '.jsx', '.tsx') AND NOT skipped
"""
_LINES = _numbered_lines(_SCANNED, "repo, file")
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_SECURITY = f"code AS MATERIALIZED ({_LINES}), sec AS ({_rule_rows('code', 'repo, file')})"
_RANKED = f"""
SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_RANK}, file, line_number, category_ord) AS n
FROM sec
"""

# Manifests -------------------------------------------------------------------------------

_V2 = fx.v2_manifests("duckdb")
_FILE_ORD = (
    "CASE path WHEN 'requirements.txt' THEN 0 WHEN 'setup.py' THEN 1 "
    "WHEN 'pyproject.toml' THEN 2 WHEN 'package.json' THEN 3 ELSE 4 END"
)
_MANIFESTS = f"""
SELECT repo, path AS source_file, {_FILE_ORD} AS file_ord, content FROM ({_V2}) v2
WHERE NOT contains(path, '/')
"""
_QUOTED = """['"]([^'"]+)['"]"""


def _items(condition: str, items: str) -> str:
    return f"""
    SELECT repo, source_file, file_ord, unnest(items) AS item,
           generate_subscripts(items, 1) - 1 AS pos
    FROM (SELECT *, {items} AS items FROM man WHERE {condition}) i0
    """


_TXT = f"""
SELECT repo, source_file, file_ord, pos, lower(regexp_extract(item, '{_NAME}', 1)) AS package,
       'pypi' AS registry
FROM (SELECT * REPLACE ({_strip("item")} AS item) FROM ({
    _items("source_file LIKE '%.txt'", "string_split_regex(content, '\r\n|\r|\n')")
}) t0) t1
WHERE item <> '' AND NOT regexp_matches(item, '^(#|-|http)') AND regexp_matches(item, '{_NAME}')
"""


def _listed(condition: str, blocks: str) -> str:
    items = f"regexp_extract_all({blocks}, {_quote(_QUOTED)}, 1)"
    return f"""
    SELECT repo, source_file, file_ord, pos, lower(regexp_extract(item, '{_NAME}', 1)) AS package,
           'pypi' AS registry
    FROM ({_items(condition, items)}) l0 WHERE regexp_matches(item, '{_NAME}')
    """


_SETUP = _listed(
    "source_file = 'setup.py'",
    r"regexp_extract(content, 'install_requires\s*=\s*\[([^\]]*)\]', 1)",
)
_PROJECT = _listed(
    "source_file = 'pyproject.toml'",
    r"array_to_string(regexp_extract_all(content, 'dependencies\s*=\s*\[([^\]]*)\]', 1), ' ')",
)
_NPM = f"""
SELECT repo, source_file, file_ord, pos, item AS package, 'npm' AS registry FROM ({
    _items(
        "source_file = 'package.json'",
        # The keys come in document order; a repeated key counts once, at its first place.
        "list_concat(list_filter(json_keys(content, '$.dependencies'), lambda k, i: "
        "list_position(json_keys(content, '$.dependencies'), k) = i), "
        "json_keys(content, '$.devDependencies'))",
    )
}) n0
"""
_PACKAGES = f"man AS ({_MANIFESTS}), pkg AS ({_TXT} UNION ALL {_SETUP} UNION ALL {_PROJECT} UNION ALL {_NPM})"
_DEPS = f"""{_PACKAGES}, deps AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, package, registry
                                 ORDER BY file_ord, source_file, pos) AS rn FROM pkg) d0
  WHERE rn = 1)"""


def _package_query(condition: str) -> str:
    return f"WITH {_PACKAGES} SELECT repo, source_file, pos, package, registry FROM pkg WHERE {condition}"


# Registries ------------------------------------------------------------------------------

_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_AGE = f"CAST(floor((epoch(timestamp '{fx.AS_OF}') - epoch(created)) / 86400) AS INTEGER)"
_BUCKET = "CASE WHEN releases > 50 THEN 'high' WHEN releases > 10 THEN 'medium' ELSE 'low' END"
_REG = f"reg AS (SELECT *, {fx.FAILED} AS failed FROM ({fx.v3_packages('duckdb')}) r0)"
_NAMES = f"names AS (SELECT DISTINCT {fx.PACKAGE} AS name FROM part)"


def _looked_up(registry: str, columns: str) -> str:
    return f"""
    WITH {_REG}, {_NAMES}, j AS (
      SELECT n.name AS asked, r.* EXCLUDE (name), r.name IS NOT NULL AND NOT r.failed AS ok
      FROM names n LEFT JOIN reg r ON n.name = r.name AND r.registry = '{registry}')
    SELECT {columns} FROM j
    """


def _error(label: str) -> str:
    return (
        f"CASE WHEN ok THEN NULL WHEN failed THEN '{label} request failed: timed out' "
        f"ELSE 'Package not found on {label}' END AS error"
    )


_PYPI_META = f"""
'pypi' AS registry, asked AS package_name, ok AS exists,
CASE WHEN ok THEN upper(asked) ELSE asked END AS name,
CASE WHEN ok THEN CAST(last_key AS VARCHAR) END AS version,
CASE WHEN ok THEN CASE last_key % 2 WHEN 0 THEN 'about ' || asked ELSE '' END END AS summary,
CASE WHEN ok THEN CASE last_key % 3 WHEN 0 THEN 'ann' WHEN 1 THEN NULL ELSE 'unknown' END END AS author,
CASE WHEN ok THEN 'https://x.example/' || asked END AS home_page,
CASE WHEN ok THEN CASE last_key % 2 WHEN 0 THEN 'unknown' ELSE 'MIT' END END AS license,
{_error("PyPI")}
"""
_NPM_META = f"""
'npm' AS registry, asked AS package_name, ok AS exists, asked AS name,
CASE WHEN ok THEN CAST(last_key AS VARCHAR) END AS version,
CASE WHEN ok THEN CASE last_key % 4 WHEN 0 THEN 'js ' || asked ELSE '' END END AS summary,
CASE WHEN ok THEN CASE last_key % 6 WHEN 0 THEN 'ann' WHEN 2 THEN 'bob' ELSE
  CASE last_key % 4 WHEN 0 THEN 'unknown' ELSE 'None' END END END AS author,
CASE WHEN ok THEN CASE last_key % 6 WHEN 0 THEN 'MIT' WHEN 4 THEN 'BSD' ELSE
  CASE last_key % 8 WHEN 0 THEN 'Apache' ELSE 'unknown' END END END AS license,
{_error("npm")}
"""


def _age_columns(registry: str, name: str, label: str, suffix: str) -> str:
    return f"""
    CASE WHEN ok THEN {name} ELSE asked END AS name, '{registry}' AS registry,
    CASE WHEN ok THEN {_STAMP.format("created")} || '{suffix}' END AS created_date,
    CASE WHEN ok THEN CAST(last_key AS VARCHAR) END AS latest_version,
    CASE WHEN ok THEN {_AGE} END AS age_days,
    CASE WHEN ok THEN {_BUCKET} END AS downloads_estimate,
    {_error(label)}
    """


# Typosquats ------------------------------------------------------------------------------


def _risk(distance: str) -> str:
    return f"CASE WHEN min({distance}) IS NULL THEN 'none' WHEN min({distance}) = 1 THEN 'high' ELSE 'medium' END"


def _values(names) -> str:
    return ", ".join(f"({_quote(n)}, {i})" for i, n in enumerate(names))


def _similar(asked: str, key: str, known: str) -> str:
    """Similar names of each ``key`` of a relation with ``name`` against ``(known, ord)``."""
    return f"""
    SELECT a.{key}, a.name, coalesce(string_agg(k.known || ':' || d, ',' ORDER BY d, k.ord, k.known), '') AS similar_to,
           count(k.known) > 0 AS is_potential_typosquat, {_risk("d")} AS risk_level
    FROM {asked} a LEFT JOIN (
      SELECT DISTINCT n.name, known, ord, levenshtein({_strip("lower(n.name)")}, lower(known)) AS d
      FROM {asked} n, {known} k0
      WHERE levenshtein({_strip("lower(n.name)")}, lower(known)) BETWEEN 1 AND 2) k USING (name)
    GROUP BY ALL
    """


def _findings(names) -> str:
    return f"""{_DEPS}, {_REG},
known AS (SELECT * FROM (VALUES {_values(names)}) v(known, ord)),
risks AS ({_similar("(SELECT DISTINCT package AS key, package AS name FROM deps)", "key", "known")}),
dep AS (
  SELECT d.repo, d.file_ord, d.pos, d.package, d.source_file, d.registry,
         r.name IS NOT NULL AND NOT r.failed AS exists,
         CASE WHEN NOT r.failed THEN CAST(r.last_key AS VARCHAR) END AS version,
         t.risk_level AS typosquat_risk, t.similar_to AS typosquat_similar_to,
         CASE WHEN NOT r.failed THEN {_AGE} END AS age_days
  FROM deps d JOIN risks t ON t.name = d.package
  LEFT JOIN reg r ON r.name = d.package AND r.registry = d.registry)"""


_FINDINGS = _findings(POPULAR_PACKAGES)
_WARNED = f"""{_FINDINGS}, warned AS (
  SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY file_ord, source_file, pos) AS n,
         count(*) OVER (PARTITION BY repo, kind) AS total
  FROM (SELECT *, 'hallucinated' AS kind FROM dep WHERE NOT exists
        UNION ALL SELECT *, 'typosquat' FROM dep WHERE typosquat_similar_to <> ''
        UNION ALL SELECT *, 'new' FROM dep WHERE age_days < 30) w0)"""

# API check: what each template yields ------------------------------------------------------

_IMPORTS = """(VALUES
  (0, 'requests', 'requests'), (1, 'pd', 'pandas'), (3, 'K', 'tensorflow'), (4, 'os.path', 'os'),
  (5, 'pd', 'pandas'), (7, 't', 'redis'), (7, 't', 'requests'), (8, 'requests', 'requests'),
  (9, 'redis', 'redis'),
  (10, 'np', 'numpy'), (11, 't', 'torch'), (11, 't', 'numpy'), (12, 'torch', 'torch'),
  (13, 'httpx', 'httpx'), (13, 'flask', 'flask'), (14, 'fastapi', 'fastapi'), (14, 'django', 'django'),
  (15, 'o', 'openai'), (15, 'l', 'langchain'), (16, 'tr', 'transformers'), (16, 'sa', 'sqlalchemy'),
  (17, 'boto3', 'boto3'), (17, 'sklearn.svm', 'sklearn'), (17, 'sklearn', 'sklearn'),
  (18, 'pydantic', 'pydantic'), (18, 'celery', 'celery'), (19, 'pytest', 'pytest'), (19, 'PIL', 'PIL'),
  (19, 'pillow', 'pillow')) t(template, alias, module)"""
_CALLS = """(VALUES
  (0, 2, 'requests', 'requests', 'secure_get'), (1, 2, 'pd', 'pandas', 'read_exel'),
  (1, 3, 'pd', 'pandas', 'io.foo'), (3, 2, 'K', 'tensorflow', 'Sequential'),
  (5, 2, 'pd', 'pandas', 'read_csvs'), (5, 3, 'pd', 'pandas', 'read_csv'),
  (7, 3, 't', 'requests', 'sesion'), (8, 3, 'requests', 'requests', 'zzz'),
  (9, 3, 'redis', 'redis', 'Redis'),
  (10, 2, 'np', 'numpy', 'arrange'), (10, 3, 'np', 'numpy', 'random.foo'),
  (11, 3, 't', 'numpy', 'tensr'), (12, 2, 'torch', 'torch', 'tensr'),
  (12, 3, 'torch', 'torch', 'nn.Linear'), (13, 3, 'httpx', 'httpx', 'gets'),
  (13, 4, 'flask', 'flask', 'Flaskk'), (13, 5, 'flask', 'flask', 'jsonify'),
  (14, 2, 'fastapi', 'fastapi', 'Depend'), (14, 3, 'django', 'django', 'setups'),
  (14, 4, 'django', 'django', 'db.connect'), (15, 3, 'o', 'openai', 'OpenAl'),
  (15, 4, 'l', 'langchain', 'LLMChains'), (15, 5, 'l', 'langchain', 'tools.load'),
  (16, 2, 'tr', 'transformers', 'AutoModels'), (16, 3, 'sa', 'sqlalchemy', 'create_engin'),
  (16, 4, 'tr', 'transformers', 'pipeline'), (17, 4, 'boto3', 'boto3', 'clients'),
  (17, 5, 'sklearn', 'sklearn', 'svmm.SVC'), (17, 6, 'sklearn', 'sklearn', 'svm.SVC'),
  (18, 2, 'pydantic', 'pydantic', 'BaseModels'), (18, 3, 'celery', 'celery', 'Celry'),
  (18, 4, 'celery', 'celery', 'Celery'), (19, 3, 'pytest', 'pytest', 'raise_'),
  (19, 4, 'PIL', 'PIL', 'Imag'), (19, 5, 'pillow', 'pillow', 'Imagee'),
  (19, 6, 'pytest', 'pytest', 'raises')) t(template, line_number, alias, module, called_function)"""
_BAD_CALLS = """(VALUES
  (0, 2, 'requests', 'secure_get', 'structures'), (1, 2, 'pandas', 'read_exel', 'read_excel'),
  (3, 2, 'tensorflow', 'Sequential', 'reduce_max'), (5, 2, 'pandas', 'read_csvs', 'read_csv'),
  (7, 3, 'requests', 'sesion', 'Response'), (8, 3, 'requests', 'zzz', NULL),
  (10, 2, 'numpy', 'arrange', 'array_equal'), (11, 3, 'numpy', 'tensr', 'genfromtxt'),
  (12, 2, 'torch', 'tensr', 'Tensor'), (13, 3, 'httpx', 'gets', 'get'),
  (13, 4, 'flask', 'Flaskk', 'Flask'), (14, 2, 'fastapi', 'Depend', 'Depends'),
  (14, 3, 'django', 'setups', 'setup'), (15, 3, 'openai', 'OpenAl', 'OpenAI'),
  (15, 4, 'langchain', 'LLMChains', 'LLMChain'), (16, 2, 'transformers', 'AutoModels', 'AutoModel'),
  (16, 3, 'sqlalchemy', 'create_engin', 'create_engine'), (17, 4, 'boto3', 'clients', 'client'),
  (17, 5, 'sklearn', 'svmm.SVC', 'svm'), (18, 2, 'pydantic', 'BaseModels', 'BaseModel'),
  (18, 3, 'celery', 'Celry', 'Celery'), (19, 3, 'pytest', 'raise_', 'raises'),
  (19, 4, 'PIL', 'Imag', 'Image'), (19, 5, 'pillow', 'Imagee', 'ImageEnhance')
  ) t(template, line_number, module, called_function, better)"""
_V4 = f"SELECT repo, path AS file, doc_id % {len(fx._TEMPLATES)} AS template FROM ({fx.V4_PY_SOURCES}) v4"
_API = f"""api AS (
  SELECT repo, file, line_number, module, called_function, false AS exists_in_api,
         '''' || module || '.' || called_function || ''' does not exist' ||
         CASE WHEN better IS NULL THEN ' in the ''' || module || ''' package. Verify the correct '
              || 'function name in the official documentation.'
              ELSE '. Did you mean ''' || module || '.' || better || '''?' END AS suggestion
  FROM ({_V4}) f JOIN {_BAD_CALLS} USING (template)),
scanned AS (SELECT repo, count(*) FILTER (template <> 6) AS files_scanned FROM ({_V4}) f GROUP BY repo)"""

# Risk and reports --------------------------------------------------------------------------

_SUMMARY = f"""{_FINDINGS}, {_SECURITY}, {_API},
spine AS (SELECT DISTINCT repo FROM ({_V2}) UNION SELECT DISTINCT repo FROM ({fx.V1_SOURCE_FILES})),
counts AS (
  SELECT repo, coalesce(di, 0) AS dependency_issues, coalesce(ne, 0) AS non_existent,
         coalesce(ty, 0) AS typosquats, coalesce(si, 0) AS security_issues,
         coalesce(cr, 0) AS critical, coalesce(hi, 0) AS high, coalesce(me, 0) AS medium,
         coalesce(lo, 0) AS low, coalesce(ai, 0) AS api_hallucinations,
         coalesce(files_scanned, 0) AS files_scanned
  FROM spine
  LEFT JOIN (SELECT repo, count(*) di, count(*) FILTER (NOT exists) ne,
                    count(*) FILTER (typosquat_risk <> 'none') ty FROM dep GROUP BY repo) USING (repo)
  LEFT JOIN (SELECT repo, count(*) si, count(*) FILTER (severity = 'critical') cr,
                    count(*) FILTER (severity = 'high') hi, count(*) FILTER (severity = 'medium') me,
                    count(*) FILTER (severity = 'low') lo FROM sec GROUP BY repo) USING (repo)
  LEFT JOIN (SELECT repo, count(*) ai FROM api GROUP BY repo) USING (repo)
  LEFT JOIN scanned USING (repo)),
summary AS (
  SELECT *, CAST(least(100, 20 * non_existent + 15 * typosquats + 15 * critical + 10 * high
            + 5 * medium + 2 * low + 10 * api_hallucinations) AS INTEGER) AS risk_score,
         dependency_issues + security_issues + api_hallucinations AS total_issues,
         '/data/' || repo AS root, string_split(repo, '/')[-1] AS repository
  FROM counts),
levels AS (
  SELECT *, CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 50 THEN 'High'
                 WHEN risk_score >= 20 THEN 'Medium' ELSE 'Low' END AS risk_level,
         CASE WHEN risk_score >= 80 THEN '🔴' WHEN risk_score >= 50 THEN '🟠'
              WHEN risk_score >= 20 THEN '🟡' ELSE '🟢' END AS badge
  FROM summary)"""

_TEXTS = {
    "missing": (
        "**Remove non-existent packages** (",
        "). These were likely hallucinated by an AI code generator and will cause installation "
        "failures or, worse, install a malicious package.",
    ),
    "lookalike": (
        "**Verify potentially typosquatted packages** (",
        "). Confirm these are the intended packages and not malicious look-alikes.",
    ),
}
_FIXED_TEXTS = (
    (3, "critical > 0",
     "**Immediately rotate any exposed secrets.** Hardcoded API keys and passwords must be moved "
     "to environment variables or a secrets manager (e.g., AWS Secrets Manager, HashiCorp Vault)."),
    (4, "high > 0",
     "**Fix high-severity issues** including SQL injection risks, dangerous `eval`/`exec` usage, "
     "and insecure deserialization. Use parameterized queries, avoid `eval`, and use safe loaders."),
    (5, "medium > 0",
     "**Address medium-severity issues** such as disabled TLS verification, debug mode in "
     "production, and weak crypto algorithms."),
    (6, "api_hallucinations > 0",
     "**Fix hallucinated API calls.** Replace non-existent function calls with the correct API. "
     "Consult official package documentation."),
    (7, "non_existent + typosquats + critical + high + medium + api_hallucinations = 0",
     "No critical issues found — keep following security best practices! 🎉"),
)


def _recommended(part_rows: int) -> str:
    def listed(kind: str, order: int, condition: str) -> str:
        head, tail = _TEXTS[kind]
        return f"""
        SELECT repo, {order} AS o, part,
               CASE part WHEN 0 THEN {_quote(head)} ELSE '' END
               || string_agg('`' || package || '`', ', ' ORDER BY n)
               || CASE WHEN max(n) = max(total) THEN {_quote(tail)} ELSE ',' END AS text
        FROM (SELECT *, (n - 1) // {part_rows} AS part FROM (
                SELECT *, count(*) OVER (PARTITION BY repo) AS total,
                       row_number() OVER (PARTITION BY repo ORDER BY file_ord, source_file, pos) AS n
                FROM dep WHERE {condition}) q0) q1
        GROUP BY repo, part
        """

    fixed = " UNION ALL ".join(
        f"SELECT repo, {o}, 0, {_quote(text)} FROM counts WHERE {condition}"
        for o, condition, text in _FIXED_TEXTS
    )
    return f"""recs AS (
      SELECT repo, dense_rank() OVER (PARTITION BY repo ORDER BY o) AS rec_no, part, text
      FROM ({listed("missing", 1, "NOT exists")} UNION ALL
            {listed("lookalike", 2, "typosquat_risk <> 'none'")} UNION ALL {fixed}) u0)"""


_AT = f"{fx.AS_OF} UTC"


def _text_lines(section: int, lines: list[tuple[str, str]]) -> str:
    """Lines from the summary row: pairs of condition and text expression."""
    return " UNION ALL ".join(
        f"SELECT repo, {section} AS s, {i} AS a, '' AS b, 0 AS c, 0 AS d, {text} AS line "
        f"FROM levels WHERE {condition}"
        for i, (condition, text) in enumerate(lines)
    )


def _always(*texts: str) -> list[tuple[str, str]]:
    return [("true", t) for t in texts]


_HEAD_LINES = _text_lines(
    0,
    _always(
        "'# ' || badge || ' RepoAudit Security Report'",
        "''",
        "'**Repository:** `' || repository || '`  '",
        f"'**Scan Date:** {_AT}  '",
        "'**Risk Score:** **' || risk_score || '/100** — ' || badge || ' ' || risk_level || '  '",
        "''",
        "'## Executive Summary'",
        "''",
        "'RepoAudit scanned **`' || repository || '`** and identified **' || total_issues || "
        "'** issue(s) across three audit dimensions:'",
        "''",
        "'| Category | Issues |'",
        "'|---|---|'",
        "'| 📦 Dependency Audit | ' || dependency_issues || ' |'",
        "'| 🔒 Security Scan | ' || security_issues || ' |'",
        "'| 🤖 API Hallucination Check | ' || api_hallucinations || ' |'",
        "'| **Total** | **' || total_issues || '** |'",
        "''",
        "'## 📦 Dependency Audit Results'",
        "''",
    )
    + [
        ("dependency_issues > 0", "'| Package | Status | Risk | Details |'"),
        ("dependency_issues > 0", "'|---|---|---|---|'"),
        ("dependency_issues = 0", "'*No dependency issues detected.*'"),
    ],
)
_DEP_LINES = """
SELECT repo, 1, file_ord, source_file, pos, 0,
  '| `' || package || '` | ' || CASE WHEN exists THEN '✅ Found' ELSE '❌ Not found' END || ' | '
  || CASE typosquat_risk WHEN 'none' THEN '—' ELSE '⚠️ Typosquat (' || typosquat_risk || ')' END
  || ' | ' || CASE WHEN NOT exists THEN 'Package does not exist in the registry (hallucinated)'
       WHEN age_days < 30 THEN 'Suspiciously new (' || age_days || ' days old)'
       WHEN typosquat_similar_to <> '' THEN 'Looks like: '
            || regexp_replace(regexp_replace(typosquat_similar_to, ':[0-9]+', '', 'g'), ',', ', ', 'g')
       ELSE '' END || ' |'
FROM dep
"""
_SEC_HEAD_LINES = _text_lines(
    2,
    _always("''", "'## 🔒 Security Scan Results'", "''")
    + [
        (
            "security_issues > 0",
            "'**Severity Breakdown:** 🔴 Critical: ' || critical || ' · 🟠 High: ' || high || "
            "' · 🟡 Medium: ' || medium || ' · 🟢 Low: ' || low",
        ),
        ("security_issues > 0", "''"),
        ("security_issues > 0", "'| # | File | Line | Severity | Category | Description |'"),
        ("security_issues > 0", "'|---|---|---|---|---|---|'"),
        ("security_issues = 0", "'*No security vulnerabilities detected.* ✅'"),
    ],
)
_SEC_LINES = f"""
SELECT repo, 3, n, '', 0, 0, '| ' || n || ' | `' || file || '` | ' || line_number || ' | '
  || CASE severity WHEN 'critical' THEN '🔴 Critical' WHEN 'high' THEN '🟠 High'
       WHEN 'medium' THEN '🟡 Medium' END || ' | ' || category || ' | ' || description || ' |'
FROM ({_RANKED}) r0
"""
_SEVERE_HEAD_LINES = _text_lines(
    4,
    _always("''")
    + [
        ("critical + high > 0", "'### Critical & High Severity Details'"),
        ("critical + high > 0", "''"),
    ],
)
_SEVERE_LINES = f"""
SELECT repo, 5, n, '', u.at, 0,
  CASE u.at WHEN 0 THEN '**' || file || ':' || line_number || '** — ' || description
            WHEN 2 THEN code_snippet WHEN 4 THEN '' ELSE '```' END
FROM ({_RANKED}) r0, (SELECT unnest([0, 1, 2, 3, 4]) AS at) u
WHERE severity IN ('critical', 'high') AND n <= 10
"""
_API_HEAD_LINES = _text_lines(
    6,
    _always(
        "'## 🤖 API Hallucination Check'", "''", "'Files scanned: **' || files_scanned || '**'", "''"
    )
    + [
        ("api_hallucinations > 0", "'| File | Line | Module | Called Function | Suggestion |'"),
        ("api_hallucinations > 0", "'|---|---|---|---|---|'"),
        ("api_hallucinations = 0", "'*No hallucinated API calls detected.* ✅'"),
    ],
)
_API_LINES = """
SELECT repo, 7, 0, file, line_number, 0, '| `' || file || '` | ' || line_number || ' | `' || module
  || '` | `' || called_function || '` | ' || suggestion || ' |' FROM api
"""
_REC_HEAD_LINES = _text_lines(8, _always("''", "'## 📋 Recommendations'", "''"))
_REC_LINES = "SELECT repo, 9, rec_no, '', part, 0, rec_no || '. ' || text FROM recs"
_FOOT_LINES = _text_lines(
    10, _always("''", "'---'", f"'*Report generated by RepoAudit v0.1.0 at {_AT}*'")
)
_MARKDOWN = f"""
WITH {_SUMMARY}, {_recommended(1000)}, lines AS (
{_HEAD_LINES} UNION ALL {_DEP_LINES} UNION ALL {_SEC_HEAD_LINES} UNION ALL {_SEC_LINES}
UNION ALL {_SEVERE_HEAD_LINES} UNION ALL {_SEVERE_LINES} UNION ALL {_API_HEAD_LINES}
UNION ALL {_API_LINES} UNION ALL {_REC_HEAD_LINES} UNION ALL {_REC_LINES} UNION ALL {_FOOT_LINES})
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY s, a, b, c, d) AS line_number, line
FROM lines
"""
_JSON_FIELDS = f"""
WITH {_SUMMARY}, {_recommended(1000)}, man_n AS (SELECT repo, count(*) AS manifests FROM man GROUP BY repo)
SELECT l.repo, repository, '2024-02-20T00:00:00+00:00' AS timestamp,
       CAST(risk_score AS VARCHAR) AS risk_score, risk_level,
       CAST(total_issues AS VARCHAR) AS total_issues, dependency_issues AS dependency_findings,
       coalesce(manifests, 0) AS manifests, non_existent AS hallucinated,
       (SELECT arg_min(package, (file_ord, source_file, pos)) FROM dep WHERE dep.repo = l.repo) AS first_package,
       security_issues AS security_findings, CAST(critical AS VARCHAR) AS critical,
       (SELECT max(code_snippet) FROM ({_RANKED}) r WHERE r.repo = l.repo AND n = 1) AS first_snippet,
       api_hallucinations AS api_findings,
       (SELECT count(*) FROM recs WHERE recs.repo = l.repo) AS recommendations
FROM levels l LEFT JOIN man_n USING (repo)
"""


def _raw_rules() -> str:
    source = """
    SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, text AS content FROM documents
    UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
    UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations
    """
    lines = _numbered_lines(source, "source, key")
    return (
        f"WITH raw AS MATERIALIZED ({lines}), hits AS ({_rule_rows('raw', 'source, key')}) "
        "SELECT source, key, line_number, category, severity, code_snippet FROM hits"
    )


def _own_rules() -> str:
    lines = _numbered_lines("SELECT doc_id, text AS content FROM documents", "doc_id")
    return (
        f"WITH raw AS MATERIALIZED ({lines}), hits AS ({_rule_rows('raw', 'doc_id', fx.own_rules())}) "
        "SELECT doc_id, line_number, category, severity, code_snippet FROM hits"
    )


def all_sql() -> dict[str, str]:
    found = f"WITH {_SECURITY}"
    return {
        "security_findings": f"{found} SELECT repo, file, line_number, category, severity, "
        "code_snippet, description FROM sec",
        "security_severity_breakdown": f"""{found} SELECT repo, count(*) AS total_issues,
            count(*) FILTER (severity = 'critical') AS critical,
            count(*) FILTER (severity = 'high') AS high,
            count(*) FILTER (severity = 'medium') AS medium,
            count(*) FILTER (severity = 'low') AS low FROM sec GROUP BY repo""",
        "security_category_counts": f"{found} SELECT repo, category, severity, count(*) AS n "
        "FROM sec GROUP BY ALL",
        "security_ranked_top10": f"{found} SELECT repo, n, file, line_number, category, severity, "
        f"code_snippet FROM ({_RANKED}) r WHERE severity IN ('critical', 'high') AND n <= 10",
        "security_numbered": f"{found} SELECT repo, n, count(*) OVER (PARTITION BY repo) AS total, "
        f"file, line_number, category, severity FROM ({_RANKED}) r",
        "raw_text_rules": _raw_rules(),
        "own_rules": _own_rules(),
        "path_filter_files": f"""SELECT repo, path, extension, skipped,
            extension IN ('.py', '.js', '.ts', '.jsx', '.tsx') AND NOT skipped AS scanned,
            ends_with(path, '.py') AND NOT skipped AS python,
            string_split(string_split(path, '/')[-1], '.')[1] AS stem FROM ({_PATHS}) p""",
        "code_lines": f"SELECT repo, file, line_number, {_strip('line')} AS line FROM ({_LINES}) l",
        "manifest_files": f"WITH man AS ({_MANIFESTS}) SELECT repo, file_ord, source_file FROM man",
        "manifest_requirements": _package_query("source_file LIKE '%.txt'"),
        "manifest_setup_py": _package_query("source_file = 'setup.py'"),
        "manifest_pyproject": _package_query("source_file = 'pyproject.toml'"),
        "manifest_package_json": _package_query("source_file = 'package.json'"),
        "dependencies_dedup": f"WITH {_DEPS} SELECT repo, file_ord, pos, package, source_file, registry FROM deps",
        "registry_lookup": _looked_up("pypi", _PYPI_META),
        "registry_npm": _looked_up("npm", _NPM_META),
        "package_age_downloads": _looked_up(
            "pypi", _age_columns("pypi", "upper(asked)", "PyPI", "+00:00")
        ),
        "package_age_npm": _looked_up("npm", _age_columns("npm", "asked", "npm", "Z")),
        "typosquat_popular": f"""WITH asked AS MATERIALIZED ({fx.v6_names()}),
            known AS (SELECT * FROM (VALUES {_values(POPULAR_PACKAGES)}) v(known, ord))
            {_similar("asked", "p_partkey", "known")}""",
        "typosquat_known_table": f"""WITH {_NAMES},
            known AS (SELECT name AS known, 0 AS ord FROM names WHERE name LIKE 'old%'),
            asked AS (SELECT name AS key, name FROM names)
            SELECT * EXCLUDE (key) FROM ({_similar("asked", "key", "known")}) s""",
        "typosquat_long_names": f"""WITH asked AS MATERIALIZED ({fx.LONG_NAMES}),
            known AS MATERIALIZED (SELECT name AS known, 0 AS ord FROM ({fx.KNOWN_LONG_NAMES}) k)
            {_similar("asked", "p_partkey", "known")}""",
        "dependency_findings": f"WITH {_FINDINGS} SELECT * EXCLUDE (file_ord, pos) FROM dep",
        "dependency_findings_known_table": f"WITH {_findings(KNOWN)} SELECT * EXCLUDE (file_ord, pos) FROM dep",
        "dependency_summary": f"""WITH {_FINDINGS},
            spine AS (SELECT DISTINCT repo, true AS found FROM man
                      UNION ALL SELECT DISTINCT source, source <> 'src0' FROM documents),
            m AS (SELECT repo, count(*) AS n FROM man GROUP BY repo),
            c AS (SELECT repo, count(*) AS total, count(*) FILTER (NOT exists) AS missing,
                         count(*) FILTER (typosquat_similar_to <> '') AS typos,
                         count(*) FILTER (age_days < 30) AS young FROM dep GROUP BY repo)
            SELECT repo, coalesce(m.n, 0) AS manifest_count, coalesce(total, 0) AS total_packages,
                   coalesce(missing, 0) AS hallucinated_packages,
                   coalesce(typos, 0) AS typosquat_warnings,
                   coalesce(young, 0) AS new_package_warnings,
                   CASE WHEN found AND m.n IS NULL
                        THEN 'No dependency files found in the repository.' END AS message,
                   CASE WHEN NOT found THEN 'Repository path does not exist: /data/' || repo END AS error
            FROM spine LEFT JOIN m USING (repo) LEFT JOIN c USING (repo)""",
        "dependency_warnings": f"""WITH {_WARNED}
            SELECT repo, kind, (n - 1) // 20 AS part, CAST(ceil(max(total) / 20) AS BIGINT) AS parts,
                   max(total) AS total, string_agg(package, ',' ORDER BY n) AS items
            FROM warned GROUP BY repo, kind, (n - 1) // 20""",
        "api_imports": f"SELECT repo, file, alias, module FROM ({_V4}) f JOIN {_IMPORTS} USING (template)",
        "api_calls": f"SELECT repo, file, line_number, alias, module, called_function "
        f"FROM ({_V4}) f JOIN {_CALLS} USING (template)",
        "api_findings": f"WITH {_API} SELECT * FROM api",
        "api_summary": f"""WITH {_API} SELECT repo, count(api.repo) AS total_hallucinated_calls,
            max(files_scanned) AS total_files_scanned FROM scanned LEFT JOIN api USING (repo)
            GROUP BY repo""",
        "risk_score": f"""WITH {_SUMMARY} SELECT repo, root, repository, risk_score, risk_level,
            badge, total_issues, dependency_issues, non_existent, typosquats, security_issues,
            critical, high, medium, low, api_hallucinations, files_scanned FROM levels""",
        "recommendations": f"WITH {_SUMMARY}, {_recommended(20)} SELECT repo, rec_no, part, text FROM recs",
        "markdown_report": _MARKDOWN,
        "json_report_fields": _JSON_FIELDS,
        "audit_reports": f"""SELECT f.*, markdown_lines, markdown_chars, markdown_places
            FROM ({_JSON_FIELDS}) f JOIN (
                SELECT repo, count(*) AS markdown_lines, sum(length(line))::BIGINT AS markdown_chars,
                    sum(length(line) * line_number)::BIGINT AS markdown_places
                FROM ({_MARKDOWN}) GROUP BY repo
            ) m USING (repo)""",
    }
