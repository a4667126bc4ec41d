import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from repoaudit.functions import paths, text
from repoaudit.operators import security
from repoaudit.rules import (
    ONE_PASS_FORMS,
    SECURITY_RULES,
    SecurityRule,
    rules_from_table,
    security_rules_table,
)

VULNERABLE = {
    "app.py": "\n".join(
        [
            "import os, pickle",
            'OPENAI_KEY = "sk-' + "a1" * 12 + '"',
            "db_password = 'hunter22'",
            "key = 'sk-proj-abcdefghijklmnopqrstuvwx'",
            'API_KEY = "sk-proj-abc"',
            'SECRET_KEY = "not found, the word must touch the sign"',
            'cur.execute(f"SELECT 1")',
            "x = eval(request.args.get('q'))",
            "pickle.loads(b)",
            "app.run(debug=True, host='x')",
            'URL = "postgresql://u:p@h/db"',
            'STRIPE = "sk_live_tooshort"',
        ]
    ),
    "node_modules/a.js": "eval(x)",
    ".github/a.js": "eval(x)",
    "a/build/b.py": "eval(x)",
    "build.py": "eval(x)",
    "x.PY": "eval(x)",
    ".py": "eval(x)",
    "a.md": "eval(x)",
}


def test_findings_of_a_vulnerable_app(files_of):
    rows = security.scan_security(files_of(VULNERABLE)).collect()
    found = sorted((r.file, r.line_number, r.category) for r in rows)
    assert found == sorted(
        [
            ("app.py", 2, "hardcoded_api_key"),
            ("app.py", 3, "hardcoded_password"),
            ("app.py", 5, "hardcoded_api_key"),
            ("app.py", 7, "sql_injection"),
            ("app.py", 8, "dangerous_exec"),
            ("app.py", 8, "missing_input_validation"),
            ("app.py", 9, "insecure_deserialization"),
            ("app.py", 10, "debug_in_production"),
            ("app.py", 11, "hardcoded_password"),
            (".github/a.js", 1, "dangerous_exec"),
            ("build.py", 1, "dangerous_exec"),
        ]
    )


def test_order_counts_and_top(files_of):
    findings = security.scan_security(files_of(VULNERABLE))
    ordered = security.ordered_findings(findings).collect()
    assert [r.severity for r in ordered] == ["critical"] * 4 + ["high"] * 5 + ["medium"] * 2
    assert (ordered[4].file, ordered[4].line_number) == (".github/a.js", 1)
    counts = security.severity_counts(findings).collect()[0]
    assert (counts.total_issues, counts.critical, counts.high, counts.medium, counts.low) == (
        11, 4, 5, 2, 0,
    )
    top = security.top_severe(findings, limit=3).orderBy("n").collect()
    assert [(r.n, r.line_number) for r in top] == [(1, 2), (2, 3), (3, 5)]


def test_snippet_is_trimmed_and_cut(files_of):
    line = " \x1f eval(x) " + "é" * 300 + " "
    row = security.scan_security(files_of({"a.py": line})).collect()[0]
    assert row.code_snippet == line.strip()[:200] + "…"
    short = security.scan_security(files_of({"a.py": "  eval(x)\t"})).collect()[0]
    assert short.code_snippet == "eval(x)"
    hidden = security.scan_security(files_of({"a.py": "password = 'abcd'"}), redact=True)
    assert hidden.collect()[0].code_snippet == "******** = '****'"


def _expected(lines):
    """Findings by the patterns themselves, searched by Python."""
    return {
        (i, rule.category)
        for i, line in enumerate(lines, 1)
        for rule in SECURITY_RULES
        if any(re.search(p, line, re.IGNORECASE) for p in rule.patterns)
    }


TOKENS = (
    'eval exec execute cursor.execute ( ) [ { } = " \' : @ % %s + , . select INSERT update DELETE '
    ".format password passwd pwd secret token api_key apikey API_SECRET Bearer sk- AKIA ghp_ xoxb- "
    "sk_live_ rk_live_ SK AIza -----BEGIN RSA PRIVATE KEY----- mysql:// postgres:// mongodb:// "
    "subprocess.call subprocess.Popen subprocess.run shell True False os.system os.popen "
    "commands.getoutput pickle.load pickle.loads yaml.load Loader marshal.loads shelve.open "
    "jsonpickle.decode request.args.get request.form.get request.json request.data http:// "
    "localhost 127.0.0.1 verify app.run debug DEBUG hashlib.md5 hashlib.sha1 DES RC4 nodes open "
    "request user_input filename path os.path.join ſhell ſecret toKen ıf DESé DEŚ des_ DES2 "
    "    \x1f \t f\" aaaaaaaaaaaaaaaaaaaaaaaa 0123456789abcdef0123456789abcdef $ "
    "app.run( debug= =True debug=True shell= =\" ='abc execute( execute(f\" open( request "
    "mysql://a:b@ os.path.join(a, .format( ) select"
).split(" ") + [" ", "  "]


def test_rules_agree_with_python_on_random_lines(spark, files_of):
    rng = random.Random(7)
    lines = ["".join(rng.choice(TOKENS) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    rows = security.scan_security(files_of({"a.py": "\n".join(lines)})).collect()
    assert {(r.line_number, r.category) for r in rows} == _expected(lines)
    assert len({c for _, c in _expected(lines)}) == len(SECURITY_RULES)


def test_seed_lines_hit_every_pattern(spark, files_of):
    from repoaudit.fixtures import _SEED_LINES

    seeds = [r[0] for r in spark.sql(" UNION ALL ".join(f"SELECT {s}" for s in _SEED_LINES)).collect()]
    patterns = [p for rule in SECURITY_RULES for p in rule.patterns]
    for pattern, seed in zip(patterns, seeds):
        assert re.search(pattern, seed, re.I), pattern
    rows = security.scan_security(files_of({"a.py": "\n".join(seeds)})).collect()
    assert {(r.line_number, r.category) for r in rows} == _expected(seeds)


lines = st.lists(st.sampled_from(TOKENS), max_size=12).map("".join)


@settings(max_examples=3000, deadline=None, suppress_health_check=list(HealthCheck))
@given(lines)
def test_one_pass_forms_and_needles_are_exact(line):
    folded = line.translate(str.maketrans(*text._FOLDING)).lower()
    for rule in SECURITY_RULES:
        for i, pattern in enumerate(rule.patterns):
            found = bool(re.search(pattern, line, re.I))
            form = ONE_PASS_FORMS.get(pattern)
            if form:
                assert bool(re.search(form, line, re.I)) == found
            if found:
                for group in rule.needles_of(i):
                    assert any(needle in folded for needle in group)


def test_every_letter_folds_as_python_ignores_case():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for letter in "abcdefghijklmnopqrstuvwxyz":
        search = re.compile(letter, re.I)
        others = {c for c in every if search.fullmatch(c)} - {letter, letter.upper()}
        assert others == {c for c, to in zip(*text._FOLDING) if to == letter}


@pytest.mark.parametrize(
    "line",
    [
        "select " * 60_000 + "%s",
        ".format(" + ")" * 400_000,
        "insert .forma" * 40_000,
        "execute(select" * 40_000,
        "mysql://a:b" * 40_000,
        "subprocess.run(shell=" * 40_000,
        "app.run(debug" * 40_000 + ")" + "app.run( =" * 20_000,
        "os.path.join( " + " " * 400_000,
    ],
)
def test_long_lines_take_linear_time(files_of, line):
    files = files_of({"a.js": line + "@+%".replace("%", "")})
    begin = time.time()
    security.scan_security(files).count()
    assert time.time() - begin < 30


def test_lines_are_split_as_python_does(spark):
    rng = random.Random(3)
    parts = ["a", "b c", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85",
             "\u2028", "\u2029", "\x1f", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    files = spark.createDataFrame(
        [("r", f"{i}.py", t) for i, t in enumerate(texts)], "repo string, path string, content string"
    )
    got = {}
    for row in security.code_lines(files).collect():
        got.setdefault(int(row.file[:-3]), []).append((row.line_number, row.line))
    for i, t in enumerate(texts):
        # a file opened as text turns \r and \r\n into \n, which ends the same lines
        assert sorted(got.get(i, [])) == list(enumerate(t.splitlines(), 1)), repr(t)


def test_extension_and_directories(spark):
    import os

    names = [".py", "..py", "a.py", "a.b.ts", "a.", "a", ".a.jsx", "...x", "a..py", "py", ".a.", "x/.js", "x.d/y"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select(
        "path",
        paths.extension(F.col("path")).alias("ext"),
        paths.in_skipped_directory(F.col("path")).alias("skip"),
    )
    for r in rows.collect():
        assert r.ext == os.path.splitext(os.path.basename(r.path))[1], r.path
        assert not r.skip
    skipped = spark.createDataFrame(
        [("build", False), ("build/x", True), ("a/venv/b/c", True), ("Build/x", False)],
        "path string, want boolean",
    ).select(paths.in_skipped_directory(F.col("path")).alias("got"), "want")
    assert all(r.got == r.want for r in skipped.collect())


def test_bad_bytes_vanish(spark):
    files = spark.createDataFrame(
        [("r", "a.py", bytearray(b"ev\xffal(x)\r\n\xc3pass")), ("r", "b.py", None)],
        "repo string, path string, content binary",
    )
    row = security.scan_security(files).collect()
    assert [(r.file, r.code_snippet) for r in row] == [("a.py", "eval(x)")]


def test_own_rules_and_invalid_patterns(spark, files_of):
    rules = (
        SecurityRule("todo", "info", "To do", ("TODO", "(unclosed")),
        SecurityRule("broken", "high", "Never", ("[",)),
        SecurityRule("word", "low", "Word", (r"\bfoo\b",)),
    )
    with pytest.warns(UserWarning):
        findings = security.scan_security(files_of({"a.py": "todo\nfoo\nfoo1\nfoo TODO"}), rules)
    got = sorted((r.line_number, r.category) for r in findings.collect())
    assert got == [(1, "todo"), (2, "word"), (4, "todo"), (4, "word")]
    assert security.severity_counts(findings).collect()[0].other == 2
    others = security.other_severity_counts(findings).collect()
    assert [(r.severity, r.n) for r in others] == [("info", 2)]


def test_own_rule_on_empty_lines(spark, files_of):
    rules = (SecurityRule("blank", "low", "Blank", (r"^\s*$",)),)
    files = files_of({"a.py": "x=1\n", "b.py": "", "c.py": "\n", "d.py": "a\r\n\r\nb\r\n", "e.py": "a\n\n"})
    got = sorted((r.file, r.line_number) for r in security.scan_security(files, rules).collect())
    assert got == [("c.py", 1), ("d.py", 2), ("e.py", 2)]


def test_own_rules_in_python_syntax(spark, files_of):
    pattern = r"(?P<quote_mark>['\"])x(?P=quote_mark)\Z"
    rules = (SecurityRule("quoted", "low", "Quoted", (pattern,)),)
    files = files_of({"a.py": "'x'\n'x\"\n\"x\"\n'x' \n"})
    assert sorted(r.line_number for r in security.scan_security(files, rules).collect()) == [1, 3]
    with pytest.raises(ValueError):
        security.scan_security(files, (SecurityRule("if", "low", "If", (r"(a)?(?(1)b|c)",)),))


def test_rules_without_a_valid_pattern_find_nothing(spark, files_of):
    files = files_of({"a.py": "eval(x)\n"})
    with pytest.warns(UserWarning):
        assert security.scan_security(files, (SecurityRule("broken", "low", "Never", ("[",)),)).count() == 0
    assert security.scan_security(files, ()).count() == 0


def test_rule_table_round_trip(spark):
    table = security_rules_table(spark)
    assert table.count() == 10
    assert sum(len(r.patterns) for r in table.collect()) == 45
    back = rules_from_table(table)
    assert [(r.category, r.severity, r.patterns) for r in back] == [
        (r.category, r.severity, r.patterns) for r in SECURITY_RULES
    ]


def test_scan_is_one_stage(spark, files_of):
    plan = security.scan_security(files_of(VULNERABLE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_generated_code_stays_below_the_jit_limit(spark, files_of):
    """The JVM interprets methods of 8000 bytes or more, which halves the speed of the scan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        findings = security.scan_security(files_of(VULNERABLE))
        stages = findings._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000
