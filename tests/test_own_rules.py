"""A caller's rules: literals read off patterns, and any number of rules in one plan."""

import random
import re
import time

import pytest
from hypothesis import example, given, settings, strategies as st

from repoaudit.functions import literals
from repoaudit.operators import security
from repoaudit.rules import SECURITY_RULES, SecurityRule, valid_rules

FOLDED = {ord(a): b for a, b in zip("ſKİı", "skii")}


def fold(line):
    return line.translate(FOLDED).lower()


def parts(depth):
    """Patterns of a small alphabet with every kind of syntax."""
    plain = st.sampled_from(["a", "b", "K", "s", "ab", "ba", r"\\.", ".", "[ab]", "[^a]", r"\\s", r"\\w", "[a-c]", "i", "é", r"\\b", "^", "$", "-"])
    plain = plain.map(lambda p: p.replace("\\\\", "\\"))
    if depth == 0:
        return plain
    inner = parts(depth - 1)
    return st.one_of(
        plain,
        st.lists(inner, min_size=1, max_size=4).map("".join),
        st.lists(inner, min_size=2, max_size=3).map(lambda x: "(?:" + "|".join(x) + ")"),
        inner.map(lambda p: f"({p})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "{0,1}", "+?", "*?"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
        inner.map(lambda p: f"(?={p})"),
        inner.map(lambda p: f"(?!{p})"),
        inner.map(lambda p: f"(?>{p})"),
    )


@settings(max_examples=600, deadline=None)
@given(parts(3), st.lists(st.text(alphabet="abBkKsSſKiIİıcé -.", max_size=12), min_size=1, max_size=30))
@example("(?=abc)ab", ["abc"])
@example("a?b?c?", [""])
@example("(?:ab|ba){2}", ["abba", "ABBA"])
def test_no_match_is_lost(pattern, lines):
    try:
        search = re.compile(pattern, re.I).search
    except re.error:
        return
    groups = literals.needed_literals(pattern)
    for line in lines:
        if search(line):
            assert all(any(n in fold(line) for n in group) for group in groups), (pattern, groups, line)


@pytest.mark.parametrize(
    "pattern,groups",
    [
        (r"password\s*=\s*secret", (("secret",), ("password",))),
        (r"(?:mysql|pg)://\w+", (("mysql://", "pg://"),)),
        (r"[ab]c", (("ac", "bc"),)),
        (r"\w+", ()),
        (r"x*", ()),
        (r"=+", (("=",),)),
        (r"(?i)FooBar", (("foobar",),)),
        (r"(?x) foo  # comment", (("foo",),)),
        (r"ax.b|cd", (("ax", "cd"),)),
        (r"(?:abc)+d?", (("abc",),)),
        (r"é|foo", ()),
    ],
)
def test_literals_of_patterns(pattern, groups):
    assert set(map(frozenset, literals.needed_literals(pattern))) == set(map(frozenset, groups))


def test_built_in_patterns_have_literals():
    assert all(literals.needed_literals(p) for rule in SECURITY_RULES for p in rule.patterns)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc-.$", min_size=1, max_size=4), min_size=1, max_size=30), st.text(alphabet="abc-.$", max_size=30))
def test_one_of_many_strings(strings, line):
    shortest = literals.minimal(strings)
    assert all(v in k for k, v in shortest.items())
    needles = sorted(set(shortest.values()))
    assert not any(a != b and a in b for a in needles for b in needles)
    pattern = literals.one_of(needles)
    assert bool(re.search(pattern, line)) == any(s in line for s in strings)
    assert set(re.findall(f"(?=({pattern}))", line)) == {n for n in needles if n in line}


def test_grouped_patterns_keep_their_groups():
    patterns = [r"(a)(b)\2\1", r"[(](x)\1", r"\((y)(?:z)\1", r"(?<q>c)\k<q>", r"(?<q>d)(e)\2\k<q>"]
    whole = literals.grouped(patterns)
    assert whole == (
        r"(?:(a)(b)(?:\2)(?:\1))|(?:[(](x)(?:\3))|(?:\((y)(?:z)(?:\4))|(?:(?<p3q>c)\k<p3q>)|(?:(?<p4q>d)(e)(?:\7)\k<p4q>)"
    )


def own_rules(number, seed):
    """Rules like those of a caller: literals with gaps, classes, references, some without literals."""
    rng = random.Random(seed)
    words = ["acc", "token", "load", "open", "conn", "exec", "temp", "hash", "db", "user", "le", "de", "la", "un"]
    rules = []
    for i in range(number):
        kind = rng.randrange(10)
        a, b = rng.choice(words), rng.choice(words)
        patterns = [
            rf"{a}_?{b}\s*\(",
            rf"\b{a}{i % 7}\b",
            rf"(?:{a}|{b}){i % 5}+x",
            rf"([xyz]){a}\1",
            rf"{a}.*{b}",
            rf"(?P<c>[ab])-(?P=c)",
            rf"[0-9]{{{2 + i % 3}}}-[a-f]+",
            rf"{a}$",
            rf"\S{a[0]}\d",
            rf"(?={a}){a[0]}",
        ]
        chosen = [patterns[kind], patterns[(kind + 3) % 10]] if i % 3 else [patterns[kind]]
        rules.append(SecurityRule(f"own{i}", rng.choice(["low", "high", "info"]), f"Own {i}", tuple(chosen)))
    return tuple(rules)


def random_lines(seed, number):
    rng = random.Random(seed)
    pieces = ["acc", "token", "LOAD", "open_", "conn", "Exec", "temp3", "hash", "db", "user", "le", "de ", "la", "un", "a-a", "b-a",
              "123-abc", "x", "y", "z", "(", " ( ", "_", "5", "x55x", "ſk", "İ", "\u212a"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(number)]


@pytest.mark.parametrize("few", [0, 10_000])
def test_many_rules_agree_with_python(files_of, monkeypatch, few):
    monkeypatch.setattr(security, "FEW_PATTERNS", few)
    rules = own_rules(30 if few else 150, 4)
    lines = random_lines(5, 300)
    rows = security.scan_security(files_of({"a.py": "\n".join(lines) + "\n"}), rules).collect()
    want = {
        (n, rule.category, at)
        for n, line in enumerate(lines, 1)
        for at, rule in enumerate(rules)
        if any(re.search(p, line, re.I) for p in rule.patterns)
    }
    assert len(rows) == len(want) > 100
    assert {(r.line_number, r.category, r.category_ord) for r in rows} == want


def code_sizes(findings):
    stages = findings._jdf.queryExecution().debug().codegenToSeq()
    return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]


def test_plan_of_500_rules_compiles(spark, files_of):
    """All of the scan is in whole-stage code, and no method reaches the limit of 8000 bytes beyond
    which the JVM interprets it; 50 and 500 rules give the same code."""
    files = files_of({"a.py": "token_load(1)\n"})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes, nodes = [], []
        for number in (70, 500):
            findings = security.scan_security(files, own_rules(number, 6))
            sizes.append(code_sizes(findings))
            plan = findings._jdf.queryExecution().executedPlan().toString()
            nodes.append([line.split("(")[0].strip(" +-:*") for line in plan.splitlines()])
            steps = [line for line in plan.splitlines() if any(s in line for s in ("Project", "Filter", "Generate"))]
            assert steps and all("*(" in line for line in steps)
            assert "Exchange" not in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes[0] and max(sizes[0] + sizes[1]) < 8000 and len(sizes[0]) == len(sizes[1])
    assert abs(max(sizes[0]) - max(sizes[1])) < 200


def test_own_rules_cost_about_as_much_as_the_built_in_ones(spark):
    """200 rules with literals against the 45 patterns, on the same text."""
    folder = "/root/testdata/sf0.01"
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text AS content")
    except Exception:
        pytest.skip("no test data")
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rules = tuple(
        SecurityRule(f"own{i}", "low", "Own", (rf"{''.join(rng.choices(letters, k=6))}_?\w+\s*=", rf"\b{''.join(rng.choices(letters, k=5))}\("))
        for i in range(200)
    )
    docs = docs.repartition(8).cache()
    docs.count()

    def seconds(given):
        begin = time.perf_counter()
        security.match_lines(docs, given).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    built_in = min(seconds(None) for _ in range(3))
    own = min(seconds(rules) for _ in range(3))
    docs.unpersist()
    assert own < 2 * built_in + 1.0, (own, built_in)


def test_one_of_strings_that_begin_with_others():
    strings = ["un", "und", "und.", "ung", "le", "les,", "a", "ab"]
    found = re.findall(f"(?=({literals.one_of(strings)}))", "und und. les le les, unab")
    assert found == ["und", "und.", "le", "le", "les,", "un", "ab"]


def test_patterns_are_tried_for_their_own_literals(spark):
    """A rule with a long literal is not tried on lines that only hold a short one of another rule, a
    literal within a longer one is still seen, and a line counts once per category."""
    rules = tuple(SecurityRule(f"r{a}{b}", "low", "x", (f"{a}.{{2,3}}{b}[.,]", rf"{b}\s+{a}[a-e]+$")) for a in FEW for b in FEW)
    patterns = security._rules_as_data(valid_rules(spark, rules))[3]
    assert {r["category"] for r in patterns if "und." in r["needles"]} == {f"r{a}und" for a in FEW}
    assert not any("und" in r["needles"] for r in patterns) and any("unda" in r["needles"] for r in patterns)
    texts = ["und xyund. les und, undxyund,", "les  undabc", "und les", "lesxyund.lesxyzund,", "UNDxyLES.  les undb", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    got = [(r.id, r.category) for r in security._match_many(security._folded_lines(rows), valid_rules(spark, rules)).collect()]
    want = {(i, r.category) for i, t in enumerate(texts) for r in rules if any(re.search(p, t, re.I) for p in r.patterns)}
    assert len(got) == len(want) > 3 and set(got) == want


FEW = ("und", "les", "ung", "eau")
