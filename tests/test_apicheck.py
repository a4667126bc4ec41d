import ast
import random
import time

from pyspark.sql import functions as F

from repoaudit.operators import apicheck
from repoaudit.rules import KNOWN_APIS, known_api_table

FILES = {
    "a.py": "import requests\nimport numpy as np\nrequests.secure_get(1)\nrequests.post_json()\n"
            "requests.get()\nrequests.a.b.c()\nnp.arrange(3)\nrequests.zzz.q(requests.bogus())\n",
    "b.py": "from flask import request\nrequest.args.get('a')\n",
    "c.py": "import os.path, requests.adapters\nrequests.nope()\nos.path.joinn('a')\n",
    "d.py": "def f():\n    import redis as r\nimport requests as r\nr.Redis()\n",
    "e.py": "def broken(:",
    "f.py": "x = '\\d'\n",
    "g.py": "import requests as q\nq.get\n(q).posst()\nq().x()\nq[0].y()\n",
    ".py": "import redis\nredis.\\\n   Rediss()\n",
    "venv/x.py": "import redis\nredis.nope()\n",
    "x.js": "import redis\nredis.nope()\n",
    "nul.py": "a = 1\x00",
    "bom.py": "\ufeffimport redis",
    "deep.py": "x = " + "(" * 5000 + ")" * 5000,
}


def test_findings(files_of):
    rows = apicheck.ordered_findings(apicheck.check_api_calls(files_of(FILES))).collect()
    got = [(r.file, r.line_number, r.module, r.called_function) for r in rows]
    assert got == [
        (".py", 2, "redis", "Rediss"),
        ("a.py", 3, "requests", "secure_get"),
        ("a.py", 4, "requests", "post_json"),
        ("a.py", 7, "numpy", "arrange"),
        ("a.py", 8, "requests", "zzz.q"),
        ("a.py", 8, "requests", "bogus"),
        # The import inside the function comes later in breadth-first order, so it wins
        # in d.py and its call is fine. In c.py the alias is 'requests.adapters'.
        ("g.py", 3, "requests", "posst"),
    ]
    assert all(r.exists_in_api is False for r in rows)
    texts = {r.called_function: r.suggestion for r in rows}
    assert texts["post_json"] == "'requests.post_json' does not exist. Did you mean 'requests.post'?"
    assert texts["secure_get"].endswith("Did you mean 'requests.structures'?")
    assert texts["zzz.q"] == (
        "'requests.zzz.q' does not exist in the 'requests' package. "
        "Verify the correct function name in the official documentation."
    )


def test_files_that_do_not_parse_are_not_counted(spark, files_of):
    parsed = apicheck.parse_python(files_of(FILES))
    scanned = {r.file for r in parsed.where("parsed").collect()}
    assert scanned == {"a.py", "b.py", "c.py", "d.py", "f.py", "g.py", ".py"}
    found = apicheck.check_calls(apicheck.py_calls(parsed), known_api_table(spark))
    counts = apicheck.api_counts(parsed, found).collect()[0]
    assert (counts.total_files_scanned, counts.total_hallucinated_calls) == (7, 7)


def test_named_modules_change_nothing_but_the_work(files_of):
    files = files_of(FILES)
    some = apicheck.parse_python(files, apicheck.literal_modules())
    every = apicheck.parse_python(files)
    assert some.where("parsed").count() == every.where("parsed").count()
    known = set(apicheck.literal_modules())

    def calls(parsed):
        return {tuple(r) for r in apicheck.py_calls(parsed).collect() if r.module in known}

    assert calls(some) == calls(every)


def test_suggestions_against_brute_force(spark, files_of):
    calls = ["sesion", "Sequentiall", "read_exel", "dataframe", "x", "re", "conection", "getx", "to_datetim"]
    lines = [f"import {m}" for m in KNOWN_APIS]
    lines += [f"{m}.{c}()" for m in KNOWN_APIS for c in calls]
    rows = apicheck.check_api_calls(files_of({"a.py": "\n".join(lines)})).collect()
    assert len(rows) == len(KNOWN_APIS) * len(calls)
    for r in rows:
        def score(name):
            return sum(a == b for a, b in zip(r.called_function.lower(), name.lower()))

        best = min(KNOWN_APIS[r.module], key=lambda n: (-score(n), n))
        if score(best) >= 2:
            assert r.suggestion.endswith(f"Did you mean '{r.module}.{best}'?")
        else:
            assert "Verify the correct function name" in r.suggestion


def test_known_apis_as_parameter(spark, files_of):
    files = files_of({"a.py": "import mylib\nmylib.run()\nmylib.walk()\nimport json\njson.loadz(1)\njson.loads(1)\n"})
    table = spark.createDataFrame([("mylib", "run")], "module string, name string")
    for known in (table, {"mylib": ["run"]}):
        assert [r.called_function for r in apicheck.check_api_calls(files, known).collect()] == ["walk"]
    more = table.unionByName(spark.createDataFrame([("json", "loads")], table.schema))
    rows = apicheck.check_api_calls(files, known_api_table(spark, more)).collect()
    assert sorted(r.called_function for r in rows) == ["loadz", "walk"]


def test_imports_as_rows(files_of):
    rows = apicheck.py_imports(apicheck.parse_python(files_of(FILES))).where("file = 'c.py'").collect()
    assert {(r.alias, r.module) for r in rows} == {("os.path", "os"), ("requests.adapters", "requests")}


def test_line_numbers_follow_the_parser(files_of):
    source = "import redis\n# a\x0cb\u2028c\nredis.nope()\n"
    assert ast.parse(source)
    assert apicheck.check_api_calls(files_of({"a.py": source})).collect()[0].line_number == 3


def test_modules_of_the_whole_table(files_of):
    assert len(KNOWN_APIS) == 21 and sum(map(len, KNOWN_APIS.values())) == 730
    assert all(len(set(names)) == len(names) for names in KNOWN_APIS.values())
    source = (
        "import numpy as np\nnp.arrange(3)\nnp.random.foo()\nimport torch as t\nt.tensr(1)\nt.tensor(1)\n"
        + "".join(f"import {m}\n{m}.no_such_name()\n{m}.{names[0]}()\n" for m, names in KNOWN_APIS.items())
    )
    rows = apicheck.check_api_calls(files_of({"a.py": source})).collect()
    assert {r.module for r in rows if r.called_function == "no_such_name"} == set(KNOWN_APIS)
    texts = {r.called_function: r.suggestion for r in rows}
    assert len(rows) == 21 + 2
    assert texts["arrange"].endswith("Did you mean 'numpy.array_equal'?")
    assert texts["tensr"].endswith("Did you mean 'torch.Tensor'?")


def test_many_imports_and_calls_in_one_file(files_of):
    """Work grows with imports plus calls: the parser looks aliases up, no row carries imports."""
    imports, calls = 10_000, 100_000
    lines = [f"import m{i} as a{i % 5_000}" for i in range(imports)] + [f"a{i % 6_000}.f{i % 7}()" for i in range(calls)]
    files = files_of({"big.py": "\n".join(lines), "small.py": "import redis\nredis.Rediss()"})
    begin = time.time()
    found = apicheck.py_calls(apicheck.parse_python(files))
    counts = found.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("module").alias("modules")).collect()
    assert time.time() - begin < 30
    # The second half of the imports gives each alias its last module; aliases 5000 to 5999 have none.
    resolved = sum(1 for i in range(calls) if i % 6_000 < 5_000)
    assert {(r.file, r.n, r.modules) for r in counts} == {("big.py", resolved, 5_000), ("small.py", 1, 1)}
    assert found.where("module = 'm3' OR alias = 'a5000'").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "imports" not in plan.split("MapInArrow")[0]


def random_program(rng, depth=0):
    """Lines of imports, calls, and blocks of such lines."""
    lines = []
    for _ in range(rng.randint(1, 8)):
        kind = rng.choice(["import {m} as {a}", "import {a}.x, {m}", "{a}.{m}.f()", "x = {a}.g(1, {m}.h())", "if {a}:", "def {a}():"])
        lines.append("  " * depth + kind.format(m=rng.choice("pqr"), a=rng.choice("abpq")))
        if lines[-1].endswith(":"):
            lines += random_program(rng, depth + 1) if depth < 3 else ["  " * (depth + 1) + "pass"]
    return lines


def test_aliases_against_a_plain_walk(files_of):
    """Random programs: the last import in breadth-first order decides."""
    rng = random.Random(11)
    sources = {f"f{n}.py": "\n".join(random_program(rng)) for n in range(60)}
    want = set()
    for name, source in sources.items():
        nodes = list(ast.walk(ast.parse(source)))
        last = {(x.asname or x.name): x.name.split(".")[0] for node in nodes if isinstance(node, ast.Import) for x in node.names}
        for node in nodes:
            if not isinstance(node, ast.Call):
                continue
            parts, at = [], node.func
            while isinstance(at, ast.Attribute):
                parts.append(at.attr)
                at = at.value
            if isinstance(at, ast.Name) and 1 <= len(parts) <= 2 and at.id in last:
                want.add((name, node.lineno, at.id, last[at.id], ".".join(reversed(parts))))
    rows = apicheck.py_calls(apicheck.parse_python(files_of(sources))).collect()
    assert {(r.file, r.line_number, r.alias, r.module, r.called_function) for r in rows} == want
    assert len(want) > 100
