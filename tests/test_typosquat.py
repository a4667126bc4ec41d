import random

import pytest
from pyspark.sql import functions as F

from repoaudit.functions.similarity import equal_positions
from repoaudit.operators import joins, typosquat
from repoaudit.operators.typosquat import typosquat_candidates
from repoaudit.rules import POPULAR_PACKAGES, popular_table


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _expected(name, known):
    plain = name.lower().strip()
    close = [
        (_distance(plain, k.lower()), i, k)
        for i, k in enumerate(known)
        if plain != k.lower() and _distance(plain, k.lower()) <= 2
    ]
    close.sort()
    risk = "none" if not close else "high" if close[0][0] == 1 else "medium"
    return [(k, d) for d, _, k in close], risk


def _mutated(rng, names, count):
    letters = "abcdefgorst-4é"
    for _ in range(count):
        name = list(rng.choice(names))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(name) + 1)
            what = rng.random()
            if what < 0.35 and name:
                del name[min(at, len(name) - 1)]
            elif what < 0.7:
                name.insert(at, rng.choice(letters))
            elif name:
                name[min(at, len(name) - 1)] = rng.choice(letters).upper()
        yield "".join(name)


KNOWN = {
    "popular": None,
    "short": ["a", "ab", "abc", "B", "", "x-y", "aab"],
    "family": [f"lib-{i:03d}" for i in range(120)] + ["Lib-X"],
}


@pytest.mark.parametrize("kind", KNOWN)
@pytest.mark.parametrize("as_table", [False, True])
def test_candidates_against_brute_force(spark, kind, as_table):
    rng = random.Random(5)
    names = KNOWN[kind] or list(POPULAR_PACKAGES)
    asked = sorted({*_mutated(rng, names, 300), *names, " Flask ", "", "zz"})
    known = KNOWN[kind]
    if as_table:
        known = popular_table(spark, names)
    rows = typosquat_candidates(spark.createDataFrame([(n,) for n in asked], "name string"), known)
    got = {r.name: ([tuple(s) for s in r.similar_to], r.risk_level, r.is_potential_typosquat) for r in rows.collect()}
    assert len(got) == len(asked)
    for name in asked:
        similar, risk = _expected(name, names)
        assert got[name] == (similar, risk, bool(similar)), name


def test_empty_known_list_means_popular(spark):
    names = spark.createDataFrame([("reqests",)], "name string")
    for known in ([], popular_table(spark).limit(0)):
        assert typosquat_candidates(names, known).collect()[0].risk_level == "high"


def test_a_long_list_is_joined(spark):
    known = [f"package-number-{i}" for i in range(1000)]
    names = spark.createDataFrame([("package-number-12x",)], "name string")
    row = typosquat_candidates(names, known).collect()[0]
    assert {s.name for s in row.similar_to} == {k for k, _ in _expected("package-number-12x", known)[0]}


@pytest.mark.parametrize("size", [200, 201])
def test_rows_and_columns_are_kept(spark, size):
    known = [f"package-number-{i}" for i in range(size)]
    rows = [(1, "package-number-12x"), (2, "package-number-12x"), (3, None), (4, "q" * 100_000)]
    names = spark.createDataFrame(rows, "id long, name string")
    got = typosquat_candidates(names, known)
    assert got.columns == ["id", "name", "similar_to", "is_potential_typosquat", "risk_level"]
    risks = {r.id: (len(r.similar_to), r.risk_level) for r in got.collect()}
    close = len(_expected("package-number-12x", known)[0])
    assert close > 0 and risks == {1: (close, "high"), 2: (close, "high"), 3: (0, "none"), 4: (0, "none")}


def test_popular_names_that_look_alike(spark):
    rows = typosquat_candidates(popular_table(spark)).where("is_potential_typosquat")
    assert {(r.name, r.risk_level) for r in rows.collect()} == {("uvicorn", "medium"), ("gunicorn", "medium")}


def test_equal_positions(spark):
    pairs = [("secure_get", "structures"), ("post_json", "post"), ("", "a"), ("ABC", "xbc"), ("é_a", "É_b")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", equal_positions(F.col("a"), F.col("b")).alias("n")
    )
    for r in rows.collect():
        assert r.n == sum(x == y for x, y in zip(r.a.lower(), r.b.lower()))


def test_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    monkeypatch.setattr(joins, "HOT_ROWS", 60)
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        "id",
    )
    right = spark.sql("SELECT 'hot' k, 1 v UNION ALL SELECT concat('k', id), id FROM range(30)")
    got = joins.join_hot_keys(left, right, ["k"])
    want = left.join(right, "k", "left")
    assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(
        map(str, want.select("k", "id", "v").collect())
    )


def edits(rng, name, letters, n):
    for _ in range(n):
        at = rng.randint(0, len(name))
        kind = rng.randrange(3)
        name = name[:at] + (rng.choice(letters) if kind else "") + name[at + (kind != 1) :]
    return name


@pytest.mark.parametrize("hot", [200, 2])
def test_segments_find_every_close_pair(spark, monkeypatch, hot):
    """Names of all lengths with 0 to 3 edits, with few letters so that segments recur, with common
    beginnings and ends, against brute force; also where every shared segment counts as hot."""
    monkeypatch.setattr(typosquat, "HOT_SEGMENT", hot)
    rng = random.Random(21)
    known = {"", "a", "ab", "abcdefgh", "abcdefghi"}
    for _ in range(150):
        core = "".join(rng.choice("abc") for _ in range(rng.randint(0, 24)))
        known.add(rng.choice(["", "common-prefix-", "x"]) + core + rng.choice(["", "-suffix-of-all"]))
    asked = {edits(rng, rng.choice(sorted(known)), "abcx-", rng.randint(0, 3)) for _ in range(500)} | {"Zz", " ABCDEFGHI "}
    pairs = typosquat.close_pairs(
        spark.createDataFrame([(n,) for n in asked], "name string"),
        spark.createDataFrame([(n, i) for i, n in enumerate(sorted(known))], "name string, ord int"),
    ).collect()
    got = {(r.name, r.known_name): r.distance for r in pairs}
    assert len(got) == len(pairs)
    want = {(a, k): d for a in asked for k in known if 1 <= (d := _distance(a.strip().lower(), k)) <= 2}
    assert got == want and len(want) > 300


def test_keys_do_not_grow_with_the_name(spark):
    for length in (20, 200, 2000):
        name = "".join(random.Random(length).choice("abcdefghij") for _ in range(length))
        row = spark.createDataFrame([(name, name)], "name string, plain string")
        assert typosquat._name_segments(row).count() <= 19
        assert typosquat._known_segments(row.select(F.col("name").alias("known_name"), F.lit(0).alias("ord"), F.col("plain").alias("target"))).count() == 3


@pytest.mark.parametrize("hot", [200, 2])
def test_parts_find_every_close_pair_once(spark, monkeypatch, hot):
    """Where all known names count as crowded, also where every key counts as hot."""
    monkeypatch.setattr(typosquat, "CROWD", 1)
    monkeypatch.setattr(typosquat, "HOT_SEGMENT", hot)
    rng = random.Random(8)
    known = {"abcdefghi", "aaaaaaaaa", "aaaaaaaaaa", "abababababab"}
    for _ in range(150):
        core = "".join(rng.choice("ab") for _ in range(rng.randint(9, 20)))
        known.add(rng.choice(["", "common-prefix-"]) + core + rng.choice(["", "-é-of-all"]))
    asked = {edits(rng, rng.choice(sorted(known)), "abx", rng.randint(0, 3)) for _ in range(600)} | {"AAAAAAAA", "aaaaaaa"}
    names = spark.createDataFrame([(n,) for n in asked], "name string")
    pairs = typosquat.close_pairs(
        names, spark.createDataFrame([(n, i) for i, n in enumerate(sorted(known))], "name string, ord int")
    ).collect()
    got = {(r.name, r.known_name): r.distance for r in pairs}
    want = {(a, k): d for a in asked for k in known if 1 <= (d := _distance(a.strip().lower(), k)) <= 2}
    assert len(got) == len(pairs) and got == want and len(want) > 300


def test_names_alike_but_for_a_third_make_few_pairs(spark, monkeypatch):
    """Known names that share two of three segments with very many, as long as few are close."""
    rng = random.Random(4)
    known = [f"lib-of-all-{rng.randrange(10**7):07d}-for-economy-{rng.randrange(10**7):07d}" for _ in range(1500)]
    rows = spark.createDataFrame([(n, 0, n) for n in known], "known_name string, ord int, target string")
    plain = spark.createDataFrame([(n, n) for n in known], "name string, plain string")
    assert typosquat._pairs_by_segment(plain, rows).count() < 20_000
    assert typosquat._known_parts(rows.limit(1)).count() == 115
    assert typosquat._name_parts(plain.limit(1)).count() == 15


def test_remainders_find_close_names_in_parts(monkeypatch):
    monkeypatch.setattr(typosquat, "REMAINDERS", 300)
    rng = random.Random(5)
    left = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(80)]
    right = [edits(rng, rng.choice(left), "abé", rng.randint(0, 4)) for _ in range(60)]
    found = {(int(i), int(j)) for a, b in typosquat._sharing(left, right) for i, j in zip(a, b)}
    close = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if _distance(a, b) <= 2}
    assert close <= found
    # Two letters at most are removed from each: others do not meet.
    assert all(_distance(left[i], right[j]) <= 4 for i, j in found)


def test_remainders_of_hot_keys_are_no_rows(spark, monkeypatch):
    """Known names that differ in a third of their letters only, in shares: every close pair once,
    and no row for each remainder."""
    monkeypatch.setattr(typosquat, "CROWD", 1)
    monkeypatch.setattr(typosquat, "HOT_SEGMENT", 5)
    monkeypatch.setattr(typosquat, "DEALT_BY", 20)
    known = [f"lib-common-beginning-{i:03d}-{j:02d}" for i in range(0, 60, 3) for j in range(0, 12, 2)]
    asked = known[::3] + [k[1:] for k in known[::5]] + [k.upper() + "x" for k in known[::4]]
    plain = spark.createDataFrame([(n, n.lower()) for n in asked], "name string, plain string")
    target = spark.createDataFrame([(n, 0, n) for n in known], "known_name string, ord int, target string")
    pairs = typosquat._pairs_by_parts(plain, target)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "FlatMapCoGroupsInArrow" in plan
    got = [(r.name, r.known_name) for r in pairs.collect()]
    want = {(a, k) for a in asked for k in known if _distance(a.lower(), k) <= 2}
    assert len(got) == len(set(got)) and {p for p in got if _distance(p[0].lower(), p[1]) <= 2} == want
