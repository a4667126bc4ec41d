"""Operators against brute force on small tables, with nulls, empty and repeated rows."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repoaudit.llm import backoff, html_text, jaccard, mixing, packing, quality, toolcalls, toxicity, vectors, wordbpe
from repoaudit.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def least_reachable(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def random_texts(seed, n=60):
    """Texts with near copies at all distances, short ones, copies, null and empty."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    common = [str(x) for x in rng.choice(vocabulary, 12)]
    texts = [None, "", "  \n", "one", "ONE", "a b c d", "a b c d e", "x a b c d e", "a b  c\td e f"]
    while len(texts) < n:
        if texts[-1] and rng.random() < 0.6:
            base = words(texts[int(rng.integers(4, len(texts)))])
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(0, len(base)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(base))
        else:
            own = [str(x) for x in rng.choice(vocabulary, int(rng.integers(3, 70)))]
            texts.append(" ".join(common + own if rng.random() < 0.5 else own))
    return texts


class TestJaccard:
    @staticmethod
    def brute(rows):
        sets = {}
        for key, text in rows:
            w = words((text or "").lower())
            sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        edges = []
        keys = list(sets)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    edges.append((a, b))
        return {k: (len(s), c) for (k, s), c in zip(sets.items(), least_reachable(sets, edges).values())}

    @pytest.mark.parametrize("frequent,boundary", [(20, None), (2, 0), (2, 10_000)])
    def test_components_equal_brute_force(self, spark, monkeypatch, frequent, boundary):
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        if boundary is not None:  # all sets heavy, or all light
            monkeypatch.setattr(jaccard, "_boundary", lambda sets: boundary)
        rows = list(enumerate(random_texts(3)))
        df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, mark string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_digest(df).collect()}
        assert got == self.brute(rows)

    def test_null_and_repeated_keys(self, spark):
        """A third of the keys null, a third repeated: every row is linked by its own text."""
        texts = random_texts(6)
        keys = [None if i % 3 == 0 else 1000 if i % 3 == 1 else i for i in range(len(texts))]
        df = spark.createDataFrame([(k, t) for k, t in zip(keys, texts)], "doc_id long, text string")
        want = Counter()
        components_of = self.brute(list(enumerate(texts)))
        for i, (n, component) in components_of.items():
            own = [keys[j] for j, (_, c) in components_of.items() if c == component and keys[j] is not None]
            want[keys[i], n, min(own, default=None)] += 1
        assert Counter(tuple(r) for r in jaccard.jaccard_digest(df).select("doc_id", "n_shingles", "component_id").collect()) == want
        a = " ".join(f"w{i}" for i in range(100))
        pair = spark.createDataFrame([(None, a), (5, a + " x")], "doc_id long, text string")
        assert {r.component_id for r in jaccard.jaccard_digest(pair).collect()} == {5}

    def test_empty_table(self, spark):
        assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0

    def test_outlines_allow_every_link_and_few_others(self, spark):
        rng = np.random.default_rng(4)
        base = rng.integers(0, 1 << 58, 200)
        sets = {}
        for k in range(40):  # from equal to a third in common
            changed = base.copy()
            changed[: 4 * k] = rng.integers(0, 1 << 58, 4 * k)
            sets[k] = set(changed.tolist())
        rows = [(k, h) for k, found in sets.items() for h in found]
        bits = spark.createDataFrame(rows, "mark long, h long").groupBy("mark").agg(*jaccard._parities("h"), F.count("*").alias("n"))
        outlines = bits.withColumn("alone", F.lit(0).cast("bigint"))
        pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
        near = {(r.a, r.b) for r in jaccard._near(pairs, outlines).collect()}
        links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        assert links and links <= near
        assert len(near) < 3 * len(links)


    @pytest.mark.parametrize("boundary,most", [(0, 1), (120, 2), (10_000, 1)])
    def test_near_copies_meet_in_one_list_of_a_kind(self, spark, boundary, most):
        """Near copies share hundreds of lists; the last round makes a row of a pair once for lists of one
        hash and once for lists of two, and loses no pair that links."""
        rng = np.random.default_rng(5)
        base = rng.integers(0, 1 << 58, 120)
        found = {}
        for mark in range(12):
            own = base.copy()
            changed = rng.choice(120, 6, replace=False)
            own[changed] = rng.integers(0, 1 << 58, 6)
            found[mark] = sorted(set(own.tolist()))
        times = Counter(h for s in found.values() for h in s)
        commons = {m: [h for h in s if times[h] > 1] for m, s in found.items()}
        rows = [(m, len(s), len(s) - len(commons[m]), commons[m]) for m, s in found.items()]
        sets = spark.createDataFrame(rows, "mark long, n long, alone long, common array<long>")
        bits = sets.select("mark", F.explode("common").alias("h")).groupBy("mark").agg(*jaccard._parities("h"))
        lists = jaccard._lists(sets, boundary).withColumn("label", F.col("mark"))
        got = Counter(tuple(r) for r in jaccard._rest(lists, sets.join(bits, "mark")).collect())
        pairs = {(a, b) for a in found for b in found if a < b}
        links = {(a, b) for a, b in pairs if 100 * len({*found[a]} & {*found[b]}) >= 80 * len({*found[a]} | {*found[b]})}
        assert len(links) > 20 and links <= set(got) <= pairs
        assert max(got.values()) <= most

    @pytest.mark.parametrize("several", [True, False])
    def test_left_over_sets_take_the_cheaper_lists(self, spark, monkeypatch, several):
        """Near copies of which some lie in other components leave all their lists of pairs open: the last
        round compares them in those of single hashes, one row for each. One open list of a pair is kept."""
        rng = np.random.default_rng(6)
        base = rng.integers(0, 1 << 58, 120)
        found = {}
        for mark in range(12):
            own = base.copy()
            changed = rng.choice(120, 6, replace=False)
            own[changed] = rng.integers(0, 1 << 58, 6)
            found[mark] = sorted(set(own.tolist()))
        times = Counter(h for s in found.values() for h in s)
        commons = {m: [h for h in s if times[h] > 1] for m, s in found.items()}
        rows = [(m, len(s), len(s) - len(commons[m]), commons[m]) for m, s in found.items()]
        sets = spark.createDataFrame(rows, "mark long, n long, alone long, common array<long>")
        bits = sets.select("mark", F.explode("common").alias("h")).groupBy("mark").agg(*jaccard._parities("h"))
        sets = sets.join(bits, "mark")
        lists = jaccard._lists(sets, 10_000).withColumn("label", F.when(F.col("mark") < 8, F.lit(0)).otherwise(F.col("mark")))
        if not several:
            lists = lists.where(F.col("list") == lists.agg(F.min("list")).first()[0])
        compared, seen = jaccard._compared, []
        monkeypatch.setattr(jaccard, "_compared", lambda df: seen.append(df.count()) or compared(df))
        got = Counter(tuple(r) for r in jaccard._left_over(lists, sets).collect())
        first = sum(max(0, n - -(-80 * n // 100) + 1 - alone) for _, n, alone, _ in rows)
        assert 0 < seen[0] <= first and (seen[0] == lists.count()) != several
        pairs = {(a, b) for a in found for b in found if a < b and b >= 8}
        links = {(a, b) for a, b in pairs if 100 * len({*found[a]} & {*found[b]}) >= 80 * len({*found[a]} | {*found[b]})}
        assert set(got) <= pairs and max(got.values(), default=1) == 1
        if several:
            assert len(links) > 20 and links <= set(got) and 3 * seen[0] < lists.count()

    def test_rows_of_lists_cost_more_than_scans(self, spark):
        """Sets enumerate the pairs of their hashes only where lists of single ones are long."""

        def sets(rarity):
            packed = [(rarity << (64 - jaccard.RARITY)) + k for k in range(100)]
            return spark.createDataFrame([(m, 200, 0, packed) for m in range(5)], "mark long, n long, alone long, common array<long>")

        assert jaccard._boundary(sets(6)) == 0
        assert jaccard._boundary(sets(14)) == 200


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    from repoaudit.llm import graph

    monkeypatch.setattr(graph, "ROUNDS", 1, raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 64)], "a long, b long")
    assert {r.label for r in components(edges).collect()} == {0}


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == least_reachable({n for e in edges for n in e}, edges)
    assert components(df.limit(0)).count() == 0


class TestVectors:
    @staticmethod
    def rows(seed=5, n=160, size=16):
        rng = np.random.default_rng(seed)
        base = rng.normal(size=(n, size))
        for i in range(1, n):
            if rng.random() < 0.6:
                base[i] = base[int(rng.integers(0, i))] * rng.uniform(0.5, 2) + rng.normal(size=size) * 0.12
        odd = [None, [], [0.0] * size, [None] + [1.0] * (size - 1), [float("nan")] * size, [float("inf")] * size]
        odd += [[1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 3.0]]
        plain = base.astype(np.float32).astype(float).tolist()
        return list(enumerate(plain + odd + plain[:5]))

    @pytest.mark.parametrize("block,one_level", [(2048, 256), (7, 2)])
    def test_links_equal_brute_force(self, spark, monkeypatch, block, one_level):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "ONE_LEVEL", one_level)  # 2: centres in two levels
        monkeypatch.setattr(vectors, "AT_ONCE", 50)
        rows = self.rows()
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        usable = {k: np.array(v, float) for k, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
        edges = [
            (a, b)
            for a in usable
            for b in usable
            if a < b
            and len(usable[a]) == len(usable[b])
            and usable[a] @ usable[b] / math.sqrt((usable[a] @ usable[a]) * (usable[b] @ usable[b])) >= 0.95
        ]
        label = least_reachable([k for k, _ in rows], edges)
        degree = Counter(x for e in edges for x in e)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.vectors_digest(df).collect()}
        assert got == {k: (degree[k], label[k], label[k] == k) for k, _ in rows}

    def test_null_and_repeated_keys(self, spark):
        rows = [(None, [1.0, 0.0]), (None, [1.0, 0.001]), (7, [1.0, 0.002]), (7, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, None)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = Counter(tuple(r) for r in vectors.vectors_digest(df).collect())
        assert got == Counter(
            {(None, 2, 7, False): 2, (7, 2, 7, True): 1, (7, 0, 7, True): 1, (None, 0, None, True): 2}
        )

    def test_probes_reach_every_neighbour(self):
        rng = np.random.default_rng(9)
        x = vectors._normal(rng.normal(size=(400, 6)) + 2 * rng.integers(0, 2, size=(400, 1)))
        index = vectors.Index(x, 10_000)
        assert len(index.centres) > len(vectors.Index(x[:100], 100).centres)
        near, _, _ = index.encode(x)
        probes = index.probes(x, near)
        a, b = np.nonzero(x @ x.T >= vectors.MIN_COSINE)
        assert probes[a, near[b]].all() and probes.mean() < 0.9

    def test_a_vector_leaves_its_batch_once(self):
        """However many lists it searches; distances to reconstructions bound the real ones."""
        x = vectors._normal(np.random.default_rng(2).normal(size=(300, 16)))
        index = vectors.Index(x, 10_000)
        near, codes, error = index.encode(x)
        frame = pd.DataFrame({"code": np.arange(300), "x": list(x), "cell": near})
        found = pd.concat(vectors._probed([frame], index))
        assert found["code"].tolist() == list(range(300))
        assert [set(c) for c in found["cells"]] == [set(np.flatnonzero(p)) for p in index.probes(x, near)]
        of = near == near[0]
        real = np.sqrt(((x[:, None] - x[of][None]) ** 2).sum(axis=2))
        assert (index.lower_bounds(x, near[0], codes[of], error[of]) <= real + 1e-9).all()

    def test_lists_share_shelves(self):
        """A vector goes once to a shelf, however many of its lists that holds, and of two that link the
        one on the earlier shelf meets the other."""
        x = vectors._normal(np.random.default_rng(3).normal(size=(600, 8)).repeat(2, axis=0))
        x[::2] = vectors._normal(x[::2] + 0.01)
        index = vectors.Index(x, 10_000)
        near, codes, error = index.encode(x)
        sizes = [(int(c), int(n)) for c, n in zip(*np.unique(near, return_counts=True))]
        shelves = vectors._shelved(sizes, 30)
        assert max(n for _, n in sizes) > 30 and len({s for _, s, _ in shelves}) < len(sizes)
        held = Counter()
        for (_, size), (_, shelf, parts) in zip(sizes, shelves):
            held.update({shelf + k: size / parts for k in range(parts)})
        assert sorted(held) == list(range(len(held))) and max(held.values()) <= 30
        place = {c: (s, p) for c, s, p in shelves}
        shelf = np.array([place[c][0] + i % place[c][1] for i, c in enumerate(near)])
        frame = pd.DataFrame({"code": np.arange(1200), "copies": 1, "x": list(x), "cell": near, "shelf": shelf})
        found = pd.concat(vectors._sent([frame], index, shelves))
        assert found["code"].tolist() == list(range(1200))
        assert all(len(set(to)) == len(to) <= len(held) for to in found["to"])
        a, b = np.nonzero(x @ x.T >= vectors.MIN_COSINE)
        goes = [set(to) for to in found["to"]]
        assert all(shelf[j] in goes[i] for i, j in zip(a, b) if shelf[i] <= shelf[j])
        pairs = {(i, j) for at, to in index.candidates(x, near, codes, error) for i, j in zip(at, to)}
        assert set(zip(a, b)) <= pairs and set(zip(*np.nonzero(index.lower_bounds(x, near, codes, error) <= vectors.REACH))) <= pairs

    def test_pairs_of_shelves_are_not_shuffled(self, spark, monkeypatch):
        """Shelves are stored once and met by tasks: no exchange between them and their pairs, and
        what leaves a shelf does not grow with the number of shelves."""
        monkeypatch.setattr(vectors, "BLOCK", 20)
        rng = np.random.default_rng(4)
        x = rng.normal(size=(300, 5))
        x[150:] = x[:150] + rng.normal(size=(150, 5)) * 0.02
        rows = [(i, 1, [float(v) for v in r]) for i, r in enumerate(x)]
        heads = spark.createDataFrame(rows, "code long, copies long, x array<double>")
        plans = []
        real = vectors.freeze

        def kept(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df)

        monkeypatch.setattr(vectors, "freeze", kept)
        found = vectors._search(heads).collect()
        assert "CartesianProduct" in plans[-1] and "Exchange" not in plans[-1]
        unit = vectors._normal(x)
        links = (unit @ unit.T >= vectors.MIN_COSINE).sum(axis=1) - 1
        got = Counter()
        for r in found:
            got[r.code] += r.n or 0
        assert {k: v for k, v in got.items() if v} == {i: int(n) for i, n in enumerate(links) if n}

    def test_only_unusable_or_no_vectors(self, spark):
        df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
        assert sorted(tuple(r) for r in vectors.vectors_digest(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
        assert vectors.vectors_digest(df.limit(0)).count() == 0


class TestQuality:
    def test_counts_equal_brute_force(self, spark):
        texts = random_texts(9, 40) + ["a b c a b c a", "l1\nl1\n\n \nl1 \nl2", "## $% é𝄞 <b>", "a a a a"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for row in quality.quality_digest(df).collect():
            text = texts[row.doc_id] or ""
            w = words(text)
            windows = Counter(zip(w, w[1:], w[2:]))
            covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
            lines = [x for x in text.split("\n") if words(x)]
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
            assert tuple(row)[1:6] == want, text
            assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
            assert not (row.base_failed and row.kept)

    def test_fit_finds_faulty_texts_without_labels(self):
        rng = np.random.default_rng(0)
        good = rng.random(4000) < 0.85
        votes = np.zeros((4000, 5), int)
        for k, (on_bad, on_good) in enumerate([(0.7, 0.02), (0.6, 0.05), (0.3, 0.05)]):
            votes[:, k] = -(rng.random(4000) < np.where(good, on_good, on_bad)).astype(int)
        for k in (3, 4):
            votes[:, k] = rng.random(4000) < np.where(good, 0.9, 0.4)
        patterns, which, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        p = quality.fit(patterns, times.astype(float))[which.ravel()]
        # Knowing all chances gives 0.963; the bounds on what a vote may count cost some.
        assert ((p >= 0.5) == good).mean() > 0.9 and (p[good] >= 0.5).mean() > 0.99
        assert len(quality.fit(np.zeros((0, 3)), np.zeros(0))) == 0


class TestMixing:
    def test_sources_meet_their_targets(self, spark):
        rng = np.random.default_rng(1)
        rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", "c", None][int(rng.integers(0, 4)) if i % 3 else 0]) for i in range(900)]
        rows += [(1000, None, "a"), (1001, "", "z"), (1002, "one two", "y"), (5, "again", "b")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        once, twice = (sorted(map(tuple, mixing.mix(df).collect()), key=str) for _ in range(2))
        assert once == twice and len(once) == len(rows)
        size = Counter()
        for _, text, source in rows:
            size[source] += len(words(text))
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: 1 + i % 3 for i, s in enumerate(order)}
        target, open_ones = {}, set(order)
        while True:
            rest = sum(size.values()) - sum(target.values())
            share = {s: rest * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
            over = {s for s in open_ones if share[s] > 3 * size[s]}
            if not over:
                break
            target |= {s: 3 * size[s] for s in over}
            open_ones -= over
        target |= share
        taken = Counter()
        for _, source, n, source_size, goal, copies in once:
            assert source_size == size[source] and 0 <= copies <= 3
            assert goal == pytest.approx(target[source])
            taken[source] += n * copies
        for source in order:
            assert taken[source] == pytest.approx(target[source], abs=3)

    def test_empty_table(self, spark):
        df = spark.createDataFrame([], "doc_id long, text string, source string")
        assert mixing.mix(df).count() == 0


    @pytest.mark.parametrize("several", [1, None])
    def test_rows_of_one_key_are_rounded_one_by_one(self, spark, several):
        rows = [(several, "w " * 10, "a") for _ in range(300)] + [(i, "w " * 10, "a") for i in range(2, 102)]
        rows += [(i, "w " * 7, "b") for i in range(1000, 1300)] + [(2000, "w " * 9, "c")] * 50
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        once, twice = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (df, df.repartition(3)))
        assert once == twice and len(once) == len(rows)
        taken, target = Counter(), {}
        for _, source, n, _, goal, copies in once:
            taken[source] += n * copies
            target[source] = goal
        assert all(abs(taken[s] - target[s]) <= 10 for s in target), (taken, target)

    def test_a_column_tells_rows_apart(self, spark):
        rows = [(None if i % 3 else 4, "w " * (i % 5), "s", i) for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
        found = mixing.mix(df, keep="row").collect()
        assert len(found) == 60
        assert {(r.row, r.doc_id, r["size"]) for r in found} == {(i, k, i % 5) for k, _, _, i in rows}


class TestPacking:
    def test_pieces_and_places(self, spark):
        tokenizer = wordbpe.load().library
        texts = random_texts(4, 50) + ["word " * 5000, "It's <|endoftext|> é ́ \x1c x\x85y İ"]
        rows = list(enumerate(texts)) + [(1, "again")]
        df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, length int")
        got = packing.pack(df).collect()
        want = Counter()
        for key, text in rows:
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
            for piece, start in enumerate(range(0, len(ids), 2048)):
                part = np.array(ids[start : start + 2048], "<u4").tobytes()
                want[(key, piece, start, len(part) // 4, zlib.crc32(part))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(places) == -(-sum(r.length for r in got) // 2048)

    def test_exchange_between_partitions(self, spark, monkeypatch):
        monkeypatch.setattr(packing, "PART", 40)
        rng = np.random.default_rng(2)
        rows = [(i, 0, int(s), int(rng.integers(0, 2**40))) for i, s in enumerate(rng.integers(1, 2048, 700))]
        df = spark.createDataFrame(rows, "row long, piece int, length long, tie long")
        got = packing.pack_rests(df).collect()
        assert sorted(r.row for r in got) == list(range(700))
        used = Counter()
        for r in got:
            used[r.sequence_id] += rows[r.row][2]
        assert max(used.values()) <= 2048
        sizes = np.array([r[2] for r in rows])
        assert len(used) <= 1.1 * packing.lower_bound(sizes)

    def test_bounds_hold_for_best_packings(self):
        rng = np.random.default_rng(3)
        for _ in range(200):
            sizes = rng.integers(1, 21, int(rng.integers(1, 9)))
            best = min_bins(sorted(sizes.tolist(), reverse=True), 20)
            assert packing.lower_bound(sizes, 20) <= best <= len(packing.best_fit(sizes, 20)[1])

    def test_empty_table(self, spark):
        assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def min_bins(sizes, capacity, bins=()):
    if not sizes:
        return len(bins)
    first, rest = sizes[0], sizes[1:]
    options = {b: i for i, b in enumerate(bins) if b + first <= capacity}
    found = [min_bins(rest, capacity, bins[:i] + (b + first,) + bins[i + 1 :]) for b, i in options.items()]
    return min([*found, min_bins(rest, capacity, (*bins, first))])


class TestToxicity:
    def test_learns_words_and_their_misspellings(self, spark):
        rng = np.random.default_rng(0)
        plain = [f"{a}{b}" for a in ("tor", "lin", "mak", "sel", "van") for b in ("an", "ed", "ing", "or", "es")]
        rows, labels = [], []
        for i in range(500):
            text = [str(x) for x in rng.choice(plain, 40)]
            toxic = int(rng.random() < 0.3)
            if toxic:
                text[3] = text[20] = f"grumbleface{rng.integers(0, 50)}"
            rows.append((i, " ".join(text)))
            labels.append((i, toxic))
        rows += [(900, None), (901, ""), (902, "Toran grumblefaec linor sel grumbelface tored."), (900, None)]
        docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
        marks = spark.createDataFrame(labels, "doc_id long, toxic int")
        got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, marks).collect()}
        assert len(got) == 503
        for i, toxic in labels:
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        wrong = [i for i, toxic in labels if got[i].held_out and got[i].predicted != toxic]
        assert len(wrong) <= 4
        assert got[902].score > 0.5 and 0 <= got[900].score <= 1 and got[901].predicted in (0, 1)

    def test_no_labels(self, spark):
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        marks = spark.createDataFrame([], "doc_id long, toxic int")
        assert toxicity.toxicity_digest(docs, marks).first().score == 0.0
        assert toxicity.toxicity_digest(docs.limit(0), marks).count() == 0

    def test_sample_is_bounded_when_one_key_repeats(self, spark, monkeypatch):
        monkeypatch.setattr(toxicity, "MAX_TRAIN", 5)
        docs = spark.range(900).select(
            F.when(F.col("id") < 500, F.lit(3)).otherwise(F.col("id")).alias("doc_id"),
            F.when(F.col("id") < 300, F.lit("same")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        )
        marks = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
        rows = toxicity.training_rows(docs, marks.unionByName(marks), "doc_id", "text", "toxic").collect()
        assert Counter(r._label for r in rows) == {0: 5, 1: 5}
        assert len({(r._key, r._text) for r in rows}) == 10
        kept = {r.doc_id for r in docs.where(~toxicity.held_out(F.col("doc_id"))).collect()}
        assert all(r._key in kept for r in rows)


class TestRepeatedKeysInPacking:
    def test_rests_of_one_key_are_spread(self, spark, monkeypatch):
        monkeypatch.setattr(packing, "PART", 200)
        rests = spark.range(2000).select(
            F.col("id").alias("row"), F.lit(0).alias("piece"), F.lit(1000).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("tie")
        )
        parts = Counter(r.sequence_id >> 20 for r in packing.pack_rests(rests).collect())
        assert sum(parts.values()) == 2000 and max(parts.values()) <= 400

    def test_added_tokens_are_matched_on_raw_text(self):
        model = wordbpe.load()
        for word in ("<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "Plain"):
            own = model.texts(pa.array([word]))[0].tolist()
            assert own == model.library.encode(word, add_special_tokens=False).ids


class TestBackoff:
    def test_scores_equal_brute_force(self, spark):
        rows = list(enumerate(random_texts(6)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        folds = {r.doc_id: r.f for r in df.select("doc_id", backoff.fold(df.doc_id).alias("f")).collect()}
        for order in (1, 2, 3):
            counts = {0: Counter(), 1: Counter()}
            for key, text in rows:
                w = words(text)
                padded = ["<s>"] * (order - 1) + w
                for n in range(1, order + 1):
                    for i in range(order - 1, len(padded)):
                        counts[folds[key]][tuple(padded[i - n + 1 : i + 1])] += 1
                for n in range(1, order):
                    counts[folds[key]][("<s>",) * n] += bool(w)
            total = {f: sum(v for g, v in counts[f].items() if len(g) == 1 and g != ("<s>",)) for f in (0, 1)}
            got = {r.doc_id: (r.n_words, r.log_score) for r in backoff.score(df, order=order).collect()}
            for key, text in rows:
                other, padded, score = counts[1 - folds[key]], ["<s>"] * (order - 1) + words(text), 0.0
                for i in range(order - 1, len(padded)):
                    for n in range(order, 0, -1):
                        gram = tuple(padded[i - n + 1 : i + 1])
                        if n == 1:
                            score += math.log(max(other[gram], 1) / max(total[1 - folds[key]], 1))
                        elif other[gram]:
                            score += math.log(other[gram] / max(other[gram[:-1]], other[gram]))
                            break
                        if n > 1:
                            score += math.log(0.4)
                assert got[key][0] == len(words(text))
                assert got[key][1] == pytest.approx(score, abs=1e-6), (order, key)

    def test_empty_table(self, spark):
        assert backoff.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0

    def test_every_row_is_scored_by_itself(self, spark):
        """A third of the keys null, a third repeated: each row has the score of its text alone."""
        texts = random_texts(6)
        keys = [None if i % 3 == 0 else 1000 if i % 3 == 1 else i for i in range(len(texts))]
        df = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string")
        got = Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in backoff.score(df, order=1).collect())
        of = {r.t: r.f for r in df.select(F.coalesce("text", F.lit("")).alias("t"), backoff.fold(F.coalesce("text", F.lit(""))).alias("f")).collect()}
        key_fold = {r.doc_id: r.f for r in df.where("doc_id IS NOT NULL").select("doc_id", backoff.fold(F.col("doc_id")).alias("f")).collect()}
        folds = [of[t or ""] if k is None else key_fold[k] for k, t in zip(keys, texts)]
        counts = {0: Counter(), 1: Counter()}
        for f, t in zip(folds, texts):
            counts[f].update(words(t))
        total = {f: max(sum(counts[f].values()), 1) for f in (0, 1)}
        want = Counter()
        for k, f, t in zip(keys, folds, texts):
            value = sum(math.log(max(counts[1 - f][w], 1) / total[1 - f]) for w in words(t))
            want[k, len(words(t)), round(value, 6)] += 1
        assert got == want and set(folds) == {0, 1}

    @staticmethod
    def keys_of_folds(spark):
        """Ten keys of fold 0 and ten of fold 1."""
        found = spark.range(200).select("id", backoff.fold(F.col("id")).alias("f")).collect()
        return [[r.id for r in found if r.f == f][:10] for f in (0, 1)]

    def test_every_word_counts_however_rare(self, spark):
        a, b = self.keys_of_folds(spark)
        many = " ".join(f"w{i}" for i in range(70_000))
        strange = " ".join(f"x{i}" for i in range(5_000))
        df = spark.createDataFrame([(a[0], many), (b[0], many), (a[1], strange)], "doc_id long, text string")
        got = {r.doc_id: r.log_score for r in backoff.score(df, order=2).collect()}
        assert got[a[0]] == pytest.approx(0, abs=1e-6)  # each word follows the one before it, always
        assert got[a[1]] == pytest.approx(5_000 * (math.log(0.4) - math.log(70_000)), rel=1e-9)

    def test_many_batches_and_buckets(self, spark, monkeypatch):
        """Orders beyond those asked for at once, over batches and buckets that share n-grams."""
        monkeypatch.setattr(backoff, "GROUP", 100)
        rng = np.random.default_rng(8)
        rows = [(i, " ".join(rng.choice(list("abcde"), int(rng.integers(0, 12))))) for i in range(120)]
        rows += [(i + 200, t) for i, t in rows[:20]] + [(None, "a b a b"), (None, None), (7, "")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "text")
        folds = [r.f for r in spark.createDataFrame(rows, "k long, t string").coalesce(1).select(backoff._fold_of("k", "t").alias("f")).collect()]
        order, counts = 4, [Counter(), Counter()]
        for f, (_, text) in zip(folds, rows):
            w = words(text or "")
            padded = ["<s>"] * (order - 1) + w
            for n in range(1, order + 1):
                counts[f].update(tuple(padded[i - n + 1 : i + 1]) for i in range(order - 1, len(padded)))
                counts[f][("<s>",) * n] += bool(w)
        totals = [sum(v for g, v in c.items() if len(g) == 1 and g != ("<s>",)) for c in counts]
        want = Counter()
        for f, (key, text) in zip(folds, rows):
            other, score = counts[1 - f], 0.0
            padded = ["<s>"] * (order - 1) + words(text or "")
            for i in range(order - 1, len(padded)):
                grams = [tuple(padded[i - n + 1 : i + 1]) for n in range(order, 0, -1)]
                at = next((j for j, g in enumerate(grams) if other[g]), order - 1)
                least = other[grams[at][:-1]] if at < order - 1 else totals[1 - f]
                score += at * math.log(0.4) + math.log(max(other[grams[at]], 1) / max(least, other[grams[at]], 1))
            want[key, len(padded) - order + 1, round(score, 6)] += 1
        got = backoff.score(df, order=order).collect()
        assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == want

    def test_disk_holds_an_ngram_once_in_a_few_bytes(self, spark):
        """A batch sends a distinct n-gram once, packed, and gets back a number for it."""
        rng = np.random.default_rng(9)
        texts = [" ".join(map(str, rng.integers(0, 4000, 500))) for _ in range(200)]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(200)), pa.array([i % 2 for i in range(200)], pa.int32()), pa.array(texts), pa.array(range(200))],
            ["_key", "fold", "_text", "_row"],
        )
        coded = list(backoff._coded([batch]))
        assert sum(len(d.as_py()) for b in coded for d in b.column("data")) < 3 * 100_000
        asked = [r for b in backoff._asking(coded, [1, 2], 4) for r in b.to_pylist()]
        assert Counter(r["k"] for r in asked) == {1: 4, 2: 4}
        pairs = {(a, b) for t in texts for a, b in zip(["<s>", *t.split()], t.split())}
        assert sum(len(r["data"]) for r in asked if r["k"] == 2) < 8 * len(pairs)
        made = pa.RecordBatch.from_pylist(asked, backoff._rows([]).schema)
        answers = [r for b in backoff._answering([made]) for r in b.to_pylist()]
        assert sum(len(r["data"]) for r in answers if r["k"] == 2) < len(pairs)
        df = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
        plan = backoff.score(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan

    def test_production_order_sees_two_words_back(self, spark):
        a, b = self.keys_of_folds(spark)
        rows = [(a[0], "a b c"), (a[1], "x b d"), (b[0], "a b c"), (b[1], "x b c")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.log_score for r in backoff.lm_digest(df).collect()}
        # Their pairs of words are equally frequent; only "a b c" is there as a whole.
        assert got[b[0]] > got[b[1]]


class TestToolCalls:
    def test_lone_surrogates_are_no_json(self, spark):
        assert toolcalls.canonical('{"text":"\\ud800"}') is None
        assert toolcalls.canonical('{"text":"\\ud83d\\ude00"}') == '{"text":"😀"}'
        calls = spark.createDataFrame(
            [("c", 1, "x", "note", '{"text":"\\ud800"}', [])],
            "conv_id string, turn int, call_id string, tool string, arguments string, depends_on array<string>",
        )
        results = spark.createDataFrame([("c", 2, "x", "fine")], "conv_id string, turn int, call_id string, content string")
        row = toolcalls.link_calls(calls, results).collect()[0]
        assert not row.valid and row.problems == "arguments are no object" and "\\\\ud800" in row.message

    def test_links_orders_and_checks(self, spark):
        calls = [
            (1, 1, "a", "lookup", '{"limit": 2.0, "query": "é"}', None),
            (1, 3, "b", "count", '{"text": "x", "unit": 5}', ["a", "gone"]),
            (1, 5, "c", "note", '{"text": "t", "new": 1}', ["a", "b"]),
            (1, 6, "c", "note", "{}", ["a"]),
            (1, 7, "u", "what", "{}", []),
            (1, 8, "x", "note", "[1]", ["y"]),
            (1, 9, "y", "note", None, ["x"]),
            (1, 10, "z", "lookup", '{"limit": 1, "wide": true}', ["y"]),
            (2, 1, "a", "lookup", '{"query": NaN}', []),
        ]
        results = [(1, 2, "a", "ok"), (1, 4, "a", "later"), (1, 6, "c", None), (2, 9, "q", "lost"), (1, 9, None, "no id")]
        got = toolcalls.link_calls(
            spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>"),
            spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
        ).collect()
        by = {(r.conv_id, r.call_id): r for r in got}
        assert [(by[1, c].status, by[1, c].level) for c in "abcu"] == [("answered", 0), ("unanswered", 1), ("answered", 2), ("unanswered", 0)]
        assert [by[1, c].status for c in "xyz"] == ["cyclic"] * 3
        assert by[1, "a"].result_turn == 2 and by[1, "a"].repeated_results == 1 and by[1, "c"].repeated_calls == 1
        assert by[1, "a"].message == '{"arguments":{"limit":2,"query":"é"},"id":"a","name":"lookup","result":"ok","status":"answered"}'
        assert by[1, "a"].valid and by[1, "c"].valid and by[1, "b"].problems == "unit is no string"
        assert by[1, "z"].problems == "missing query; unexpected wide"
        assert by[1, "u"].problems == "unknown tool" and by[1, "x"].problems == by[2, "a"].problems == "arguments are no object"
        assert by[2, "q"].status == "orphan" and by[1, None].status == "orphan" and len(got) == 10

    def test_turns_of_a_table(self, spark):
        schema = "conv_id long, turn long, role string, text string"
        rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "user", "r"), (1, 3, "assistant", 'a "b"')]
        got = toolcalls.toolcalls_digest(spark.createDataFrame(rows + rows[1:2], schema)).collect()
        assert sorted((r.call_id, r.status, r.level, r.repeated_calls) for r in got) == [("call_1", "answered", 0, 1), ("call_3", "unanswered", 1, 0)]
        assert toolcalls.toolcalls_digest(spark.createDataFrame([], schema)).count() == 0


    def test_every_call_and_result_is_kept(self, spark):
        note = '{"text":"%s"}'
        calls = [(1, 1, "a", "note", note % "x", None)] * 3 + [(1, 5, "a", "note", note % "later", ["a"])]
        calls += [(1, 2, None, "note", note % "n1", ["a"]), (1, 2, None, "note", note % "n2", [])]
        calls += [(None, 1, "a", "note", note % "m1", ["a"]), (None, 1, "a", "note", note % "m2", [])]
        results = [(1, 2, "a", "ok"), (1, 2, "a", "ok"), (1, 4, "a", "again"), (None, 2, "a", "r1"), (None, 2, "a", "r2"), (1, 9, None, "r3")]
        got = toolcalls.link_calls(
            spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>"),
            spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
            repeated=True,
        ).collect()
        found = Counter()
        for r in got:
            message = json.loads(r.message)
            assert r.valid
            text = (message["arguments"] or {}).get("text")
            found[r.conv_id, r.call_id, r.status, r.level, text, message["result"]] += 1
        assert found == {
            (1, "a", "answered", 0, "x", "ok"): 1,
            (1, "a", "duplicate", None, "x", None): 2,
            (1, "a", "duplicate", None, "later", None): 1,
            (1, "a", "duplicate", None, None, "ok"): 1,
            (1, "a", "duplicate", None, None, "again"): 1,
            (1, None, "unanswered", 1, "n1", None): 1,
            (1, None, "unanswered", 0, "n2", None): 1,
            (None, "a", "unanswered", 0, "m1", None): 1,
            (None, "a", "unanswered", 0, "m2", None): 1,
            (None, "a", "orphan", None, None, "r1"): 1,
            (None, "a", "orphan", None, None, "r2"): 1,
            (1, None, "orphan", None, None, "r3"): 1,
        }


PAGES = {
    None: "",
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "<head><title>t</title><style>x{}</style></head><body>a<script>1</script><b hidden>n</b><i style='display:none'>m</i> b": "a b",
    "<h1>T</h1>one<br>two<br><br>three": "T\n\none\ntwo\n\nthree",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>z": "- a\n- b\n  3. c\n  4. d\n\nz",
    "<table><tr><th>n<th>long name<tr><td>12<td>x<tfoot><tr><td>s<td>t</table>after": "n   long name\n12  x\ns   t\n\nafter",
    "<table><tr><td>é<td>k<tr><td>漢字<td>v</table>": "é     k\n漢字  v",
    "<pre> a\n  b</pre>": " a\n  b",
    "<div>" * 20000 + "deep": "deep",
    "a<!-- c --><![CDATA[ x ]]>b</p>c<img alt='pic'>": "ab\n\ncpic",
    "<td>stray</td> x </b></i>": "stray\nx",
}


@pytest.mark.parametrize("page", list(PAGES), ids=range(len(PAGES)))
def test_page_text(page):
    assert html_text.page_text(page) == PAGES[page]


LOOSE_TABLES = {
    "<table><colgroup><col><tr><td>a</table>": "a",
    "<table><caption>c<tr><td>a</table>": "c\na",
    "<table><td>a<td>b</table>": "a  b",
    "<table><thead><th>h<tbody><td>a</table>": "h\na",
    "<table><form><tr><td>a<td>b</form></table>z": "a  b\n\nz",
    "<table><tr><form><td>a</form><td>b</table>": "a  b",
    "<table>x<tr>y<td>a<tr><div>d</div><td>b</table>z": "xy\nd\n\na\nb\n\nz",
    "<table><div><tr><td>a</div></table>": "a",
    "<table><p>p<tr><td>a</table>": "p\n\na",
    "<table><tr><td>a<tr><table><td>b</table>c": "a\n\nb\n\nc",
    "<table><tr><td>a<table>n<td>b</table>c</table>d": "an\nb\nc\n\nd",
    "<table><colgroup>t<tr><td>a</table>": "t\n\na",
    "<table><template><tr><td>no</template><noscript><tr><td>no</noscript><tr><td>yes</table>": "yes",
}


@pytest.mark.parametrize("page", list(LOOSE_TABLES), ids=range(len(LOOSE_TABLES)))
def test_tables_with_text_and_tags_out_of_place(page):
    assert html_text.page_text(page) == LOOSE_TABLES[page]


def test_pages_as_a_table(spark):
    rows = [(i, p, "old") for i, p in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.html_digest(df).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())}
    assert html_text.html_digest(df.limit(0)).count() == 0


def test_words_are_runs_without_ascii_space():
    from repoaudit.llm.common import Words

    texts = ["", " a\tb\x0b\x0cc\r\n", "\x1cx\x85y\xa0z", "a", "\n\n"]
    found = Words(pa.array(texts).slice(1))
    names = found.names.to_pylist()
    spans = list(zip(found.starts[:-1], found.starts[1:]))
    assert [[names[c] for c in found.codes[a:b]] for a, b in spans] == [words(t) for t in texts[1:]]
