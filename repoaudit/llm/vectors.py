"""Near-duplicate vectors by product quantisation, with an exact check.

Vectors link when their cosine is at least ``MIN_COSINE``. On unit vectors that is a distance
of at most ``REACH``.

1. Classes. Equal vectors are one class with a count; copies cost nothing below.
2. Index. Coarse centres and, for the residuals, a codebook per subspace are fitted by k-means
   on a bounded sample (``SAMPLE`` classes). The number of centres grows with the square root of the
   number of classes, up to an eighth of the sample; where they are many, they are fitted
   in two levels. Every class is indexed: its nearest centre, one code per subspace, and how
   far its reconstruction lies from it.
3. Probes. A class searches each list that can hold a neighbour. A neighbour in the list of
   another centre lies beyond the plane halfway between the two centres, so lists whose plane
   is farther than REACH are left out, and no other.
4. Distances. One product of matrices tells which members can be within REACH of which queries: those
   whose distance to the member's reconstruction, less its error, is. It is taken in single precision,
   whose rounding is added to the reach. Only these have their cosine computed in double precision.

Both cuts are exact, so every link is found whatever the sample, which only decides the speed.

Lists next to each other are put on shelves of about ``BLOCK`` members; a longer list is dealt over
shelves of its own. A class searches each shelf that holds one of its lists, its own and later ones:
of two classes that link, each searches the other's list, so the one on the earlier shelf finds the link
for both. A shelf is one row that holds its members as bytes, stored once. Tasks read some shelves and meet
them with some others, as a join without keys, so nothing is shuffled for it: the disk holds each vector a
few times, whatever the number of shelves, and a task holds ``TOGETHER`` of them at once. Each pair of shelves
answers how many vectors each class links with, and edges that join what its links join, at most one per class
in it; links themselves are not emitted. The pairs of shelves, and with them time, grow with the square of
the table, divided by ``BLOCK``.

Vectors that are null, empty, zero, or hold a null or a component that is not finite link with
nothing. Vectors of different lengths never link. Repeated keys count as vectors of their own
but share their class. Null keys are the greatest; a component of null keys alone is null, and
``kept`` compares null-safe. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repoaudit.llm.graph import components
from repoaudit.session import freeze

MIN_COSINE = 0.95
REACH = float(np.sqrt(2 - 2 * MIN_COSINE)) + 1e-9
#: Classes that the index is fitted on, at most; centres per square root of all classes.
SAMPLE, CENTRES = 16_384, 0.7
#: Centres beyond which they are fitted in two levels; vectors whose distances are taken at once.
ONE_LEVEL, AT_ONCE = 256, 1024
#: Parts of a vector with a codebook each, codes per book, rounds of k-means.
SUBSPACES, CODES, ROUNDS = 8, 64, 12
#: Members of a shelf, about, shelves of a small table, and queries compared with a shelf at once.
BLOCK, SHELVES, QUERIES = 2048, 8, 256
#: Shelves that a task of pairs reads from each side, about.
TOGETHER = 16


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)
    parts = [np.argmin(square - 2 * x[i : i + AT_ONCE] @ centres.T, axis=1) for i in range(0, len(x), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _coarse(x: np.ndarray, k: int) -> np.ndarray:
    """About k centres: at once, or first few and then some more around each of them."""
    if k <= ONE_LEVEL:
        return _kmeans(x, k, 1)
    upper = _kmeans(x, int(np.sqrt(k)), 1)
    near = _nearest(x, upper)
    own = [x[near == i] for i in range(len(upper))]
    return np.concatenate([_kmeans(o, max(1, round(k * len(o) / len(x))), 1) for o in own if len(o)])


class Index:
    """Coarse centres and residual codebooks for unit vectors of one length.

    ``number`` is that of all vectors, of which ``x`` is a sample.
    """

    def __init__(self, x: np.ndarray, number: int | None = None):
        self.length = x.shape[1]
        wanted = CENTRES * np.sqrt(len(x) if number is None else number)
        self.centres = _coarse(x, max(1, int(min(wanted, max(len(x) / 8, CENTRES * np.sqrt(len(x)))))))
        rest = x - self.centres[_nearest(x, self.centres)]
        bounds = np.linspace(0, self.length, min(SUBSPACES, self.length) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:])]
        self.books = [_kmeans(rest[:, p], CODES, 2 + i) for i, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list of each vector, its codes, and the error of its reconstruction."""
        near = _nearest(x, self.centres)
        rest = x - self.centres[near]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        return near, codes, np.sqrt(((rest - self.decode(codes)) ** 2).sum(axis=1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for: residuals to the centre of the list."""
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, near: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """For each vector whether each list, or each of ``cells``, can hold a vector within REACH.

        With ``2xc`` taken from the squares, no array is larger than vectors x centres.
        """
        centres = self.centres if cells is None else self.centres[cells]
        home = self.centres[near]
        size, own_size = (centres**2).sum(axis=1), (home**2).sum(axis=1)
        apart = own_size[:, None] + size[None] - 2 * home @ centres.T
        square = -2 * x @ centres.T + size
        own = own_size - 2 * (x * home).sum(axis=1)
        between = np.sqrt(np.maximum(apart, 0))
        # Centres as good as equal tell nothing apart.
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (square - own[:, None]) / (2 * between)
        return np.where(between > 1e-4, plane <= REACH + 1e-6, True)

    def reconstructed(self, cell, codes: np.ndarray) -> np.ndarray:
        """What is known of members of one list, or each of its own, by their codes."""
        return self.centres[cell] + self.decode(codes)

    def lower_bounds(self, q: np.ndarray, cell, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """How near each query can be to each member, from its reconstruction."""
        back = self.reconstructed(cell, codes)
        square = (q**2).sum(axis=1)[:, None] - 2 * q @ back.T + (back**2).sum(axis=1)
        return np.sqrt(np.maximum(square, 0)) - error[None]

    def candidates(self, q: np.ndarray, cell, codes: np.ndarray, error: np.ndarray):
        """Pairs of a query and a member whose lower bound is within REACH, in strips of queries. The bound
        is solved for the product of the unit vector and the reconstruction, so that a member has one
        number to compare with; it is less by what single precision can round away."""
        back = self.reconstructed(cell, codes)
        size = (back**2).sum(axis=1)
        least = (1 + size - (REACH + 1e-6 + error) ** 2) / 2
        least -= (self.length + 8) * 2.0**-23 * (1 + np.sqrt(size)) + 1e-6
        least, back = least.astype(np.float32), back.astype(np.float32).T
        single = q.astype(np.float32)
        for i in range(0, len(q), QUERIES):
            found = np.flatnonzero(single[i : i + QUERIES] @ back >= least)
            a, b = np.divmod(found, back.shape[1])
            for j in range(0, len(a), 4 * BLOCK):
                yield a[j : j + 4 * BLOCK] + i, b[j : j + 4 * BLOCK]


def _parts(frames):
    """Frames of ``AT_ONCE`` rows at most, none of them empty."""
    for frame in frames:
        for i in range(0, len(frame), AT_ONCE):
            yield frame.iloc[i : i + AT_ONCE]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit_classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(_key, code)``: a digest of each usable vector, null for the others."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0)
    doubles = F.transform(x, lambda v: v.cast("double") + F.lit(0.0))  # minus zero is zero
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    return vectors.select(
        F.col(key).alias("_key"),
        F.when(usable, F.xxhash64(doubles, F.size(x))).alias("code"),
        F.when(usable, doubles.cast("array<float>") if single else doubles).alias("x"),
    )


def _normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _local_edges(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vector to the least it is joined with by the links ``(a, b)`` of one group, places
    in ``rows`` and ``columns``."""
    big = np.iinfo(np.int64).max
    label_r, label_c = np.full(len(rows), big), columns.copy()
    label_r[a] = rows[a]
    while True:
        new_c = label_c.copy()
        np.minimum.at(new_c, b, label_r[a])
        new_r = label_r.copy()
        np.minimum.at(new_r, a, new_c[b])
        if (new_c == label_c).all() and (new_r == label_r).all():
            break
        label_r, label_c = new_r, new_c
    of_r, of_c = (label_r != big) & (label_r != rows), label_c != columns
    return np.concatenate([rows[of_r], columns[of_c]]), np.concatenate([label_r[of_r], label_c[of_c]])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, n_links, component)`` per row."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = unit_classes(vectors, key, vector)
    plain = freeze(rows.select("_key", "code"))
    heads = freeze(
        rows.where("code IS NOT NULL")
        .groupBy("code")
        .agg(F.count("*").alias("copies"), F.min("_key").alias("head"), F.first("x").alias("x"))
    )
    edges, counts = [], []
    for length in sorted(r[0] for r in heads.select(F.size("x")).distinct().collect()):
        found = _search(heads.where(F.size("x") == length))
        edges.append(found.where("other IS NOT NULL").select(F.col("code").alias("a"), F.col("other").alias("b")))
        counts.append(found.where("n IS NOT NULL").select("code", "n"))
    if not edges:
        return plain.select(
            F.col("_key").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("_key").alias("component")
        )
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    labels = components(union(edges))
    total = union(counts).groupBy("code").agg(F.sum("n").alias("n"))
    named = labels.join(heads.select(F.col("code").alias("node"), "head"), "node")
    least = named.groupBy("label").agg(F.min("head").alias("component"))
    of_code = named.join(least, "label").select(F.col("node").alias("code"), "component")
    state = heads.select("code", "copies", "head").join(of_code, "code", "left").join(total, "code", "left")
    state = state.select(
        "code",
        F.coalesce("component", "head").alias("component"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
    )
    usable = plain.where("code IS NOT NULL").join(state, "code").select("_key", "n_links", "component")
    others = plain.where("code IS NULL").select(
        "_key", F.lit(0).cast("bigint").alias("n_links"), F.col("_key").alias("component")
    )
    return usable.unionByName(others).select(
        F.col("_key").cast(kind).alias(key), "n_links", F.col("component").alias("component")
    )


def _probed(frames, index: Index):
    """Each vector once, with the lists that it searches. Spark makes a row of each list, so a batch
    holds no copies of a vector, of which most lists need one."""
    for frame in _parts(frames):
        probes = index.probes(_normal(_matrix(frame["x"])), frame["cell"].to_numpy())
        cells = [np.flatnonzero(p).astype(np.int32) for p in probes]
        yield pd.DataFrame({"code": frame["code"].to_numpy(), "x": frame["x"].to_numpy(), "cells": cells})


def _shelved(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """``(cell, shelf, parts)`` of lists with their sizes: lists in a row share a shelf of ``most`` members
    at most, and a longer list has shelves of its own, as many as its parts."""
    shelves, shelf, used = [], 0, 0
    for cell, size in sorted(sizes):
        if used and used + size > most:
            shelf, used = shelf + 1, 0
        parts = -(-size // most)
        shelves.append((cell, shelf, parts))
        shelf, used = shelf + parts - 1, most if parts > 1 else used + size
    return shelves


def _sent(frames, index: Index, shelves: list[tuple[int, int, int]]):
    """Each vector of ``frames`` once, with the shelves it goes to: those that hold a list it searches, from its own on."""
    first = np.zeros(len(index.centres), np.int64)
    first[[c for c, _, _ in shelves]] = [s for _, s, _ in shelves]
    listed = np.zeros(len(index.centres), bool)
    listed[[c for c, _, _ in shelves]] = True
    long = [(s, p) for _, s, p in shelves if p > 1]
    number = max(s + p for _, s, p in shelves)
    for frame in _parts(frames):
        (probed,) = _probed([frame], index)
        cells = np.concatenate(probed["cells"].to_numpy())
        at = np.repeat(np.arange(len(frame)), [len(c) for c in probed["cells"]])
        goes = np.zeros((len(frame), number), bool)
        goes[at[listed[cells]], first[cells[listed[cells]]]] = True
        for s, p in long:
            goes[:, s : s + p] = goes[:, s, None]
        goes &= np.arange(number) >= frame["shelf"].to_numpy()[:, None]
        to = [np.flatnonzero(g).astype(np.int32) for g in goes]
        yield frame[["code", "copies", "x", "shelf"]].assign(to=to)


#: A shelf as a row: its number, the shelves that its members go to, and its members.
_SHELF = {"code": np.int64, "copies": np.int64, "cell": np.int32, "codes": np.uint16, "error": np.float64}
_SHELF_SCHEMA = f"shelf int, to array<int>, {', '.join(f'{c} binary' for c in _SHELF)}, x binary"


def _blocks(frames, index: Index, shelves: list[tuple[int, int, int]], single: bool):
    """The shelves of a partition whose members come shelf after shelf."""

    def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(parts)
        to = np.unique(np.concatenate([t for f in _sent([frame], index, shelves) for t in f["to"]]))
        columns = {c: np.stack(frame[c].to_numpy()).astype(kind).tobytes() for c, kind in _SHELF.items()}
        x = _matrix(frame["x"]).astype(np.float32 if single else np.float64).tobytes()
        return pd.DataFrame({"shelf": [frame["shelf"].iat[0]], "to": [to.astype(np.int32)]} | {c: [v] for c, v in columns.items()} | {"x": [x]})

    held: list[pd.DataFrame] = []
    for frame in frames:
        for shelf, part in frame.groupby("shelf", sort=False):
            if held and held[0]["shelf"].iat[0] != shelf:
                yield block(held)
                held = []
            held.append(part)
    if held:
        yield block(held)


def _unblocked(row: dict, side: str, length: int, single: bool) -> dict[str, np.ndarray]:
    """The members of a shelf, their vectors normalised."""
    found = {c: np.frombuffer(row[side + c], kind) for c, kind in _SHELF.items() if side + c in row}
    x = np.frombuffer(row[side + "x"], np.float32 if single else np.float64).reshape(-1, length)
    return found | {"x": _normal(x.astype(np.float64))}


def _met(batches, index: Index, single: bool):
    """Links and edges of each pair of shelves ``q_`` and ``m_``, of which the first is not the later one."""
    at, q = None, {}
    for batch in batches:
        for i in range(len(batch)):
            (row,) = batch.slice(i, 1).to_pylist()
            if row["q_shelf"] != at:
                at, q = row["q_shelf"], _unblocked(row, "q_", index.length, single)
            m = _unblocked(row, "m_", index.length, single)
            codes = m["codes"].reshape(len(m["code"]), -1)
            some = np.flatnonzero(index.probes(q["x"], q["cell"], np.unique(m["cell"])).any(axis=1))
            xq, cq = q["x"][some], q["code"][some]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for f, t in index.candidates(xq, m["cell"], codes, m["error"]):
                linked = ((xq[f] * m["x"][t]).sum(axis=1) >= MIN_COSINE) & (cq[f] != m["code"][t])
                a.append(f[linked])
                b.append(t[linked])
            a, b = np.concatenate(a), np.concatenate(b)
            n, back = np.zeros(len(cq), np.int64), np.zeros(len(m["code"]), np.int64)
            np.add.at(n, a, m["copies"][b])
            if row["q_shelf"] != row["m_shelf"]:  # on one shelf, a pair is found from both sides
                np.add.at(back, b, q["copies"][some][a])
            ends, others = _local_edges(a, b, cq, m["code"])
            links, of = np.concatenate([n, back]), np.concatenate([cq, m["code"]])
            linked = links > 0
            nothing = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([of[linked], ends])),
                    pa.concat_arrays([pa.array(links[linked]), nothing(len(ends))]),
                    pa.concat_arrays([nothing(int(linked.sum())), pa.array(others)]),
                ],
                ["code", "n", "other"],
            )


def _search(heads: DataFrame) -> DataFrame:
    """For classes ``(code, copies, x)`` of one length: ``(code, n)`` with the vectors of other
    classes that a class links with, in parts, and ``(code, other)``, edges that join them."""
    spark = heads.sparkSession
    sample = heads.orderBy(F.xxhash64("code"), "code").limit(SAMPLE).select("x").toPandas()
    number = heads.count()
    index = spark.sparkContext.broadcast(Index(_normal(_matrix(sample["x"])), number))
    kind = heads.schema["x"].dataType.simpleString()
    single = kind == "array<float>"

    def placed(frames):
        for frame in _parts(frames):
            yield pd.DataFrame({"cell": _nearest(_normal(_matrix(frame["x"])), index.value.centres)})

    def encoded(frames):
        for frame in _parts(frames):
            near, codes, error = index.value.encode(_normal(_matrix(frame["x"])))
            yield frame.assign(cell=near, codes=list(codes.astype(np.int32)), error=error)

    # One row per centre, of which there are no more than an eighth of the sample.
    sizes = [tuple(r) for r in heads.select("x").mapInPandas(placed, "cell int").groupBy("cell").count().collect()]
    shelves = _shelved(sizes, min(BLOCK, -(-number // SHELVES)))
    last = max(s + p for _, s, p in shelves)
    places = F.broadcast(spark.createDataFrame(shelves, "cell int, first int, parts int"))
    shelf = (F.col("first") + F.pmod(F.xxhash64("code"), F.col("parts"))).cast("int")
    # Encoded anew rather than stored: the same numbers come out, and the disk holds a vector once less.
    schema = f"code bigint, copies bigint, x {kind}, cell int, codes array<int>, error double"
    lists = heads.select("code", "copies", "x").mapInPandas(encoded, schema)
    members = lists.join(places, "cell").withColumn("shelf", shelf).drop("first", "parts")

    # Enough tasks for all cores; each has a share of the shelves from one side and from the other.
    enough = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    parts = max(-(-last // TOGETHER), min(last, enough))
    dealt = members.repartitionById(parts, F.pmod("shelf", F.lit(parts)).cast("int")).sortWithinPartitions("shelf")
    blocks = freeze(dealt.mapInPandas(lambda frames: _blocks(frames, index.value, shelves, single), _SHELF_SCHEMA))
    q = blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("shelf", "to", "code", "copies", "cell", "x")])
    m = blocks.select(*[F.col(c).alias(f"m_{c}") for c in ("shelf", *_SHELF, "x")])
    pairs = q.join(m.hint("shuffle_replicate_nl"), F.expr("q_shelf <= m_shelf AND array_contains(q_to, m_shelf)")).drop("q_to")
    return freeze(pairs.mapInArrow(lambda batches: _met(batches, index.value, single), "code bigint, n bigint, other bigint"))


def vectors_digest(vectors: DataFrame) -> DataFrame:
    """Links and component of every row of ``embeddings``."""
    found = near_duplicates(vectors)
    return found.select(
        "vec_id",
        "n_links",
        F.col("component").alias("component_id"),
        F.col("component").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
