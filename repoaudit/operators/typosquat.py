"""Names within a small edit distance of well-known names."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import text
from repoaudit.functions.similarity import close_distance
from repoaudit.rules import MAX_TYPO_DISTANCE, POPULAR_PACKAGES, popular_table
from repoaudit.schemas import SIMILAR
from repoaudit.session import freeze

# Up to this many known names are compared in place; a longer list is joined.
MAX_LITERAL_NAMES = 200

# Known names of up to this length are joined on what deletions leave, longer ones on segments.
SHORT = 8
# A known name with a segment that CROWD share is joined on all but two of its PARTS instead; what
# HOT_SEGMENT share of these is searched in memory, DEALT_BY known names and about REMAINDERS hashes at once.
CROWD = 20
HOT_SEGMENT = 200
PARTS = 6
DEALT_BY = 20_000
REMAINDERS = 1_000_000
# Hot keys that are broadcast, at most.
MOST_HOT = 1_000_000


def normalized(name: Column) -> Column:
    return text.strip(F.lower(name))


def risk_level(similar: Column) -> Column:
    """none, high if a name is one edit away, else medium."""
    return (
        F.when(F.size(similar) == 0, "none")
        .when(F.exists(similar, lambda s: s["distance"] == 1), "high")
        .otherwise("medium")
    )


def with_similar(df: DataFrame, name: str, known) -> DataFrame:
    """Add ``similar_to``: known names close to the column, nearest first, ties in list order.

    One native expression per known name: no join, no shuffle, no Python.
    """
    df = df.withColumn("_plain", normalized(F.col(name)))
    pairs = [
        F.struct(
            close_distance(F.col("_plain"), F.lit(k.lower()), MAX_TYPO_DISTANCE).alias("distance"),
            F.lit(i).alias("ord"),
            F.lit(k).alias("name"),
        )
        for i, k in enumerate(known)
    ]
    close = F.filter(F.array(*pairs), lambda s: s["distance"].isNotNull())
    return df.withColumn("similar_to", _named(F.array_sort(close), "name")).drop("_plain")


def _named(ranked: Column, field: str) -> Column:
    return F.transform(
        ranked, lambda s: F.struct(s[field].alias("name"), s["distance"].alias("distance"))
    ).cast(SIMILAR)


def _deletions(name: Column) -> Column:
    """Hashes of the name with none, one or two letters removed.

    Two names within distance 2 share such a remainder, so an equality join on it finds
    every pair.
    """

    def without(s: Column, i: Column) -> Column:
        return F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))

    def shorter(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.length(s)), lambda i: i > 0)
        return F.transform(places, lambda i: without(s, i))

    one = shorter(name)
    two = F.flatten(F.transform(one, shorter))
    every = F.array_distinct(F.concat(F.array(name), one, two))
    return F.transform(every, lambda s: F.xxhash64(s))


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """Start and length of the three segments of a name; lengths differ by one at most."""
    first, second = F.floor(length / 3), F.floor((length + 1) / 3)
    one = F.lit(1).cast("bigint")
    return [(one, first), (one + first, second), (one + first + second, F.floor((length + 2) / 3))]


def _cut(name: Column, start: Column, size: Column) -> Column:
    """A segment as a part of the key, and the name without it."""
    return F.struct(
        F.substr(name, start, size).alias("segment"),
        F.concat(F.substr(name, F.lit(1), start - 1), F.substr(name, start + size)).alias("rest"),
    )


def _known_segments(target: DataFrame) -> DataFrame:
    """A row per segment of each known name."""
    cuts = [
        F.struct(F.lit(i).alias("at"), _cut(F.col("target"), start, size).alias("cut"))
        for i, (start, size) in enumerate(_segments(F.length("target")))
    ]
    rows = target.select("*", F.explode(F.array(*cuts)).alias("_cut"))
    key = F.xxhash64(F.length("target"), "_cut.at", "_cut.cut.segment")
    return rows.select(*target.columns, key.alias("key"), F.col("_cut.cut.rest").alias("rest"))


def _name_segments(plain: DataFrame) -> DataFrame:
    """Rows for all places at which a name can hold a segment of a known name close to it.

    Two edits leave one of three segments as it is. Take the first such segment: every segment
    before it holds an edit, so it is moved by at most their number on the left, and by at most
    what is left of the two edits on the right. This leaves one place for the first and the
    last segment and at most three for the middle one, for each of the five lengths in question.
    """
    name, own = F.col("plain"), F.length("plain")
    cuts = []
    for change in range(-MAX_TYPO_DISTANCE, MAX_TYPO_DISTANCE + 1):  # own length minus that of the known name
        length = own - change
        for i, (start, size) in enumerate(_segments(length)):
            for move in range(max(-i, change - (2 - i)), min(i, change + (2 - i)) + 1):
                place = start + move
                fits = (length > SHORT) & (place >= 1) & (place + size <= own + 1)
                key = F.struct(length.alias("length"), F.lit(i).alias("at"), _cut(name, place, size).alias("cut"))
                cuts.append(F.when(fits, key))
    rows = plain.select("*", F.explode(F.array_compact(F.array(*cuts))).alias("_cut"))
    key = F.xxhash64("_cut.length", "_cut.at", "_cut.cut.segment")
    return rows.select(*plain.columns, key.alias("key"), F.col("_cut.cut.rest").alias("rest"))


def close_pairs(names: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``(name, known_name, ord, distance)`` at distance 1 or 2, for long lists.

    ``names`` has a column ``name``; ``known`` has ``name`` and ``ord``. Both sides are expanded
    to keys and joined on them, then the distance is verified. For known names of at most
    ``SHORT`` letters the keys are what is left without any two letters; few names share one. A longer
    known name has three keys, its segments, and a name has one for each place at which it can
    hold one of them: less than twenty, whatever its length.

    A segment that ``CROWD`` known names or more have at one place, such as a common prefix,
    tells little. Known names with one are cut into ``PARTS`` parts, of which two edits leave
    all but two as they are. A name has a key for each two parts left out, a known one a key for each
    way its other parts can lie: 15 and 115, whatever their lengths. Each pair counts with
    one of its keys only. Where ``HOT_SEGMENT`` known names share a key, the two parts left out, a third of the
    name, are compared in memory by what they are without any two letters: these remainders are many more
    than the names and never leave a task. The pairs of a name move once, to where its list is made.
    """
    plain = names.select("name").distinct().withColumn("plain", normalized(F.col("name")))
    target = known.select(
        F.col("name").alias("known_name"), "ord", F.lower("name").alias("target")
    )
    # A name that is longer by more is not close to any, and would have very many keys.
    longest = target.agg(F.max(F.length("target"))).first()[0] or 0
    plain = _dealt(plain.where(F.length("plain") <= longest + MAX_TYPO_DISTANCE))
    target = _dealt(target)
    pairs = _pairs_of_short(plain, target.where(F.length("target") <= SHORT))
    if longest > SHORT:
        pairs = pairs.unionByName(_pairs_by_segment(plain, target.where(F.length("target") > SHORT)))
    distance = close_distance(F.col("plain"), F.col("target"), MAX_TYPO_DISTANCE)
    return (
        pairs.select("name", "known_name", "ord", distance.alias("distance"))
        .where("distance is not null")
        .repartition("name")
        .distinct()
    )


def _dealt(names: DataFrame) -> DataFrame:
    """Give every core a share of the names: they are few bytes, but become many keys."""
    spark = names.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.repartition(parts)


def _pairs_of_short(plain: DataFrame, target: DataFrame) -> DataFrame:
    some = plain.where(F.length("plain") <= SHORT + MAX_TYPO_DISTANCE)
    left = some.select("name", "plain", F.explode(_deletions(F.col("plain"))).alias("key"))
    right = target.select("*", F.explode(_deletions(F.col("target"))).alias("key"))
    return left.join(right, "key").drop("key")


def _pairs_by_segment(plain: DataFrame, target: DataFrame) -> DataFrame:
    plain = plain.where(F.length("plain") > SHORT - MAX_TYPO_DISTANCE)
    right = _known_segments(target)
    shared = right.groupBy("key").count().where(F.col("count") >= CROWD)
    crowd = freeze(right.join(shared, "key", "left_semi").select(*target.columns).distinct())
    alone = target.join(crowd.select("target").distinct(), "target", "left_anti")
    pairs = _name_segments(plain).join(_known_segments(alone).drop("rest"), "key").drop("key", "rest")
    return pairs if crowd.isEmpty() else pairs.unionByName(_pairs_by_parts(plain, crowd))


def _left_out() -> list[dict]:
    """The pairs of parts that may hold the edits."""
    return [{"i": i, "j": j} for i in range(PARTS) for j in range(i + 1, PARTS)]


def _placements() -> list[dict]:
    """Where the other parts of a name can lie in a known one that is longer by ``change``: those
    between the two are moved by ``move``, those behind them by ``change``. Parts next to
    each other have none between them."""
    most = MAX_TYPO_DISTANCE
    found = []
    for change in range(-most, most + 1):
        one_each = [move for move in (-1, 0, 1) if abs(change - move) <= 1]
        for pair in _left_out():
            moves = [int(change / 2)] if pair["j"] == pair["i"] + 1 else one_each
            found += [{"change": change, **pair, "move": move} for move in moves]
    return found


def _exploded(df: DataFrame, rows: list[dict]) -> DataFrame:
    fields = ",".join(f"{name}:int" for name in rows[0])
    table = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return df.select("*", F.explode(table).alias("_at")).select(*df.columns, "_at.*")


def _bounds(length: Column, part: str) -> tuple[Column, Column]:
    """Where a part of a name begins and ends, counted from 0; lengths of parts differ by one at most."""
    begin = F.floor(length * F.col(part) / PARTS).cast("int")
    return begin, F.floor(length * (F.col(part) + 1) / PARTS).cast("int")


def _piece(name: Column, begin: Column, end: Column) -> Column:
    return F.substr(name, begin + 1, end - begin)


def _known_parts(target: DataFrame) -> DataFrame:
    """A row per placement in each known name: the key of all parts but two, and those as ``rest``."""
    rows = _exploded(target, _placements())
    name, change, move = F.col("target"), F.col("change"), F.col("move")
    length = F.length("target") - change
    (a, b), (c, d) = _bounds(length, "i"), _bounds(length, "j")
    same = [_piece(name, F.lit(0), a), _piece(name, b + move, c + move), _piece(name, d + change, F.length("target"))]
    rest = F.concat(_piece(name, a, b + move), _piece(name, c + move, d + change))
    return rows.select(*target.columns, F.xxhash64(length, "i", "j", *same).alias("key"), rest.alias("rest"))


def _name_parts(plain: DataFrame) -> DataFrame:
    """A row per pair of parts left out of each name, with the key of the others."""
    rows = _exploded(plain, _left_out())
    name, length = F.col("plain"), F.length("plain")
    (a, b), (c, d) = _bounds(length, "i"), _bounds(length, "j")
    same = [_piece(name, F.lit(0), a), _piece(name, b, c), _piece(name, d, length)]
    rest = F.concat(_piece(name, a, b), _piece(name, c, d))
    return rows.select(*plain.columns, "i", "j", F.xxhash64(length, "i", "j", *same).alias("key"), rest.alias("rest"))


def _found_here() -> Column:
    """Whether a pair counts with the two parts that its row leaves out, or with two others.

    Take the first part that differs where it is, and the last one that differs when moved by the
    change of length: a close pair agrees on all parts before, between and behind them. If the
    last is not behind the first, only the first holds edits, and counts with the part next to it.
    """
    name, known = F.col("plain"), F.col("target")
    length = F.length("plain")
    change = F.length("target") - length
    (a, b), (c, d) = _bounds(length, "i"), _bounds(length, "j")
    first = _piece(name, a, b) == _piece(known, a, b)
    last = (c + change >= 0) & (_piece(name, c, d) == _piece(known, c + change, d + change))
    beside = F.col("j") == F.col("i") + 1
    return F.when(first, F.col("i") == PARTS - 2).otherwise(~last | beside)


def _remainders(names: np.ndarray) -> np.ndarray:
    """Hashes of names of one length, rows of letters, with none, one or two letters removed."""
    number, length = names.shape
    step = np.uint64(0x9E3779B97F4A7C15)
    back, twice = (np.uint64(pow(int(step), -k, 1 << 64)) for k in (1, 2))  # one or two places to the left
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, step, np.uint64)]), dtype=np.uint64)
    letters = (names.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    letters = (letters ^ (letters >> np.uint64(31))) * power[:length]
    before = np.zeros((number, length + 1), np.uint64)
    np.cumsum(letters, axis=1, out=before[:, 1:], dtype=np.uint64)
    every = before[:, -1:]
    x, y = np.triu_indices(length, 1)
    one = before[:, :-1] + (every - before[:, 1:]) * back
    two = before[:, x] + (before[:, y] - before[:, x + 1]) * back + (every - before[:, y + 1]) * twice
    return np.concatenate([every, one, two], axis=1)


def _by_length(names: list[str]):
    """Places of names of each length, as many as have ``REMAINDERS`` at most, or one, with their remainders."""
    lengths = np.array([len(n) for n in names])
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        size = max(1, REMAINDERS // (1 + length + length * (length - 1) // 2))
        for i in range(0, len(places), size):
            some = places[i : i + size]
            letters = np.array([[ord(c) for c in names[p]] for p in some.tolist()], np.uint32).reshape(len(some), length)
            yield some, _remainders(letters)


def _sharing(left: list[str], right: list[str]):
    """Places of names that share a remainder, each pair at least once, in parts."""
    for of_right, there in _by_length(right):
        width = there.shape[1]
        rank = np.argsort(there, axis=None)
        there, owner = there.reshape(-1)[rank], of_right[rank // width]
        for of_left, here in _by_length(left):
            begin, end = (np.searchsorted(there, here.reshape(-1), side) for side in ("left", "right"))
            found = end - begin
            names = np.repeat(of_left, here.shape[1])
            hits = np.flatnonzero(found)
            cuts = np.flatnonzero(np.diff(np.cumsum(found[hits]) // REMAINDERS)) + 1
            for some in np.split(hits, cuts):
                n = found[some]
                at = np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs = np.unique(np.repeat(names[some], n) * len(right) + owner[at])
                yield np.divmod(pairs, len(right))


def _candidates(left: pa.Table, right: pa.Table) -> pa.Table:
    """Names of one key with known ones whose parts left out share a remainder with theirs."""
    none, several = np.zeros(0, np.int64), max(1, len(right))
    pairs = _sharing(left["rest"].to_pylist(), right["known_rest"].to_pylist()) if len(left) and len(right) else ()
    both = np.unique(np.concatenate([none, *[a * several + b for a, b in pairs]]))
    names, known = left.drop_columns(["key", "deal"]).take(both // several), right.drop_columns(["key", "deal"]).take(both % several)
    return pa.table({c: t[c] for t in (names, known) for c in t.column_names})


def _pairs_by_parts(plain: DataFrame, target: DataFrame) -> DataFrame:
    left, right = _name_parts(plain), _known_parts(_dealt(target)).withColumnRenamed("rest", "known_rest")
    hot = right.groupBy("key").agg(F.count("*").alias("hot")).where(F.col("hot") >= HOT_SEGMENT)
    # At most one key for every HOT_SEGMENT rows; the rows are told apart where they are made.
    hot = freeze(hot)
    hot = hot.hint("broadcast" if hot.count() <= MOST_HOT else "merge")

    # Few share a key: a join. Without the hint Spark may broadcast the keys of all names, since it takes them
    # to be as few bytes as the names.
    cold = left.join(hot, "key", "left_anti").join(right.join(hot, "key", "left_anti").hint("merge"), "key").drop("key")
    # Many do: a share of the known names, and all names of the key, are a group.
    parts = F.ceil(F.col("hot") / DEALT_BY).cast("int")
    known = right.join(hot, "key").withColumn("deal", F.pmod(F.xxhash64("target"), parts).cast("int")).drop("hot")
    names = left.join(hot, "key").withColumn("deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot")
    groups = ["key", "deal"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cold.schema)
    found = names.groupBy(*groups).cogroup(known.groupBy(*groups)).applyInArrow(_candidates, schema)

    # The parts left out hold all edits and are shorter than the names, so they are looked at first.
    close = F.levenshtein("rest", "known_rest", MAX_TYPO_DISTANCE) >= 0
    return cold.unionByName(found).where(close & _found_here()).drop("i", "j", "rest", "known_rest")


def typosquat_candidates(names: DataFrame, known=None) -> DataFrame:
    """Risk of each row of a table with a column ``name``.

    ``known`` is a list of names or a ``(name, ord)`` table; nothing, or an empty list,
    means the popular packages. A table, or a long list, is joined. Rows and columns of the
    table are kept either way.
    """
    if known is None or (not isinstance(known, DataFrame) and len(known) == 0):
        known = POPULAR_PACKAGES
    if not isinstance(known, DataFrame) and len(known) > MAX_LITERAL_NAMES:
        known = popular_table(names.sparkSession, known)
    if isinstance(known, DataFrame):
        if known.isEmpty():
            known = popular_table(names.sparkSession)
        # The list of a name holds what lies within distance 2 of it, a matter of its length.
        pairs = close_pairs(names, known).groupBy("name").agg(
            F.array_sort(F.collect_list(F.struct("distance", "ord", "known_name"))).alias("found")
        )
        similar = pairs.select("name", _named(F.col("found"), "known_name").alias("_similar"))
        columns = [c for c in names.columns if c != "similar_to"]
        result = names.join(similar, "name", "left").select(
            *columns, F.coalesce("_similar", F.array().cast(SIMILAR)).alias("similar_to")
        )
    else:
        result = with_similar(names, "name", known)
    return result.withColumn("is_potential_typosquat", F.size("similar_to") > 0).withColumn(
        "risk_level", risk_level(F.col("similar_to"))
    )
