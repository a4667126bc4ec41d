"""Documents whose sets of word n-grams overlap, by a size-aware heavy-light join.

Two sets link when their Jaccard similarity is at least ``THRESHOLD`` percent. The join is
exact: it loses no link, and every link is checked on the whole sets.

1. Sets. A text becomes a set of 64-bit hashes of its shingles, in Arrow batches. Equal sets
   are one class, whose least key stands for all of them, so copies cost nothing below.
2. Classes that can link. Linked sets share at least ``k`` of their first ``n - c + k`` hashes
   in the order of hashes, for any k, where c is the least overlap that a set of size n needs.
   With k a tenth of the set, only a third of the hashes is shuffled, once for each class and
   task. A class goes on if that many of them occur in another class. Hashes that many texts of a
   bounded sample have are taken as shared and spread before the shuffle, which lets more classes
   go on, never fewer. One text of each class that goes on, told by its hash, gives the whole set.
3. Order. Hashes of the classes that go on are counted, and each set ordered from rare to
   frequent. Linked sets now share one of their first ``n - c + 1`` hashes and two of their
   first ``n - c + 2``; what is frequent comes late and is seldom among these.
4. Lists. A light (small) set enumerates the pairs among its first hashes; sets that link
   share a pair. A heavy (large) set goes into the inverted list of each of its first hashes,
   and so do the light sets that are large enough to link with a heavy one. The boundary is
   the size for which the pairs of the light sets and the scans of the lists cost least,
   computed from counts by size. A pair is a row that is moved and sorted in every round, so it
   counts as ``ROW`` scanned members of a list.
5. Links. In some rounds, each set is compared with one that stands for its list, another one
   each time, and components are formed; so groups of near copies join without comparing all
   with all. A list whose sets have all come together is dropped after each round. Then all sets
   of a list that still lie in different components are compared, if their sizes and the places of
   the common hash allow a link, and only in the list of their first common hash and in that of their
   first two. Whole sets are only fetched for pairs whose outlines allow one: each
   hash turns one bit of its set's outline over, so outlines differ in no more bits than sets in hashes.
   The sets that are left go into the lists of their single first hashes for these comparisons, if
   counts show that this costs less: a light set of k first hashes is in some k * k / 2 lists of pairs.

Memory of a task: a batch of texts, or the sort buffers of a shuffle. Nothing that grows with
the table is broadcast or collected.

Texts of null, or without words, have an empty set, no links and themselves as component.
Sets of fewer than five words hold the whole sequence. Rows are linked by their sets, so rows of
one key, or of none, are rows of their own; a null key is the greatest, and the component of rows that
all have none is null. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from repoaudit.llm.common import Words, bounded, mix, plain_texts, ragged
from repoaudit.llm.graph import compact, components
from repoaudit.session import freeze

#: Words of a shingle, and the least similarity in percent.
SHINGLE, THRESHOLD = 5, 80
#: A class goes on if one in so many of its hashes, at least, is found in another class.
SHARE = 10
#: Texts of the sample that shows frequent hashes, and in how many of them one is frequent.
SAMPLE, FREQUENT = 2000, 20
#: Rounds in which each list compares its sets with one of them, before all pairs left over.
STAR_ROUNDS = 4
#: Classes that a task remembers to have sent.
REMEMBERED = 1_000_000
#: Bits of a number that say how frequent a hash is; the rest are the hash.
RARITY = 6
#: Classes that go on are broadcast to find their texts if they are no more than this.
FEW = 500_000
#: Comparisons within a list that cost as much as one more row in the lists, about.
ROW = 100
#: The columns of a set's outline: 64 bits each.
_BITS = ("b0", "b1", "b2", "b3")


def least_overlap(n):
    """The least number of common elements for a set of size n to link with any set."""
    return -(-THRESHOLD * n // 100)


def shingles(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(pc.ascii_lower(texts))
    hashed = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    # Shingles of all texts at once; those that cross from one text to the next are not used.
    last = max(len(hashed) - size + 1, 0)
    rolled = np.zeros(last, np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(31) + hashed[k : k + last])
    found = []
    for a, b in zip(words.starts[:-1], words.starts[1:]):
        if b - a >= size:
            found.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for h in hashed[a:b]:
                short = mix(short * np.uint64(31) + h)
            found.append(short)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _sets(batches, what):
    seen: set[int] = set()
    for batch in bounded(batches, 1):
        found = shingles(plain_texts(batch.column(1)))
        sizes = np.array([len(s) for s in found], np.int64)
        digest = xxhash.xxh3_64_intdigest
        marks = np.array([digest(s.tobytes()) for s in found], np.uint64).view(np.int64)
        known = sizes > 0
        if what == "classes":
            arrays = [batch.column(0), batch.column(2), pa.array(sizes), pa.array(marks, mask=~known)]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "_hash", "n", "mark"])
            continue
        if what == "prefix":
            # A class comes once from a task, as long as the task remembers it.
            fresh = [bool(k) and m not in seen and not seen.add(m) for m, k in zip(marks.tolist(), known)]
            known = np.array(fresh, bool)
            if len(seen) > REMEMBERED:
                seen.clear()
            need = least_overlap(sizes)
            length = np.minimum(sizes, sizes - need + -(-sizes // SHARE))
        else:
            length = sizes
        taken = [s[:p] for s, p in zip(found, length)]
        flat = np.concatenate(taken) if taken else np.zeros(0, np.uint64)
        lists = ragged(flat.view(np.int64), length)
        arrays = [pa.array(marks), pa.array(sizes), lists]
        yield pa.RecordBatch.from_arrays(arrays, ["mark", "n", "hashes"]).filter(pa.array(known))


def _classes(batches):
    return _sets(batches, "classes")


def _prefixes(batches):
    return _sets(batches, "prefix")


def _whole(batches):
    return _sets(batches, "whole")


_HASHES = "mark bigint, n bigint, hashes array<bigint>"


def _frequent(texts: DataFrame) -> DataFrame:
    """``(hash)`` that many texts of a bounded sample have. The texts are chosen by their hashes, so
    only those of the sample are moved. The sample fits into one task, and so do the hashes, at
    most SAMPLE / FREQUENT per hash of a text."""

    def counted(batches):
        own = [s for batch in bounded(batches, 1) for s in shingles(plain_texts(batch.column(1)))]
        found, times = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[times >= FREQUENT].view(np.int64))], ["hash"])

    chosen = texts.select("_hash").distinct().orderBy("_hash").limit(SAMPLE)
    sample = texts.join(F.broadcast(chosen), "_hash").groupBy("_hash").agg(F.first("_text").alias("_text"))
    return freeze(sample.repartition(1).mapInArrow(counted, "hash bigint"))


def _able(texts: DataFrame) -> DataFrame:
    """``(mark, hits, times)``: how many of the first hashes of a class occur in another class, in all
    the times that it was sent."""
    settled = F.broadcast(_frequent(texts).withColumn("_known", F.lit(1)))
    sent = F.explode(F.concat("hashes", F.array(F.lit(None).cast("bigint"))))  # null counts the times
    rows = texts.mapInArrow(_prefixes, _HASHES).select("mark", sent.alias("hash"))
    rows = rows.join(settled, "hash", "left")
    # What is settled needs no company in its task, so it is spread, and so are the nulls.
    alone = F.col("_known").isNotNull() | F.col("hash").isNull()
    of_hash = Window.partitionBy(F.when(alone, F.xxhash64("hash", "mark")).otherwise(F.col("hash")))
    several = F.min("mark").over(of_hash) != F.max("mark").over(of_hash)
    once = F.col("hash").isNull()
    hits = rows.select("mark", once.alias("_once"), (~once & (alone | several)).alias("_hit"))
    return hits.where("_once OR _hit").groupBy("mark").agg(F.count_if("_hit").alias("hits"), F.count_if("_once").alias("times"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component)`` per row; the component is the least key it reaches."""
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    kind = docs.schema[key].dataType.simpleString()
    classes = freeze(texts.mapInArrow(_classes, f"_key {kind}, _hash bigint, n bigint, mark bigint"))
    heads = freeze(
        classes.where("mark IS NOT NULL")
        .groupBy("mark")
        .agg(F.min("_key").alias("head"), F.min("_hash").alias("_hash"), F.first("n").alias("n"))
    )
    enough = F.col("hits") >= F.ceil(F.col("n") / SHARE) * F.col("times")
    able = freeze(heads.join(_able(texts), "mark").where(enough).select("_hash").distinct())
    able = F.broadcast(able) if able.count() <= FEW else able
    # Copies of a text become one where they are read.
    chosen = texts.join(able, "_hash", "left_semi").groupBy("_hash").agg(F.first("_text").alias("_text"))
    sets = chosen.select("_hash", "_text").mapInArrow(_whole, _HASHES)
    labels = _linked(sets, heads.select("mark", "n"))
    # The component of a class is that of its least key, over all classes it holds.
    named = labels.join(heads.select("mark", "head"), labels["node"] == heads["mark"])
    least = named.groupBy("label").agg(F.min("head").alias("component"))
    of_mark = named.join(least, "label").select("mark", "component")
    found = heads.join(of_mark, "mark", "left").select(
        "mark", F.coalesce("component", "head").alias("component")
    )
    with_set = classes.where("mark IS NOT NULL").join(found, "mark")
    without = classes.where("mark IS NULL").withColumn("component", F.col("_key"))
    return with_set.unionByName(without).select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component"
    )


def _linked(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(node, label)``: the marks that have links, and the least mark that each reaches."""
    rows = sets.select("mark", F.explode("hashes").alias("hash"))
    times = F.count("*").over(Window.partitionBy("hash")).alias("times")
    # Hashes of one set alone come first and match nothing: their number is all that is needed.
    # The others are kept as one number each: the logarithm of how many sets hold the hash in
    # the upper RARITY bits, so sorting puts rare ones first, and the hash in the lower.
    rarity = F.floor(F.log2(F.col("times").cast("double"))).cast("bigint")
    packed = F.shiftleft(rarity, 64 - RARITY) + F.shiftrightunsigned("hash", RARITY)
    ordered = freeze(
        rows.select("mark", "hash", times)
        .where("times > 1")
        .select("mark", packed.alias("_packed"))
        .groupBy("mark")
        .agg(F.array_sort(F.collect_list("_packed")).alias("common"), *_parities("_packed"))
        .join(sizes, "mark")
        .withColumn("alone", F.col("n") - F.size("common"))
    )
    lists = compact(freeze(_lists(ordered, _boundary(ordered))))
    shared = ordered.select("mark", "n", F.col("common").alias("hashes"))
    outlines = ordered.select("mark", "n", "alone", *_BITS)
    commons = ordered.select("mark", "common")
    named = seen = None
    for turn in range(STAR_ROUNDS + 1):
        if named is None:
            labelled = lists.withColumn("label", F.col("mark"))
        else:
            known = named.withColumnRenamed("label", "_label")
            labelled = lists.join(known, F.col("mark") == F.col("node"), "left")
            labelled = labelled.select(*lists.columns, F.coalesce("_label", "mark").alias("label"))
            labelled = compact(freeze(_open(labelled)))
            if labelled.isEmpty():
                break
            lists = labelled.drop("label")
        pairs = _near(_stars(labelled, turn), outlines) if turn < STAR_ROUNDS else _left_over(labelled, outlines.join(commons, "mark")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = compact(freeze(pairs))
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = _checked(pairs, shared)
        # What is known to be linked is a star around the least mark already.
        if named is not None:
            links = links.unionByName(named.select(F.col("node").alias("a"), F.col("label").alias("b")))
        named = freeze(components(links))
    return named


def _parities(packed: str) -> list[Column]:
    """Each hash turns one of 256 bits over, so two sets that differ in d hashes differ in at most d bits."""
    word, bit = F.col(packed).bitwiseAND(3), F.expr(f"shiftleft(1L, cast(shiftright({packed}, 2) & 63 AS int))")
    return [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(b) for i, b in enumerate(_BITS)]


def _outline_allows(a: str, b: str) -> Column:
    """False only for sets that differ in too many hashes to link: those that one set alone has, and
    at least as many of the others as bits differ."""
    of = lambda side, name: F.col(f"{side}.{name}")
    bits = [F.bit_count(of(a, x).bitwiseXOR(of(b, x))) for x in _BITS]
    both = of(a, "n") + of(b, "n")
    apart = sum(bits, of(a, "alone") + of(b, "alone"))
    return apart <= both - 2 * F.ceil(both * THRESHOLD / (100 + THRESHOLD))


def _near(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """The pairs whose outlines allow a link."""
    joined = pairs.join(outlines.alias("l"), F.col("a") == F.col("l.mark"))
    joined = joined.join(outlines.alias("r"), F.col("b") == F.col("r.mark"))
    return joined.where(_outline_allows("l", "r")).select("a", "b")


def _open(lists: DataFrame) -> DataFrame:
    """The lists that hold sets of different components."""
    several = lists.groupBy("list").agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
    return lists.join(several.where("_a <> _b").select("list"), "list", "left_semi")


def _first(n: Column, alone: Column, k: int) -> Column:
    """How many of the common hashes lie among the first n - c + k of the set."""
    need = F.ceil(n * THRESHOLD / 100)
    return F.greatest(n - need + k - alone, F.lit(0)).cast("int")


def _boundary(sets: DataFrame) -> int:
    """The largest size of a light set. Sizes are counted in steps of a fifth, of which there
    are few; per step the pairs that light sets would enumerate, each ``ROW`` times, and the
    lengths of the lists that heavy sets would scan."""
    one = F.slice("common", 1, _first(F.col("n"), F.col("alone"), 1))
    two = _first(F.col("n"), F.col("alone"), 2).cast("double")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.2)))
    scans = F.aggregate(one, F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), F.shiftright(x, 64 - RARITY)))
    rows = (
        sets.groupBy(step.alias("step"))
        .agg(F.max("n").alias("n"), F.sum(two * (two - 1) / 2 * ROW).alias("pairs"), F.sum(scans).alias("scans"))
        .orderBy("step")
        .collect()
    )
    best, boundary = sum(r.scans for r in rows), 0
    for i, row in enumerate(rows):
        cost = sum(r.pairs for r in rows[: i + 1]) + sum(r.scans for r in rows[i + 1 :])
        if cost <= best:
            best, boundary = cost, row.n
    return int(boundary)


def _lists(sets: DataFrame, boundary: int) -> DataFrame:
    """``(list, mark, n, heavy, place)``: members of the lists of hashes and of pairs of
    hashes. ``place`` is the number of hashes of the set up to the first that the list names."""
    heavy = F.col("n") > boundary
    n, alone = F.col("n"), F.col("alone")
    one = F.transform(
        F.slice("common", 1, _first(n, alone, 1)),
        lambda x, i: F.struct(F.xxhash64(x).alias("list"), (alone + i + 1).alias("place")),
    )
    two = F.slice("common", 1, _first(n, alone, 2))
    pairs = F.flatten(
        F.transform(
            two,
            lambda x, i: F.transform(
                F.slice(two, i + 2, F.size(two)),
                lambda y: F.struct(
                    F.xxhash64(x, y).alias("list"), (alone + i + 1).alias("place")
                ),
            ),
        )
    )
    none = F.expr("cast(array() as array<struct<list:bigint,place:bigint>>)")
    of_light = F.when(~heavy, pairs).otherwise(none)
    # Light sets that are too small for any heavy one stay out of the lists of single hashes.
    of_heavy = F.when(heavy | (n * 100 >= THRESHOLD * boundary), one).otherwise(none)
    rows = sets.select(
        "mark", "n", heavy.alias("heavy"), F.explode(F.concat(of_light, of_heavy)).alias("_at")
    ).select("_at.list", "mark", "n", "heavy", F.col("_at.place").cast("bigint").alias("place"))
    sizes = rows.groupBy("list").agg(F.min("mark").alias("_a"), F.max("mark").alias("_b"))
    return rows.join(sizes.where("_a <> _b").select("list"), "list", "left_semi")


def _stars(lists: DataFrame, turn: int) -> DataFrame:
    """Each set with a set of another component that stands for its list, in the list of its
    rarest hash and in that of its most frequent one. Another one stands in each turn."""
    one = F.struct("label", F.xxhash64("mark", F.lit(turn)).alias("order"), "mark")
    stands = lists.groupBy("list").agg(F.min(one).alias("_first"), F.max(one).alias("_last"))
    rows = lists.join(stands.where("_first.label <> _last.label"), "list")
    # The least component of the list stands for the others, the greatest for the least.
    other = F.when(F.col("label") == F.col("_first.label"), F.col("_last.mark")).otherwise(F.col("_first.mark"))
    at = F.struct("place", "list", other.alias("other"))
    pairs = rows.groupBy("mark").agg(F.min(at).alias("_p"), F.max(at).alias("_q"))
    both = pairs.select("mark", F.explode(F.array("_p.other", "_q.other")).alias("other"))
    return both.select(F.least("mark", "other").alias("a"), F.greatest("mark", "other").alias("b")).distinct()


def _before() -> Column:
    """The common hashes of a set that come before those that the list names, or between them. Sets
    that share many hashes meet in many lists, but share none of these only in the list of their first
    common hash and in that of their first two."""
    common, at = F.col("common"), (F.col("place") - F.col("alone")).cast("int")
    x = F.element_at(common, at)
    later = F.slice(common, at + 1, _first(F.col("n"), F.col("alone"), 2) - at)
    # 0 if the list is that of one hash.
    second = F.array_position(F.transform(later, lambda y: F.xxhash64(x, y)), F.col("list")).cast("int")
    return F.array_remove(F.slice(common, 1, at + second - 1), x)


def _left_over(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of sets of open lists that may link and lie in different components, from these lists
    or from those of single hashes of their sets, whichever costs less."""
    labels = lists.groupBy("mark").agg(F.first("label").alias("label"))
    singly = _singly(sets.join(labels, "mark"))
    return _compared(_open(singly)) if _cost(singly) <= _cost(lists) else _rest(lists, sets)


def _singly(sets: DataFrame) -> DataFrame:
    """Each set with the list of each of its first hashes, ``(list, place, before)``. Sets that link
    share one. No more than these hashes leave the row of a set."""
    sets = sets.withColumn("common", F.slice("common", 1, _first(F.col("n"), F.col("alone"), 1)))
    return sets.select("*", F.posexplode("common").alias("_i", "_x")).select(
        *[c for c in sets.columns if c != "common"],
        F.xxhash64("_x").alias("list"),
        (F.col("alone") + F.col("_i") + 1).cast("bigint").alias("place"),
        F.slice("common", F.lit(1), F.col("_i")).alias("before"),
    )


def _cost(lists: DataFrame) -> float:
    """Rows of the open lists, each ``ROW`` times, and the comparisons within them."""
    sizes = lists.groupBy("list").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").cast("double").alias("_n"))
    return sizes.where("_a <> _b").agg(F.sum(F.col("_n") * ROW + F.col("_n") * F.col("_n"))).first()[0] or 0.0


def _rest(lists: DataFrame, outlines: DataFrame) -> DataFrame:
    """The pairs of the given lists."""
    return _compared(lists.join(outlines.drop("n"), "mark").withColumn("before", _before()).drop("common"))


def _compared(lists: DataFrame) -> DataFrame:
    """All pairs of open lists that lie in different components and may link by size, place and
    outline, each from one list of a hash and one of a pair at most."""
    left, right = lists.alias("l"), lists.alias("r")
    n, m = F.col("l.n"), F.col("r.n")
    need = F.ceil((n + m) * THRESHOLD / (100 + THRESHOLD))
    most = F.least(n - F.col("l.place"), m - F.col("r.place")) + 1
    may = (
        (F.col("l.list") == F.col("r.list"))
        & (F.col("l.mark") < F.col("r.mark"))
        & (F.col("l.label") != F.col("r.label"))
        & (F.least(n, m) * 100 >= THRESHOLD * F.greatest(n, m))
        & (most >= need)
        & _outline_allows("l", "r")
        & ~F.arrays_overlap("l.before", "r.before")
    )
    return left.join(right, may).select(F.col("l.mark").alias("a"), F.col("r.mark").alias("b"))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by all hashes that two sets can have in common."""
    few = F.broadcast if pairs.count() <= FEW else lambda df: df
    of_a = sets.select(F.col("mark").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    of_b = sets.select(F.col("mark").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    of_b = of_b.join(few(pairs.select("b").distinct()), "b", "left_semi")
    both = F.size(F.array_intersect("h_a", "h_b")).cast("bigint")
    return (
        of_a.join(few(pairs), "a")
        .join(of_b, "b")
        .where(both * 100 >= THRESHOLD * (F.col("n_a") + F.col("n_b") - both))
        .select("a", "b")
    )


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """Set size and component per row of ``documents``."""
    return link(docs).withColumnRenamed("component", "component_id")
