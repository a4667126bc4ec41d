"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the mean number of its copies in the mix. Among all rates that
give a source its target number of words, entropy balancing takes those closest to one in
relative entropy. They have the form ``min(MAX_COPIES, exp(l * size / largest))`` with one
multiplier ``l`` per source, the solution of a convex dual problem. Newton steps find it;
a step that leaves the interval known to hold the solution is replaced by its middle. Rates
are then rounded to copies.

The steps run on counts of documents by source and size, which say all the dual needs; they
combine before the shuffle, so a source that holds most rows costs no more than another.
Sums add integers (rates in millionths), so their order does not matter and reruns agree.

Rounding: a document gets the whole part of its rate and one more copy if a hash of its key,
less the fractional part, is below its source's threshold. The threshold is zero in
expectation; it is set so that the source's words meet the target, in two passes that count
words by thin slices of that difference. So a source misses its target by little more than
the size of one document, unless its documents are too few or its target is out of reach.

Nulls: a null text has size 0, a null source is a source of its own and comes last. Empty
documents are taken as often as their rate says, which adds no words. Rows are rounded one by one:
rows of one source, key (null or not) and size are numbered, each on its own number, and their hashes are
moved on by number, so that they spread evenly. Which of them has which number makes no difference to
the words taken from all of them. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from repoaudit.llm.common import WORD
from repoaudit.session import freeze

#: No document is taken more often than this, so no source gets more than this many times
#: its size.
MAX_COPIES = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Newton steps at most, and the relative distance from the target at which they end.
STEPS, NEAR = 40, 1e-6
#: Rates are summed as whole numbers of this unit.
UNIT = 1_000_000
#: Slices of the rounding threshold in each of two passes.
SLICES = 1024
#: Documents that a source may get at the end to come closer to its target.
TOP_UPS = 2
#: A table of sources with at most so many rows is broadcast; a larger one is joined.
FEW_SOURCES = 10_000


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of ``(source, source_size)`` rows as ``(source, source_size, target)``.

    Sources in code point order, null last, share all words by weight, but none gets more
    than ``MAX_COPIES`` times its own; the excess is shared again by weight. In the order of
    ceiling by weight, the sources up to some point get their ceiling and the others a common
    level times their weight. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    which = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = sources.withColumn(
        "_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), which).cast("double")
    ).withColumn("_most", (MAX_COPIES * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("_most") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    ) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("_level", level)
    free = F.col("_level") * F.col("_weight") <= F.col("_most")
    # The first source that stays below its ceiling has the common level.
    first = F.min(F.when(free, F.struct(F.col("_most") / F.col("_weight"), "_level")))
    return (
        leveled.withColumn("_common", first.over(everything)["_level"])
        .withColumn(
            "target",
            F.least("_most", F.coalesce(F.col("_common"), F.lit(0.0)) * F.col("_weight")),
        )
        .select("source", "source_size", "target")
    )


def _rate(multiplier: Column, size: Column, largest: Column) -> Column:
    tilted = F.exp(F.least(multiplier * size / largest, F.lit(2.0)))
    return F.when(multiplier.isNull(), F.lit(float(MAX_COPIES))).otherwise(
        F.least(tilted, F.lit(float(MAX_COPIES)))
    )


def _few(state: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(state) if few else state


def _join(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Add the columns of a source's state; null sources meet. A hot source is broadcast or,
    with many sources, split by Spark's handling of skew."""
    named = state.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(_few(named, few), same, "left").drop("_source")


def solve(counts: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """Multipliers ``(source, multiplier, largest)``; null where every rate is the ceiling.

    ``counts`` has ``(source, size, n)``, ``goals`` the targets and the largest size.
    """
    out_of_reach = F.col("target") >= MAX_COPIES * F.col("source_size") * (1 - 1e-9)
    state = freeze(
        goals.withColumns(
            {
                "multiplier": F.when(~out_of_reach, F.lit(0.0)),
                "_low": F.lit(None).cast("double"),
                "_high": F.lit(None).cast("double"),
                "_near": out_of_reach,
            }
        )
    )
    for _ in range(STEPS):
        if state.where("NOT _near").isEmpty():
            break
        open_ones = state.where("NOT _near")
        rows = _join(counts, open_ones.select("source", "multiplier", "largest"), few).where(
            "largest IS NOT NULL"
        )
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("largest"))
        units = F.round(rate * UNIT).cast("decimal(20,0)")
        slope = F.when(rate < MAX_COPIES, F.round(rate * UNIT * F.col("size") / F.col("largest")))
        words = (F.col("n") * F.col("size")).cast("decimal(18,0)")
        sums = rows.groupBy("source").agg(
            F.sum(words * units).cast("double").alias("_got"),
            F.sum(words * F.coalesce(slope, F.lit(0.0)).cast("decimal(20,0)"))
            .cast("double")
            .alias("_slope"),
        )
        state = freeze(_stepped(_join(state, sums, few)))
    return state.select("source", "multiplier", "largest")


def _stepped(state: DataFrame) -> DataFrame:
    """One safeguarded Newton step for the sources that are not near their target."""
    gap = F.col("_got") / UNIT - F.col("target")
    over = gap > 0
    # Nothing is known on one side at first: look at twice the distance from zero.
    low = F.when(over, F.col("_low")).otherwise(F.col("multiplier"))
    high = F.when(over, F.col("multiplier")).otherwise(F.col("_high"))
    newton = F.col("multiplier") - F.try_divide(gap * UNIT, F.col("_slope"))
    middle = (
        F.when(low.isNull(), F.least(high * 2, F.lit(-1.0)))
        .when(high.isNull(), F.greatest(low * 2, F.lit(1.0)))
        .otherwise((low + high) / 2)
    )
    inside = (
        newton.isNotNull()
        & (low.isNull() | (newton > low))
        & (high.isNull() | (newton < high))
        & (F.abs(newton) <= 4 * F.abs(F.col("multiplier")) + 8)
    )
    near = F.abs(gap) <= NEAR * F.greatest(F.col("target"), F.lit(1.0))
    done = F.col("_near") | F.col("_got").isNull()
    return state.withColumns(
        {
            "_low": F.when(done, F.col("_low")).otherwise(low),
            "_high": F.when(done, F.col("_high")).otherwise(high),
            "multiplier": F.when(done | near, F.col("multiplier")).otherwise(
                F.when(inside, newton).otherwise(middle)
            ),
            "_near": done | near,
        }
    ).drop("_got", "_slope")


def uniform(key: str, rank: str) -> Column:
    """A number from 0 to 1 that depends on the key and on the row's number among equal rows, which
    moves it on by the golden section, so that the numbers of a group lie evenly."""
    word = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 12), 16, 10)
    moved = word.cast("double") / float(16**12) + F.col(rank) * F.lit(0.6180339887498949)
    return moved - F.floor(moved)


def _numbered(sized: DataFrame) -> DataFrame:
    """Add ``_rank``: 0, 1, ... among rows that have source, key and size in common.

    Groups of several rows are numbered partition by partition, so one that holds most of the table
    is in no single task; the others stay where they are.
    """
    same = ["source", "_key", "size"]
    groups = freeze(sized.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if groups.isEmpty():
        return sized.withColumn("_rank", F.lit(0).cast("bigint"))
    rows = sized.withColumn("_id", F.monotonically_increasing_id())
    names = [F.col(c).alias(f"_of_{c}") for c in same]
    marked = groups.select(*names, F.lit(True).alias("_several"))
    several = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in same]
    found = rows.join(marked, several, "left").drop(*[f"_of_{c}" for c in same])
    single = found.where("_several IS NULL").withColumn("_rank", F.lit(0).cast("bigint"))
    part = F.shiftright("_id", 33)  # the id holds the partition in its upper bits
    repeated = found.where("_several").withColumn("_part", part)
    shares = repeated.groupBy("_part", *same).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        F.col("_part").alias("_of__part"), *names, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    own = repeated.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *same).orderBy("_id")))
    joined = own.join(shares, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ["_part", *same]])
    ranked = joined.withColumn("_rank", F.col("_before") + F.col("_at") - 1)
    columns = [*sized.columns, "_rank"]
    return single.select(*columns).unionByName(ranked.select(*columns))


def _thresholds(rows: DataFrame, few: bool, unit: Column, at: Column, ahead: str) -> DataFrame:
    """The slice of ``at`` (in units of one slice) in which a source meets its target, and the
    words taken before that slice."""
    cells = rows.groupBy("source", F.floor(at / unit).cast("bigint").alias("_slice")).agg(
        F.sum("size").alias("_words"), F.first(ahead).alias("_need")
    )
    order = Window.partitionBy("source").orderBy("_slice")
    upto = cells.withColumn("_upto", F.sum("_words").over(order))
    # The last slice that ends below the need, or none.
    return upto.where(F.col("_upto") <= F.col("_need")).groupBy("source").agg(
        F.max("_slice").alias("_last"), F.max("_upto").alias("_taken")
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    keep: str | None = None,
) -> DataFrame:
    """``(key, source, size, source_size, target, copies)`` per row, and the column ``keep``, which a
    caller can tell rows of equal keys apart by."""
    own = [F.col(keep).alias("_kept")] if keep else []
    sized = freeze(
        docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), sizes(docs, text).alias("size"), *own)
    )
    counts = freeze(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = freeze(
        counts.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size")).alias("source_size"),
            F.max("size").alias("largest"),
        )
    )
    few = per_source.count() <= FEW_SOURCES
    goals = freeze(
        _join(targets(per_source.drop("largest"), weights), per_source.select("source", "largest"), few)
    )
    solved = solve(counts, goals, few)

    rated = _join(_join(freeze(_numbered(sized)), goals.drop("largest"), few), solved, few).withColumn(
        "_rate", F.when(F.col("largest") > 0, _rate(F.col("multiplier"), F.col("size"), F.col("largest"))).otherwise(1.0)
    )
    rated = rated.withColumn("_whole", F.floor("_rate")).withColumn(
        "_at", uniform("_key", "_rank") - (F.col("_rate") - F.col("_whole"))
    )
    # What whole copies leave open, and the documents that may get one more.
    whole = rated.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * F.col("_whole"))).alias("_need")
    )
    whole = freeze(whole)
    open_rows = _join(rated.where(F.col("_whole") < MAX_COPIES), whole, few).where("size > 0")
    coarse = F.lit(1.0 / SLICES)
    first = freeze(
        _join(whole, _thresholds(open_rows, few, coarse, F.col("_at"), "_need"), few).select(
            "source",
            (F.coalesce(F.col("_last"), F.lit(-SLICES - 1)) + 1).alias("_edge"),
            (F.col("_need") - F.coalesce(F.col("_taken"), F.lit(0))).alias("_need"),
        )
    )
    inside = _join(rated.where(F.col("_whole") < MAX_COPIES).where("size > 0"), first, few).where(
        F.floor(F.col("_at") / coarse) == F.col("_edge")
    )
    fine = F.lit(1.0 / SLICES / SLICES)
    past_edge = F.col("_at") - F.col("_edge") * coarse
    second = _thresholds(inside, few, fine, past_edge, "_need")
    limits = freeze(
        _join(first, second, few).select(
            "source",
            (F.col("_edge") * coarse + (F.coalesce(F.col("_last"), F.lit(-1)) + 1) * fine).alias("_limit"),
        )
    )
    more = (F.col("_at") < F.coalesce(F.col("_limit"), F.lit(0.0))) & (F.col("_whole") < MAX_COPIES)
    rounded = freeze(
        _join(rated, limits, few).select(
            "_key",
            "_rank",
            *["_kept"] * bool(keep),
            "source",
            "size",
            "source_size",
            "target",
            (F.col("_whole") + F.when(more, 1).otherwise(0)).cast("int").alias("copies"),
        )
    )
    result = _topped_up(rounded, few).drop("_rank")
    return result.withColumnsRenamed({"_key": key, "source": source, **({"_kept": keep} if keep else {})})


def _topped_up(rows: DataFrame, few: bool) -> DataFrame:
    """One more copy for the largest row that still fits below the target, ``TOP_UPS`` times per
    source."""
    for _ in range(TOP_UPS):
        left = F.first("target") - F.sum(F.col("size") * F.col("copies"))
        need = freeze(rows.groupBy("source").agg(left.alias("_need")))
        fits = (F.col("size") <= F.col("_need")) & (F.col("size") > 0) & (F.col("copies") < MAX_COPIES)
        best = freeze(
            _join(rows, need, few)
            .where(fits)
            .groupBy("source")
            .agg(F.max(F.struct("size", "_key", "_rank")).alias("_best"))
        )
        is_best = F.struct("size", "_key", "_rank").eqNullSafe(F.col("_best"))
        rows = _join(rows, best, few).withColumn("copies", F.col("copies") + F.when(is_best, 1).otherwise(0)).drop("_best")
    return rows


def mix_digest(docs: DataFrame) -> DataFrame:
    """Words taken from each document of ``documents``."""
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
