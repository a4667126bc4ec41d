"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated.

A rule looks at counts of one text and votes good, bad, or abstains. No rule decides alone:
expectation-maximisation fits, without labels, how often each rule votes which way on good
and on bad texts, and Bayes' rule turns the votes of a text into the probability that it is
good. All that the fit needs is how many texts have each pattern of votes. The table of
patterns has at most 3 to the number of rules rows whatever the number of texts, so it is
the one thing that is collected and broadcast; it counts every text.

The counts of a text come from one pass in Arrow batches and are kept, so texts are read
once. Memory of a task follows its batch.

Null and empty texts have no words; they get counts of zero and the rules that need words
abstain. Rows are independent, repeated rows get equal results. An empty table gives an
empty one. Columns of the input other than key and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.llm.common import Words, bounded, mix, plain_texts
from repoaudit.session import freeze

GOOD, BAD, ABSTAIN = 1, -1, 0
#: Steps of the fit, and the share of good texts that it starts from.
STEPS, START = 100, 0.8
#: How much a vote may count, in natural logarithms of odds: least and most.
BAD_WEIGHT, GOOD_WEIGHT = (1.6, 6.0), (0.0, 1.2)
SILENCE = 1.2
#: A text is kept from this probability of being good.
MIN_GOOD = 0.5

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_common",
)


def _repeat_words(codes: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(codes) < 4:
        return 0
    windows = mix(mix(mix(codes[:-2].astype(np.uint64) + np.uint64(1)) + codes[1:-1].astype(np.uint64)) + codes[2:].astype(np.uint64))
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : len(codes) - 2 + shift] |= again
    return int(covered.sum())


def _line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = [line for line in text.split("\n") if line.strip(" \t\r\v\f")]
    return len(lines), len(lines) - len(set(lines))


def _counted(batches):
    for batch in bounded(batches, 1):
        texts = plain_texts(batch.column(1))
        words = Words(texts)
        lengths = pc.utf8_length(words.names).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths[words.codes])])
        starts = words.starts
        python = texts.to_pylist()
        lines = [_line_counts(t) for t in python]
        per_text = [words.codes[a:b] for a, b in zip(starts[:-1], starts[1:])]
        columns = [
            np.diff(starts),
            total[starts[1:]] - total[starts[:-1]],
            _chars(texts, "[#*$%&|<>]"),
            np.array([x[1] for x in lines], np.int64),
            np.array([_repeat_words(c) for c in per_text], np.int64),
            np.array([x[0] for x in lines], np.int64),
            _chars(texts, r"\p{Lu}"),
            _chars(texts, r"\p{L}"),
            np.array([np.bincount(c).max() if len(c) else 0 for c in map(_dense, per_text)], np.int64),
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(c.astype(np.int64)) for c in columns], ["_key", *COUNTS]
        )


def _dense(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1] if len(codes) else codes


def _chars(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def count_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts that the rules look at, per text."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    counted = docs.select(key, text).mapInArrow(_counted, schema)
    return counted.withColumnRenamed("_key", key)


def rules() -> dict[str, Column]:
    """The vote of each rule as an expression on the counts.

    The first eight know one fault each: they vote bad where they see it and abstain
    elsewhere. The last three know signs of ordinary text and never vote bad.
    """
    n, some = F.col("n_words"), F.col("n_words") > 0
    lines, letters = F.col("n_lines"), F.col("n_letters")
    mean = F.try_divide("word_chars", "n_words")
    faults = {
        "short": n < 20,
        "symbols": some & (100 * F.col("n_symbols") >= 10 * n),
        "same_lines": (lines >= 3) & (100 * F.col("n_dup_lines") >= 30 * lines),
        "repeats": some & (100 * F.col("n_repeat_words") >= 30 * n),
        "word_length": some & ~mean.between(2.5, 12.0),
        "capitals": some & (100 * F.col("n_upper") >= 40 * letters),
        "letters": some & (100 * letters <= 75 * F.col("word_chars")),
        "one_word": (n >= 30) & (100 * F.col("n_common") >= 30 * n),
    }
    signs = {
        "length": n >= 100,
        "diverse": (n >= 50)
        & (100 * F.col("n_repeat_words") <= 10 * n)
        & (100 * F.col("n_common") <= 12 * n),
        "clean": some
        & (100 * letters >= 90 * F.col("word_chars"))
        & (100 * F.col("n_symbols") <= n)
        & (100 * F.col("n_upper") <= 15 * letters),
    }
    return {k: F.when(v, BAD).otherwise(ABSTAIN) for k, v in faults.items()} | {
        k: F.when(v, GOOD).otherwise(ABSTAIN) for k, v in signs.items()
    }


def fit(votes: np.ndarray, times: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The probability of good for each pattern of votes (a row of ``votes``).

    ``times`` says how many texts have the pattern. Each rule has a probability of voting on
    good and on bad texts; expectation-maximisation finds them with the share of good texts.
    How much a vote counts, the logarithm of the ratio of the two probabilities, is kept
    within ``BAD_WEIGHT`` or ``GOOD_WEIGHT``: a rule may turn out weak, but never to mean the
    opposite of what it says. That a rule which knows a fault abstains counts for the text, by
    the ratio of its chances to abstain, at most ``SILENCE``; of other rules it says nothing.
    """
    if not len(votes):
        return np.zeros(0)
    bad, good = votes == BAD, votes == GOOD
    weight = np.where(bad.any(axis=0), sum(BAD_WEIGHT) / 2, sum(GOOD_WEIGHT) / 2)
    silence = np.zeros(votes.shape[1])
    prior = START
    for _ in range(steps):
        logit = np.log(prior / (1 - prior)) + good @ weight - bad @ weight + ~bad @ silence
        p_good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        on_good, on_bad = p_good * times, (1 - p_good) * times
        # One vote and one abstention more in each class, so no chance is zero.
        chance = [
            ((bad | good).T @ side + 1) / (side.sum() + 2) for side in (on_good, on_bad)
        ]
        ratio = np.log(chance[0] / chance[1])
        is_bad = bad.any(axis=0)
        weight = np.where(is_bad, np.clip(-ratio, *BAD_WEIGHT), np.clip(ratio, *GOOD_WEIGHT))
        quiet = np.log((1 - chance[0]) / (1 - chance[1]))
        silence = np.where(is_bad, np.clip(quiet, 0, SILENCE), 0.0)
        prior = float(np.clip((on_good.sum() + 1) / (times.sum() + 2), 0.5, 0.95))
    return p_good


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts per text, with its ``votes`` and the probability ``p_good``."""
    voting = rules()
    voted = freeze(
        count_texts(docs, key, text).withColumn(
            "votes", F.concat_ws("", *[F.element_at(F.array(*map(F.lit, "b.g")), v + 2) for v in voting.values()])
        )
    )
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** rules
    values = {"b": BAD, ".": ABSTAIN, "g": GOOD}
    votes = np.array([[values[c] for c in p.votes] for p in patterns]).reshape(len(patterns), len(voting))
    good = fit(votes, np.array([p["count"] for p in patterns], float))
    known = docs.sparkSession.createDataFrame(
        [(p.votes, float(g)) for p, g in zip(patterns, good)], "votes string, p_good double"
    )
    return voted.join(F.broadcast(known), "votes", "left")


def base_failed() -> Column:
    """Too short, or mostly repetition."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_digest(docs: DataFrame) -> DataFrame:
    """Counts and verdict per row of ``documents``."""
    return judge(docs).select(
        "doc_id",
        *COUNTS[:5],
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("p_good") >= MIN_GOOD)).alias("kept"),
        F.round("p_good", 6).alias("p_good"),
        "votes",
    )
