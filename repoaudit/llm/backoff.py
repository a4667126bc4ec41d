"""Language-model scores of texts by stupid backoff, computed by questions and answers.

The score of a word after the words before it is the relative frequency of the longest n-gram
that was seen, times ``DISCOUNT`` for each word the n-gram was shortened by. Scores of a text's
words are summed as logarithms.

1. Words are 64-bit hashes, so every distinct word of the corpus counts as itself, and an n-gram of
   any length is a 64-bit hash of its words. A batch of texts moves once, to where it stays, as its distinct
   words and a number per word.
2. Questions: a batch sends its distinct n-grams, each with how often it has it in either fold, to
   the bucket of their hash, as one row of packed numbers per bucket. A text belongs to one of two folds
   by a hash of its key and is scored with the counts of the other, so no text is scored by its own
   n-grams. However frequent an n-gram is, a batch sends it once.
3. Answers: a bucket adds up what all batches have and returns to each the counts it needs, in
   the order in which it asked; the n-grams do not travel back.
4. Single words and pairs are asked for at once. A longer n-gram can be in the other fold only if both
   n-grams that are one word shorter are, so the others are not sent: they count for nobody.

Rows are bytes, a number in as few as the largest of its column needs, and compressed, since n-grams are most of what
the disk holds. A batch has about ``CODED`` bytes of text or one text, a bucket about ``GROUP`` words,
so tasks hold as much on any corpus.

Null and empty texts have no words and the score 0. Texts start with a mark that has a number of
its own. Every row is scored by itself, told from others by its place in its batch: rows of one key are in one
fold, and rows without a key are in folds by their text, so that they do not all share one. An empty
table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.llm.common import Words, bounded, mix, plain_texts

#: What stands before a text's first word: the hash of the empty word, which no text has.
BEGIN = np.array([xxhash.xxh3_64_intdigest("")], np.uint64)
#: Words of the longest n-gram, and the factor of each shortening.
ORDER, DISCOUNT = 3, 0.4
#: Bytes of text in a batch, words of the corpus for each bucket of n-grams.
CODED, GROUP = 8 << 20, 2_000_000
#: An odd number that tells the places of words in an n-gram apart.
STEP = np.uint64(0x9E3779B97F4A7C15)


def fold(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(2)).cast("int")


def _fold_of(key: str, text: str) -> Column:
    return F.when(F.col(key).isNull(), fold(F.coalesce(F.col(text), F.lit("")))).otherwise(fold(F.col(key)))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, the lowest bytes of each first, compressed."""
    head, planes = [], []
    for column in columns:
        column = np.ascontiguousarray(column).astype("<u8", copy=False)
        width = (int(column.max()).bit_length() + 7) // 8 if len(column) else 0
        head += [len(column), width]
        planes.append(column.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = b"".join(planes)
    return np.array([len(columns), len(raw), *head], "<i8").tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    number, size = (int(v) for v in np.frombuffer(data, "<i8", 2))
    head = np.frombuffer(data, "<i8", 2 * number, 16).reshape(-1, 2)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[16 + 16 * number :], size), np.uint8) if size else np.zeros(0, np.uint8)
    columns, at = [], 0
    for length, width in head.tolist():
        column = np.zeros((length, 8), np.uint8)
        column[:, :width] = raw[at : at + length * width].reshape(width, length).T
        columns.append(column.view("<u8")[:, 0])
        at += length * width
    return columns


def _counted(batches):
    """Words and texts with words in each fold, for batches of texts ``(key, fold, text, row)``."""
    for batch in bounded(batches, 2, CODED):
        length, folds = np.diff(Words(plain_texts(batch.column(2))).starts), batch.column(1).to_numpy(zero_copy_only=False)
        sums = [int(values[folds == f].sum()) for values in (length, length > 0) for f in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in sums], ["n0", "n1", "starts0", "starts1"])


def _coded(batches):
    """Batches of texts ``(key, fold, text, row)`` as rows: their keys and their words as numbers, those of
    frequent words small."""
    for batch in bounded(batches, 2, CODED):
        words = Words(plain_texts(batch.column(2)))
        rank = np.argsort(-np.bincount(words.codes, minlength=len(words.names)), kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        folds = batch.column(1).to_numpy(zero_copy_only=False)
        keys = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
        data = _pack(np.diff(words.starts), folds, words.hashes()[rank], place[words.codes])
        yield pa.RecordBatch.from_arrays([batch.column(3).slice(0, 1), keys, pa.array([data], pa.binary())], ["batch", "keys", "data"])


def _groups(batches, *keys: str):
    """Rows that have the same ``keys``, which come one after the other."""
    at, held = None, []
    for batch in batches:
        for i in range(0, len(batch), 64):
            for row in batch.slice(i, 64).to_pylist():
                own = tuple(row[k] for k in keys)
                if held and own != at:
                    yield at, held
                    held = []
                at = own
                held.append(row)
    if held:
        yield at, held


class _Texts:
    """The words of a batch with their n-grams: per word its text, the fold of that, and the n-grams that end there."""

    def __init__(self, data: bytes, order: int):
        length, folds, names, codes = _unpack(data)
        length = length.astype(np.int64)
        self.folds, self.length = folds, length
        self.text = np.repeat(np.arange(len(length)), length)
        self.fold = folds[self.text]
        self.first = (np.cumsum(length) - length)[length > 0]
        word, begin = names[codes], BEGIN
        self.grams = [word]
        for _ in range(order - 1):
            self.grams.append(mix(self.before(self.grams[-1], begin[0]) * STEP + word))
            begin = mix(begin * STEP + BEGIN)

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """What the word before each has, ``first`` for the first of a text."""
        found = np.empty_like(values)
        found[1:] = values[:-1]
        found[self.first] = first
        return found

    def distinct(self, k: int, some=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of k words in their order, and the place there of that of each word."""
        return np.unique(self.grams[k - 1][some], return_inverse=True)

    def asked(self, k: int, some=slice(None)) -> tuple[np.ndarray, list[np.ndarray]]:
        """N-grams of k words and how often each fold has them."""
        names, at = self.distinct(k, some)
        ones = np.bincount(at[self.fold[some] == 1], minlength=len(names))
        return names, [np.bincount(at, minlength=len(names)) - ones, ones]

    def scored(self, answers: list[list[bytes]], starts: list[int], totals: list[int]):
        """Per word the score by n-grams of up to as many words as there are ``answers`` for, and whether one
        that is a word longer may be in the other fold: it is asked for only then."""
        other = 1 - self.fold.astype(np.int64)
        of_first = np.array(starts, np.int64)[other[self.first]]
        some, score, context = slice(None), None, None
        for k, rows in enumerate(answers, 1):
            counts = [_unpack(r) for r in rows]
            n0, n1 = (np.concatenate([np.zeros(0, np.int64), *[c[f].astype(np.int64) for c in counts]]) for f in (0, 1))
            _, at = self.distinct(k, some)
            seen = np.zeros(len(self.text), np.int64)
            seen[some] = np.where(other[some] == 0, n0[at], n1[at])
            if k == 1:
                score = np.log(np.maximum(seen, 1) / np.array(totals, np.float64)[other])
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    longest = np.log(seen / np.maximum(context, seen))
                score = np.where(seen > 0, longest, score + np.log(DISCOUNT))
            context = self.before(seen, of_first)
            if k > 1:
                some = (seen > 0) & (context > 0)
        return score, some


def _cut(names: np.ndarray, columns: list[np.ndarray], buckets: int):
    """Numbers of the buckets of sorted hashes, and what goes to each, packed: the hashes and the columns."""
    bucket = ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)]):
        yield int(bucket[a]), _pack(names[a : a + 1], np.diff(names[a:b], prepend=names[a : a + 1]), *[c[a:b] for c in columns])


def _uncut(data: bytes) -> list[np.ndarray]:
    first, steps, *columns = _unpack(data)
    return [first + np.cumsum(steps, dtype=np.uint64), *columns]


_ASKED = "k int, bucket int, batch bigint, data binary"


def _few(rows):
    """Lists of some of the rows at a time."""
    rows = iter(rows)
    while some := list(islice(rows, 256)):
        yield some


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "bucket", "batch", "data"])


def _asking(batches, orders: list[int], buckets: int):
    """The questions of batches for n-grams of some orders, all that they have."""
    for rows in batches:
        for batch, data in zip(rows.column("batch"), rows.column("data")):
            texts = _Texts(data.as_py(), max(orders))
            for k in orders:
                for some in _few(_cut(*texts.asked(k), buckets)):
                    yield _rows([(k, bucket, batch.as_py(), data) for bucket, data in some])


def _answering(batches):
    """Answers to the questions of each bucket: for each n-gram how often the folds have it, where the
    batch has it in the other one."""
    for (k, bucket), rows in _groups(batches, "k", "bucket"):
        asked = [_uncut(row["data"]) for row in rows]
        names, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        own = [np.concatenate([a[1 + f] for a in asked]).astype(np.int64) for f in (0, 1)]
        every = [np.zeros(len(names), np.int64) for _ in own]
        for total, n in zip(every, own):
            np.add.at(total, at, n)
        needed = [np.where(own[1 - f] > 0, every[f][at], 0) for f in (0, 1)]
        ends = np.cumsum([len(a[0]) for a in asked]).tolist()
        found = ((k, bucket, row["batch"], _pack(*[n[a:b] for n in needed])) for row, a, b in zip(rows, [0, *ends], ends))
        yield from map(_rows, _few(found))


def _scored(row: pa.Table, answers: pa.Table, known: int, order: int, starts: list[int], totals: list[int]):
    """The words of a batch with n-grams of up to ``order``, and their scores by its answers for up to ``known``."""
    texts = _Texts(row["data"][0].as_py(), order)
    given = sorted(answers.select(["k", "bucket", "data"]).to_pylist(), key=lambda r: (r["k"], r["bucket"]))
    return texts, texts.scored([[r["data"] for r in given if r["k"] == k] for k in range(1, known + 1)], starts, totals)


def _asking_on(row: pa.Table, answers: pa.Table, k: int, starts: list[int], totals: list[int], buckets: int) -> pa.Table:
    """The questions of a batch for n-grams of k words, by its answers for shorter ones."""
    texts, (_, some) = _scored(row, answers, k - 1, k, starts, totals)
    batch = row["batch"][0].as_py()
    asked = _cut(*texts.asked(k, some), buckets)
    return pa.Table.from_batches([_rows([(k, bucket, batch, data) for bucket, data in few]) for few in _few(asked)], _rows([]).schema)


def _scoring(row: pa.Table, answers: pa.Table, order: int, starts: list[int], totals: list[int]) -> pa.Table:
    """Keys, words and scores of the texts of a batch that has answers for n-grams of all lengths."""
    texts, (score, _) = _scored(row, answers, order, order, starts, totals)
    sums = np.bincount(texts.text, score, len(texts.length))
    return pa.table({"keys": row["keys"], "words": pa.array([texts.length]), "scores": pa.array([sums])})


def _longer(k: int, *corpus):
    return lambda row, answers: _asking_on(row, answers, k, *corpus)


def _answered(asked: DataFrame, buckets: int, places: int) -> DataFrame:
    """The answers, brought to the batches."""
    rows = asked.repartition(4 * buckets, "k", "bucket").sortWithinPartitions("k", "bucket")
    return rows.mapInArrow(_answering, _ASKED).repartition(places, "batch")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """``(key, n_words, log_score)`` per row."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    texts = texts.select("_key", _fold_of("_key", "_text").alias("fold"), "_text", F.monotonically_increasing_id().alias("_row"))
    sums = ["n0", "n1", "starts0", "starts1"]
    counted = texts.mapInArrow(_counted, ", ".join(f"{c} bigint" for c in sums))
    number, *found = counted.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in sums]).first()
    totals, starts = [t or 1 for t in found[:2]], found[2:]
    buckets = max(1, -(-sum(found[:2]) // GROUP))

    # Questions are asked from where the batches stay, so this one shuffle serves all that follows. With fewer
    # partitions than Spark's own shuffles have, it would deal them again to bring the answers.
    places = max(number, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    batches = texts.mapInArrow(_coded, f"batch bigint, keys array<{kind}>, data binary").repartition(places, "batch")
    known = list(range(1, min(order, 2) + 1))
    answers = _answered(batches.mapInArrow(lambda rows: _asking(rows, known, buckets), _ASKED), buckets, places)

    def beside(made, schema: str) -> DataFrame:
        return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(made, schema)

    for k in range(3, order + 1):
        asked = beside(_longer(k, starts, totals, buckets), _ASKED)
        answers = answers.unionByName(_answered(asked, buckets, places))
    scored = beside(
        lambda row, given: _scoring(row, given, order, starts, totals),
        f"keys array<{kind}>, words array<bigint>, scores array<double>",
    )
    found = scored.select(F.explode(F.arrays_zip("keys", "words", "scores")).alias("of"))
    return found.select(
        F.col("of.keys").alias(key), F.col("of.words").alias("n_words"), F.col("of.scores").alias("log_score")
    )


def lm_digest(docs: DataFrame) -> DataFrame:
    """Score, words and mean score of every row of ``documents``."""
    found = score(docs)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return found.select(
        "doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round(mean, 6).alias("mean_log_score")
    )
