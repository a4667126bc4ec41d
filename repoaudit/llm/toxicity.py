"""Toxicity: subword-bag embeddings, averaged, under a linear softmax.

A word stands for itself and for its character n-grams, with marks at both ends; each is
hashed to a row of one embedding table. A passage is the mean of the rows of all its words'
parts, and a linear softmax on that mean gives the probability of each class. A text is as
toxic as its most toxic passage; the passages cover the whole text. So a few insults count in
a text of any length. Table and softmax are trained jointly, in numpy, on a bounded sample of
labelled texts. A misspelt word that was never seen still shares most of its parts with the
word it comes from.

After training, the softmax of a mean is the mean of per-part scores, so scoring needs one
number per table row and, for each distinct word of a batch, one sum.

Why passages: the mean over a whole text drowns a few insults in a long one. On the held-out labels
of the tables at scale 0.1 (1344 texts, 144 toxic) the mean over whole texts finds 52 and marks 18
others, the likeliest passage finds 112 and marks 20. A text of one passage has the plain mean.

Training data: labelled rows that are not held out, ``MAX_TRAIN`` of each class at most,
taken in the order of a hash of their key; their whole texts. They are chosen by key and a hash
of the text; only the texts of those chosen are moved. Rows that repeat both key and text count
once. Every text is scored.

Null and empty texts have no parts: their score is the share that the bias gives. Ties and
repeated rows score alike. With no labelled rows of both classes the table stays untrained and
every score is 0. An empty table gives an empty one. Columns other than key and text are no
inputs of the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from repoaudit.llm.common import Words, bounded, mix, plain_texts

#: Rows of the embedding table and their width.
ROWS, WIDTH = 1 << 18, 8
#: Lengths of the character n-grams.
SHORTEST, LONGEST = 3, 5
#: Labelled texts of each class in training, at most. The bound of the sample.
MAX_TRAIN = 1500
#: Words of a passage, and neutral parts that each passage has besides, so that few words alone
#: decide little.
PASSAGE, PAD = 32, 100
#: Passes over all passages (and steps, at least), then rounds on the likeliest of each text.
EPOCHS, MIN_STEPS, BATCH = 2, 300, 64
ROUNDS, LIKELIEST = 20, 2
#: Step widths of the table and of the softmax.
RATE, TOP_RATE = 0.2, 0.05
#: Training sees both classes equally often; scores are corrected to this share of toxic texts.
#: A smaller one spares more clean texts and misses more toxic ones.
PRIOR = 0.35
#: Words whose score a task remembers, at most.
KNOWN = 300_000
#: Words whose parts are hashed at once.
AT_A_TIME = 20_000
#: The score from which a text counts as toxic.
TOXIC = 0.7


def held_out(key: Column) -> Column:
    """Rows that training never sees."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def _plain(word: str) -> str:
    """The word in lower case, without characters at its edges that are neither letters nor
    digits."""
    low = word.lower()
    begin, end = 0, len(low)
    while begin < end and not low[begin].isalnum():
        begin += 1
    while end > begin and not low[end - 1].isalnum():
        end -= 1
    return low[begin:end]


def parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word, row)`` arrays with the table rows of all parts of the words: each word between
    its marks, and the n-grams of that. Hashes are taken of all words at once."""
    marked = [f"<{_plain(w)}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), length)
    starts = np.cumsum(length) - length
    place = np.arange(len(points)) - starts[word]
    # A whole word is the sum of its characters' hashes, each with its place.
    placed = mix(points + (place.astype(np.uint64) << np.uint64(21)))
    of, found = [np.arange(len(marked))], [np.add.reduceat(placed, starts) if len(marked) else placed]
    for n in range(SHORTEST, LONGEST + 1):
        last = max(len(points) - n + 1, 0)
        gram = np.full(last, n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + points[k : k + last]
        inside = word[:last] == word[n - 1 : n - 1 + last]
        of.append(word[:last][inside])
        found.append(gram[inside])
    rows = mix(np.concatenate(found)) % np.uint64(ROWS)
    return np.concatenate(of), rows.astype(np.int64)


class Model:
    """``scores``: what each table row adds for class 1 against class 0; ``bias`` likewise."""

    def __init__(self, scores: np.ndarray, bias: float, trained: bool):
        self.scores, self.bias, self.trained = scores.astype(np.float32), bias, trained

    def words(self, words: list[str]) -> list[tuple[float, int]]:
        """What the parts of each word add, and how many they are."""
        of, rows = parts(words)
        total = np.bincount(of, self.scores[rows], len(words))
        return list(zip(total.tolist(), np.bincount(of, minlength=len(words)).tolist()))

    def probability(self, total: np.ndarray, n: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
        """The probability of each text from what the parts of its passages add and their number:
        that of its likeliest passage, or of an empty one."""
        if not self.trained:
            return np.zeros(texts)
        best = np.full(texts, -np.inf)
        np.maximum.at(best, text_of, total / (n + PAD))
        best[np.isinf(best)] = 0.0
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -500, 500)))


def passages(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, end, text)`` of the passages of texts whose words begin at ``starts``; each word
    lies in one of them."""
    length = np.diff(starts)
    number = -(-length // PASSAGE)
    text = np.repeat(np.arange(len(length)), number)
    place = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin = starts[:-1][text] + place * PASSAGE
    return begin, np.minimum(begin + PASSAGE, starts[1:][text]), text


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one range after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


class _Training:
    """Words, parts and passages of the sample, with table and softmax under training."""

    def __init__(self, texts: list[str], labels: list[int], seed: int):
        words = Words(pa.array(texts, pa.string()))
        names = words.names.to_pylist()
        own = []
        for i in range(0, len(names), AT_A_TIME):
            of, rows = parts(names[i : i + AT_A_TIME])
            order = np.argsort(of, kind="stable")
            own.append((np.bincount(of, minlength=len(names[i : i + AT_A_TIME])), rows[order].astype(np.int32)))
        self.codes = words.codes
        self.rows = np.concatenate([r for _, r in own] or [np.zeros(0, np.int32)])
        self.number = np.concatenate([n for n, _ in own] or [np.zeros(0, np.int64)])
        self.first = np.cumsum(self.number) - self.number
        self.begin, self.end, self.text = passages(words.starts)
        self.size = np.add.reduceat(self.number[self.codes], self.begin) + PAD if len(self.begin) else self.begin
        self.y = np.array(labels, np.int64)[self.text]
        self.random = np.random.default_rng(seed)
        self.table = self.random.uniform(-0.1, 0.1, (ROWS, WIDTH)).astype(np.float32)
        self.softmax = self.random.uniform(-1, 1, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        # Steps are scaled by each row's past gradients, so rare n-grams learn as fast as common.
        self.past_table = np.full(ROWS, 1e-12, np.float32)
        self.past_softmax, self.past_bias = np.full((WIDTH, 2), 1e-8), np.full(2, 1e-8)

    def scores(self) -> np.ndarray:
        return self.table @ (self.softmax[:, 1] - self.softmax[:, 0])

    def likeliest(self, few: int) -> np.ndarray:
        """The passages of each text that are most like class 1."""
        of_word = np.add.reduceat(self.scores()[self.rows], self.first)
        logit = np.add.reduceat(of_word[self.codes], self.begin) / self.size
        order = np.lexsort((-logit, self.text))
        number = np.bincount(self.text)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(number) - number, number)
        return order[rank < few]

    def epoch(self, chosen: np.ndarray) -> None:
        """One pass of gradient descent on the log loss; both classes weigh the same in all."""
        y = self.y[chosen]
        weight = (len(y) / (2 * np.bincount(y, minlength=2)[y])).astype(np.float32)
        order = self.random.permutation(len(chosen))
        for batch in np.array_split(order, -(-len(order) // BATCH)):
            at = chosen[batch]
            length = self.end[at] - self.begin[at]
            words = self.codes[_spans(self.begin[at], length)]
            rows = self.rows[_spans(self.first[words], self.number[words])]
            touched, row = np.unique(rows, return_inverse=True)
            size = self.size[at] - PAD
            share = np.repeat((1 / self.size[at]).astype(np.float32), size)
            starts = np.cumsum(size) - size
            mean = np.add.reduceat(self.table[rows] * share[:, None], starts, axis=0)
            logit = mean @ self.softmax + self.bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[batch]] -= 1
            p *= weight[batch, None] / len(at)
            back = np.repeat(p @ self.softmax.T, size, axis=0) * share[:, None]
            change = np.stack([np.bincount(row, back[:, k], len(touched)) for k in range(WIDTH)], axis=1)
            self.past_table[touched] += (change**2).mean(axis=1)
            pace = (RATE / np.sqrt(self.past_table[touched]))[:, None]
            self.table[touched] -= (pace * change).astype(np.float32)
            step = mean.T @ p
            self.past_softmax += step**2
            self.softmax -= (TOP_RATE / np.sqrt(self.past_softmax) * step).astype(np.float32)
            self.past_bias += p.sum(axis=0) ** 2
            self.bias -= (TOP_RATE / np.sqrt(self.past_bias) * p.sum(axis=0)).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit table and softmax together: first on all passages, which take the label of their text,
    then in rounds on the passages of each text that look most toxic."""
    run = _Training(texts, labels, seed)
    if len(set(run.y.tolist())) < 2:
        return Model(np.zeros(ROWS), 0.0, False)
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(run.y)))):
        run.epoch(np.arange(len(run.y)))
    for _ in range(ROUNDS):
        run.epoch(run.likeliest(LIKELIEST))
    bias = float(run.bias[1] - run.bias[0]) + float(np.log(PRIOR / (1 - PRIOR)))
    return Model(run.scores(), bias, True)


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """The bounded sample ``(_key, _text, _label)``: up to MAX_TRAIN rows of each class that are not
    held out, chosen without their texts."""
    marked = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(~held_out(F.col("_key")))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    found = rows.select("_key", "_hash").distinct().join(marked.distinct(), "_key")
    order = F.xxhash64("_key")
    picked = [
        found.where(F.col("_label") == c).orderBy(order, "_key", "_hash").limit(MAX_TRAIN) for c in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * MAX_TRAIN rows at most
    # A row that many others repeat is one already where it is read.
    return rows.join(chosen, ["_key", "_hash"]).groupBy("_key", "_hash", "_label").agg(F.first("_text").alias("_text")).select(
        "_key", "_text", "_label"
    )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on the sample. Its size is bounded, so one task holds it; only the score of each
    table row comes back."""

    def trained(batches):
        rows = [r for batch in batches for r in zip(*batch.to_pydict().values())]
        rows.sort(key=lambda r: (r[2], str(r[0]), r[1] or ""))
        model = train([r[1] or "" for r in rows], [int(r[2]) for r in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.scores.tobytes()]), pa.array([model.bias]), pa.array([model.trained])],
            ["scores", "bias", "trained"],
        )

    rows = training_rows(docs, labels, key, text, label).repartition(1)
    found = rows.mapInArrow(trained, "scores binary, bias double, trained boolean").first()
    if found is None:
        return Model(np.zeros(ROWS), 0.0, False)
    return Model(np.frombuffer(found.scores, np.float32), found.bias, found.trained)


def add_score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """The rows with the probability of class 1; a column named like it is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(output)
    at = df.columns.index(text)

    def scored(batches):
        own = shared.value
        known: dict[str, tuple[float, int]] = {}
        for batch in bounded(batches, at):
            words = Words(plain_texts(batch.column(at)))
            if len(known) > KNOWN:
                known.clear()
            names = words.names.to_pylist()
            fresh = [name for name in names if name not in known]
            for i in range(0, len(fresh), AT_A_TIME):
                part = fresh[i : i + AT_A_TIME]
                known.update(zip(part, own.words(part)))
            sums = np.array([known[x] for x in names], float).reshape(len(names), 2)
            begin, end, text_of = passages(words.starts)
            totals = np.concatenate([np.zeros((1, 2)), np.cumsum(sums[words.codes], axis=0)])
            found = totals[end] - totals[begin]
            p = own.probability(found[:, 0], found[:, 1], text_of, len(batch))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p)], [*batch.schema.names, output]
            )

    return df.mapInArrow(scored, T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of ``documents``; learns from ``labels`` that are not held out."""
    found = add_score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )
