"""Fill-in-the-middle: texts cut in prefix, middle and suffix and put in another order.

Where to cut. A text has n units (code points, words or lines) and n + 1 boundaries. Two draws from a
hash of the seed and the key choose two of them, so reruns agree and no other row matters. A
boundary's place in the bytes of the text is looked up in a learned index over all boundaries of a
batch of texts: segments of straight lines predict the byte offset of a boundary from its rank, each
within ``ERROR`` bytes, and the difference of every boundary is kept in one byte. A cut is the line's
value at its rank plus the kept difference, hence exact. Fitting goes from left to right: from its
first boundary a segment goes on as long as the slopes that keep every boundary within ``ERROR`` have
one in common; numpy narrows them for whole stretches at once. The index has one byte per boundary
and few segments, and a text longer than ``STRETCH`` bytes is indexed stretch by stretch, so memory
stays in proportion to one batch of ``common.AT_ONCE`` bytes, or one longer text.

Forms. ``plain`` texts stay as they are: empty ones, those that hold a sentinel, and a share drawn by
the hash. The others become ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), with
a sentinel before each part. ``restore`` undoes it: no sentinel is in the text, and none can arise
where a part meets a sentinel, since the first character of a sentinel is at no later place of any.

Null texts count as empty, null keys are hashed as the empty string, and rows with equal keys get
equal draws. All columns are kept; a column with the name of a new one is replaced. An empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from repoaudit.llm.common import bounded, plain_texts

#: Seed of the draws, percentages, and sentinels of prefix, suffix and middle.
SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20
SENTINELS = ("<P>", "<S>", "<M>")
#: Largest difference between a line and a boundary, in bytes; bytes indexed at once.
ERROR, STRETCH = 127, 1 << 20

NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


class RankIndex:
    """Byte offsets by rank, as segments of straight lines and one byte per rank.

    ``add`` takes offsets in ascending order, any number at a time; ``lookup`` gives back the
    offsets of ranks, exactly.
    """

    def __init__(self, error: int = ERROR):
        self.error = error
        self.firsts: list[int] = []  # first rank of each segment
        self.begins: list[int] = []  # its offset
        self.slopes: list[float] = []
        self.rests: list[np.ndarray] = []
        self.size = 0

    def add(self, offsets: np.ndarray) -> None:
        offsets = offsets.astype(np.int64)
        at = 0
        while at < len(offsets):
            length, slope = self._segment(offsets[at:])
            own = offsets[at : at + length]
            self.firsts.append(self.size + at)
            self.begins.append(int(own[0]))
            self.slopes.append(slope)
            line = np.floor(slope * np.arange(length)).astype(np.int64) + own[0]
            self.rests.append((own - line).astype(np.int8))
            at += length
        self.size += len(offsets)

    def _segment(self, offsets: np.ndarray) -> tuple[int, float]:
        """The longest stretch from the first offset that one line keeps within the error."""
        low, high = 0.0, np.inf
        at, width = 1, 64
        room = self.error - 1  # the line's value is rounded down
        while at < len(offsets):
            rise = offsets[at : at + width] - offsets[0]
            run = np.arange(at, at + len(rise))
            lows = np.maximum.accumulate(np.maximum((rise - room) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + room) / run, high))
            broken = np.flatnonzero(lows > highs)
            if len(broken):
                k = int(broken[0])
                if k:
                    low, high = float(lows[k - 1]), float(highs[k - 1])
                return at + k, self._middle(low, high)
            low, high = float(lows[-1]), float(highs[-1])
            at += len(rise)
            width *= 2
        return len(offsets), self._middle(low, high)

    @staticmethod
    def _middle(low: float, high: float) -> float:
        return low if np.isinf(high) else (low + high) / 2

    def lookup(self, ranks: np.ndarray) -> np.ndarray:
        if not len(ranks):
            return np.zeros(0, np.int64)
        self.rests = [np.concatenate(self.rests)]
        firsts, begins, slopes = np.array(self.firsts), np.array(self.begins), np.array(self.slopes)
        at = np.searchsorted(firsts, ranks, side="right") - 1
        line = np.floor(slopes[at] * (ranks - firsts[at])).astype(np.int64) + begins[at]
        return line + self.rests[0][ranks]


def _unit_starts(data: np.ndarray, before: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit, given the byte before each (a line break before the first)."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    if unit == "line":
        return before == 0x0A
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    space_before = (before == 0x20) | ((before >= 0x09) & (before <= 0x0D))
    return ~space & space_before


class Boundaries:
    """The boundaries of all units in a batch of texts: their number per text, and the index.

    Text i has boundaries 0 to ``units[i]``: its start, the start of each unit but the first,
    and its end. What stands before its first unit belongs to that unit.
    """

    def __init__(self, texts: pa.Array, unit: str):
        _, offsets, data = texts.buffers()
        self.offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.index = RankIndex()
        self.starts = np.zeros(len(self.offsets), np.int64)  # starts[i]: number of unit starts before text i
        texts_seen, count = 0, 0
        begins = np.unique(self.offsets[:-1][np.diff(self.offsets) > 0])  # of texts that are not empty
        for at in range(first, last, STRETCH):
            part = self.data[at : min(at + STRETCH, last)]
            before = np.empty(len(part), np.uint8)
            before[1:], before[0] = part[:-1], self.data[at - 1] if at else 0x0A
            fresh = begins[(begins >= at) & (begins < at + len(part))] - at
            before[fresh] = 0x0A  # a text begins as if after a line break
            here = np.flatnonzero(_unit_starts(part, before, unit))
            upto = int(np.searchsorted(self.offsets, at + len(part), side="left"))
            self.starts[texts_seen:upto] = count + np.searchsorted(here, self.offsets[texts_seen:upto] - at)
            texts_seen, count = upto, count + len(here)
            self.index.add(here + at)
        self.starts[texts_seen:] = count
        self.units = np.diff(self.starts)

    def byte_of(self, text: np.ndarray, boundary: np.ndarray) -> np.ndarray:
        """Where a boundary of each text is in the bytes."""
        places = np.where(boundary == 0, self.offsets[text], self.offsets[text + 1])
        inner = (boundary > 0) & (boundary < self.units[text])
        places[inner] = self.index.lookup((self.starts[text] + boundary)[inner])
        return places


def _draw(key: Column, seed: int, at: int) -> Column:
    """One of the numbers of 32 bits in the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("bigint")


def _share(key: Column, seed: int, at: int) -> Column:
    return _draw(key, seed, at) % 100


def transform(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = "char",
    seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (units; null if plain) and
    ``output``. ``unit`` is ``char``, ``word`` or ``line``."""
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unit is char, word or line, not {unit!r}")
    firsts = {s[:1] for s in sentinels}
    if "" in firsts or len(set(sentinels)) < 3 or any(c in firsts for s in sentinels for c in s[1:]) or any(
        a != b and a.startswith(b) for a in sentinels for b in sentinels
    ):
        raise ValueError("sentinels differ, and none begins with another or holds a first character further on")
    kept = [c for c in docs.columns if c not in NEW]
    whole = F.coalesce(F.col(text), F.lit(""))
    held = F.lit(False)
    for sentinel in sentinels:
        held = held | F.contains(whole, F.lit(sentinel))
    plain = (whole == "") | held | (_share(F.col(key), seed, 2) >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_share(F.col(key), seed, 3) < spm_percent, "spm").otherwise("psm")
    draws = F.struct(
        whole.alias("text"),
        form.alias("form"),
        _draw(F.col(key), seed, 0).alias("h1"),
        _draw(F.col(key), seed, 1).alias("h2"),
    ).alias("_draws")
    schema = StructType([docs.schema[c] for c in kept])
    for name, kind in zip(NEW, (LongType(), StringType(), LongType(), LongType(), StringType())):
        schema = schema.add(name, kind)
    before_prefix, before_suffix, before_middle = (s.encode() for s in sentinels)

    def cut(batches):
        for whole_batch in batches:
            inner = whole_batch.column(len(kept))
            flat = pa.RecordBatch.from_arrays([*whole_batch.columns[:-1], *inner.flatten()], [*kept, "0", "1", "2", "3"])
            for batch in bounded([flat], len(kept)):
                yield one(batch)

    def one(batch):
        texts = plain_texts(batch.column(len(kept)))
        forms = np.array(batch.column(len(kept) + 1).to_pylist(), object)
        h1, h2 = (batch.column(len(kept) + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
        found = Boundaries(texts, unit)
        cuts = np.sort(np.stack([h1 % (found.units + 1), h2 % (found.units + 1)]), axis=0)
        rows = np.arange(len(texts))
        first, second = found.byte_of(rows, cuts[0]), found.byte_of(rows, cuts[1])
        data = memoryview(found.data)
        outputs = []
        for i, form in enumerate(forms):
            a, b = found.offsets[i], found.offsets[i + 1]
            if form == "plain":
                outputs.append(bytes(data[a:b]))
                continue
            prefix, middle, suffix = data[a : first[i]], data[first[i] : second[i]], data[second[i] : b]
            if form == "psm":
                parts = before_prefix, prefix, before_suffix, suffix, before_middle, middle
            else:
                parts = before_suffix, suffix, before_prefix, prefix, before_middle, middle
            outputs.append(b"".join(parts))
        is_plain = forms == "plain"
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[: len(kept)],
                pa.array(found.units, pa.int64()),
                batch.column(len(kept) + 1),
                pa.array(cuts[0], pa.int64(), mask=is_plain),
                pa.array(cuts[1] - cuts[0], pa.int64(), mask=is_plain),
                pa.array(outputs, pa.binary()).view(pa.string()),
            ],
            [*kept, *NEW],
        )

    return docs.select(*kept, draws).mapInArrow(cut, schema)


def restore(
    changed: DataFrame, output: str = "output", form: str = "form", into: str = "restored", sentinels=SENTINELS
) -> DataFrame:
    """Add the text that an output was made from, from output and form alone."""
    out = F.col(output)
    places = [F.locate(s, out) for s in sentinels]
    prefix_at, suffix_at, middle_at = (p + len(s) for p, s in zip(places, sentinels))

    def part(begin: Column, end: Column | None) -> Column:
        return F.substr(out, begin) if end is None else F.substr(out, begin, end - begin)

    psm = F.concat(part(prefix_at, places[1]), part(middle_at, None), part(suffix_at, places[2]))
    spm = F.concat(part(prefix_at, places[2]), part(middle_at, None), part(suffix_at, places[0]))
    return changed.withColumn(into, F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm))


def fim_digest(docs: DataFrame) -> DataFrame:
    """Per document: units, form, lengths, and hashes of the output and of the text rebuilt."""
    changed = restore(transform(docs.select("doc_id", "text")))
    return changed.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
