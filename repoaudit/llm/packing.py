"""Best-fit packing of token sequences, certified by lower bounds.

Texts become token ids and one closing id. A document longer than a sequence is cut into
whole sequences and a rest. Whole sequences are full as they are; the rests are packed.

Packing. Rests are dealt over partitions of bounded size by a hash of their row and
piece, so equal keys are spread like others. Each task packs its partition by best-fit decreasing and computes lower bounds on the number of
sequences it needs from dual-feasible functions: functions of a size such that sizes that fit
together never sum to more than one. When the number of sequences equals the largest bound,
the partition is certified: no packing of its documents is better. The other partitions have
a gap. They keep their full sequences and give up the others, whose documents are dealt anew over fewer
partitions, so documents that did not fit well meet others, and best-fit decreasing runs again.
After ``ROUNDS`` rounds, or when no gap is left, what is packed stays.

A task holds one partition of sizes (about ``PART`` of them), whatever the table. The driver
sees one row of counts per round. Sequence numbers are unique: partition and round give the
upper digits.

Null and empty texts have the closing id alone. Repeated keys are separate documents, told
apart by their row number within the batch's task. Ties in size go by a hash of the key. An
empty table gives an empty one. Columns other than key and text are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repoaudit.llm.common import bounded, plain_texts, ragged
from repoaudit.llm.wordbpe import TOKENIZER, load
from repoaudit.session import freeze

#: Tokens of a sequence, and the id that closes a document.
CAPACITY, CLOSING = 2048, 0
#: Rests per partition, about; rounds of exchange.
PART, ROUNDS = 20_000, 3


def pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """``(key, row, piece, start, length, ids_crc32)`` per piece of a document, and its ``ids``
    where asked for. ``row`` tells repeated keys apart."""
    kind = docs.schema[key].dataType.simpleString()
    ids = ", ids array<bigint>" if with_ids else ""
    schema = f"_key {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint{ids}"

    def cut(batches):
        model = load(tokenizer)
        for batch in bounded(batches, 2):
            flat, bounds = model.texts(plain_texts(batch.column(2)), CLOSING)
            number = -(-np.diff(bounds) // capacity)  # pieces of each text
            at = np.repeat(np.arange(len(batch)), number)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            begin = bounds[at] + piece * capacity
            end = np.minimum(begin + capacity, bounds[at + 1])
            data = memoryview(flat.astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
            columns = [
                batch.column(0).take(pa.array(at)),
                batch.column(1).take(pa.array(at)),
                pa.array(piece, pa.int32()),
                pa.array(piece * capacity, pa.int64()),
                pa.array(end - begin, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["_key", "row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(ragged(flat.astype(np.int64), end - begin))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("_text"))
    return rows.mapInArrow(cut, schema).withColumnRenamed("_key", key)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each size and the free room of each bin.

    Bins are kept by their free room, so the fullest bin with enough room is found by looking
    up the next room in use.
    """
    where = np.zeros(len(sizes), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # a bit for each room in use
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        enough = used >> size
        if enough:
            room = size + ((enough & -enough).bit_length() - 1)
            at = by_room[room].pop()
            if not by_room[room]:
                used ^= 1 << room
        else:
            room, at = capacity, len(free)
            free.append(capacity)
        where[i] = at
        free[at] = room - size
        by_room[room - size].append(at)
        used |= 1 << (room - size)
    return where, np.array(free, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound from three families of dual-feasible functions.

    The volume; sizes above capacity less t count whole and those below t not at all, for
    every t up to half; and sizes rounded to multiples of 1/k in the usual way, for small k.
    """
    if not len(sizes):
        return 0
    number = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((number * size).sum()) // capacity)
    words = np.cumsum(number * size)
    count = np.cumsum(number)
    for t in range(1, capacity // 2 + 1):
        large = int(count[-1] - count[capacity - t])
        middle = int(words[capacity - t] - words[t - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(2, 20):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((number * value).sum()) // (k * capacity)))
    return best


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """Pack one partition; ``gap`` is how many sequences it has above its bound."""
    rows = rows.sort_values(["length", "tie", "row"], ascending=[False, True, True], kind="stable")
    sizes = rows["length"].to_numpy()
    where, free = best_fit(sizes)
    gap = len(free) - lower_bound(sizes)
    before = np.zeros(len(rows), np.int64)
    order = np.argsort(where, kind="stable")
    total = np.cumsum(sizes[order])
    first = np.searchsorted(where[order], where[order])
    before[order] = total - sizes[order] - (total[first] - sizes[order][first])
    return rows.assign(bin=where, offset=before, free=free[where], gap=gap)


def pack_rests(rests: DataFrame) -> DataFrame:
    """``(row, piece, sequence_id, offset)`` for rests ``(row, piece, length, tie)``."""
    schema = "row bigint, piece int, length bigint, tie bigint, part bigint, bin bigint, offset bigint, free bigint, gap bigint"
    done, open_rows, shift = [], rests, 0
    for turn in range(ROUNDS + 1):
        n = open_rows.count()
        if n == 0 and done:
            break
        parts = max(1, -(-n // PART))
        dealt = open_rows.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(parts)))
        packed = freeze(dealt.groupBy("part").applyInPandas(_pack, schema))
        last = turn == ROUNDS or parts == 1
        numbered = packed.withColumn("sequence_id", (F.col("part") + F.lit(shift)) * F.lit(1 << 20) + F.col("bin"))
        result = ["row", "piece", "sequence_id", "offset"]
        if last:
            done.append(numbered.select(*result))
            break
        loose = freeze(packed.where("gap > 0 AND free > 0"))
        kept = numbered.where("NOT (gap > 0 AND free > 0)")
        done.append(kept.select(*result))
        open_rows = loose.select("row", "piece", "length", "tie")
        shift += parts
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, with_ids: bool = False
) -> DataFrame:
    """Every piece with its place: ``(key, piece, start, length, ids_crc32, sequence_id, offset)``."""
    cut = freeze(
        pieces(docs, key, text, tokenizer, with_ids=with_ids).withColumn("_own", F.monotonically_increasing_id())
    )
    rests = cut.where(F.col("length") < CAPACITY).select(
        "row", "piece", "length", F.xxhash64(F.col(key).cast("string"), "piece").alias("tie")
    )
    placed = pack_rests(rests)
    joined = cut.join(placed, ["row", "piece"], "left")
    # A full piece is a sequence of its own, numbered below zero.
    own = -F.col("_own") - 1
    return joined.select(
        key,
        "row",
        "piece",
        "start",
        "length",
        "ids_crc32",
        *["ids"] * with_ids,
        F.coalesce("sequence_id", own).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).alias("offset"),
    )


def packing_digest(docs: DataFrame) -> DataFrame:
    """All pieces of ``documents`` with their places."""
    return pack(docs).drop("row")
