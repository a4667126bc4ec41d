"""Alignment of two tokenizers, and how often their tokens meet in a corpus.

Each text is encoded twice: with a space in front by a byte-level BPE (side A), and as it is by a
sentence-piece model (side B), which adds the space. Where the bytes of both rows of tokens spell
the text, offsets at which tokens of both end cut them into groups, and tokens whose bytes overlap
are linked. A pair of ids counts once for each document that holds it linked.

Counting is external and spills runs:

1. Runs. A task gathers records (pair, document, times) until it has ``RUN`` links, sorts them
   and writes a run: one row per radix of the A id, with compressed blocks of the run's pairs and
   their counts, and of the documents and times of each pair. The A id is the major part of the order.
   Runs are zstd blocks in the rows of a checkpoint, so they outlive any executor.
2. Counts. For each radix, up to about ``FAN`` runs are merged by a heap of blocks into a longer run of pairs
   with summed counts, and those again, until one is left. Only pairs travel here, each once per run.
   As the order is by A id, the highest count of an id is known when the merge leaves the id.
3. Contributions. About ``FAN`` runs of one radix meet the counts of that radix, and both are read in the same
   order. What each document gets from this radix goes back to its run.
4. Documents. A run's documents and its contributions of all radixes are put together.

A frequent id is in one radix, but in as many runs as it fills, which are dealt over tasks by
``FAN``; only its distinct pairs are ever in one task. A task's memory is bounded by
``RUN`` links, ``DOCS`` documents, ``FAN`` compressed runs of a radix, or one longer text.

Null and empty texts, and texts that the tokens of a side do not spell exactly, have no tokens: all
numbers are zero and the groups are an empty text. Strings of special tokens are plain text. Rows are
told apart by run and place, so null and repeated keys stay rows of their own, and each counts as a
document. Columns other than key and text are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from repoaudit.llm.common import bounded, plain_texts
from repoaudit.session import freeze

SIDE_A, SIDE_B = "byte_bpe_50k", "piece_bpe_32k.model"
#: Bytes of text aligned at once; links and documents of a run.
AT_ONCE, RUN, DOCS = 1 << 20, 1 << 21, 1 << 16
#: Radixes of the A id as a power of two, runs merged in a task, about, and entries of a block.
RADIX_BITS, FAN, BLOCK = 5, 128, 1 << 14


class Side:
    """One tokenizer: ``encode`` gives ids; token i spells ``data[starts[i]:starts[i + 1]]``."""

    def __init__(self, spellings: list[bytes], encode):
        self.encode = encode
        self.lengths = np.array([len(s) for s in spellings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(spellings), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens in a row."""
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.data[np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))]


@functools.cache
def sides(name_a: str = SIDE_A, name_b: str = SIDE_B) -> tuple[Side, Side]:
    """Both tokenizers, once per Python worker. The ranks of A's vocabulary are its ids."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    def path(name: str) -> str:
        return name if os.path.isabs(name) else public_tokenizers.path(name)

    with open(path(f"{name_a}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spell_a = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spell_a[rank] = token
    b = sentencepiece.SentencePieceProcessor(model_file=path(name_b))
    spell_b = [
        bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.get_piece_size())
    ]
    return (
        Side(spell_a, lambda texts: [a.encode_ordinary(" " + t) for t in texts]),
        Side(spell_b, lambda texts: b.encode(texts, num_threads=1)),
    )


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in lists], np.int64)
    return np.array([i for x in lists for i in x], np.int64), lengths


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


class Aligned:
    """The alignment of a batch of texts.

    ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` are per text, zero where there are no tokens;
    ``link_a`` and ``link_b`` have the ids of each link, text by text.
    """

    def __init__(self, texts: list[str], a: Side, b: Side):
        found = np.array([bool(t) for t in texts], bool)
        n = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        some = [t for t in texts if t]
        spelled = [b" " + t.encode() for t in some]
        sizes = np.array([len(s) for s in spelled], np.int64)
        ids_a, n_a = _flat(a.encode(some))
        ids_b, n_b = _flat(b.encode(some))
        right = (_sums(a.lengths[ids_a], n_a) == sizes) & (_sums(b.lengths[ids_b], n_b) == sizes)
        for side, ids, lengths in ((a, ids_a, n_a), (b, ids_b, n_b)):
            # Texts of the right length are compared byte by byte.
            want = np.frombuffer(b"".join([s for s, ok in zip(spelled, right) if ok]), np.uint8)
            wrong = side.spelled(ids[np.repeat(right, lengths)]) != want
            right[right] = _sums(wrong, sizes[right]) == 0
        self.ids_a, self.ids_b = ids_a[np.repeat(right, n_a)], ids_b[np.repeat(right, n_b)]
        self.at = np.flatnonzero(found)[right]  # texts with tokens
        n_a, n_b, sizes = n_a[right], n_b[right], sizes[right]
        total = int(sizes.sum())
        ends_a, ends_b = np.zeros(total, bool), np.zeros(total, bool)
        last_a, last_b = np.cumsum(a.lengths[self.ids_a]) - 1, np.cumsum(b.lengths[self.ids_b]) - 1
        ends_a[last_a], ends_b[last_b] = True, True
        common = ends_a & ends_b
        cuts = np.flatnonzero(ends_a | ends_b)
        # Each stretch between two cuts is one link, of the tokens that cover it.
        self.link_a = self.ids_a[(np.cumsum(ends_a) - ends_a)[cuts]]
        self.link_b = self.ids_b[(np.cumsum(ends_b) - ends_b)[cuts]]
        groups = np.cumsum(common) - common
        self.group_a, self.group_b = groups[last_a], groups[last_b]
        self.n_a[self.at], self.n_b[self.at] = n_a, n_b
        self.n_groups[self.at] = _sums(common, sizes)
        self.n_links[self.at] = _sums(ends_a | ends_b, sizes)

    def groups(self) -> list[memoryview]:
        """``a1,a2|b1;a3|b2,b3`` per text: the ids of each group in decimal, A's before B's."""
        n = len(self.ids_a) + len(self.ids_b)
        number = int(self.n_groups.sum())
        upto_a = np.cumsum(np.bincount(self.group_a, minlength=number))
        upto_b = np.cumsum(np.bincount(self.group_b, minlength=number))
        place_a = np.arange(len(self.ids_a)) + np.concatenate([[0], upto_b])[self.group_a]
        place_b = np.arange(len(self.ids_b)) + upto_a[self.group_b]
        ids, signs = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        signs[place_a[upto_a - 1]] = ord("|")
        signs[place_b[upto_b - 1]] = ord(";")
        tokens = self.n_a + self.n_b
        digits, lengths = _decimals()
        length = lengths[ids]
        block = digits[ids]
        block[np.arange(n), length] = signs
        flat = memoryview(block[np.arange(block.shape[1]) <= length[:, None]])
        sizes = _sums(length + 1, tokens)
        ends = np.cumsum(sizes)
        return [flat[end - size : max(end - 1, end - size)] for end, size in zip(ends.tolist(), sizes.tolist())]


@functools.cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids, one row each with a free place, and how many there are."""
    words = [b"%d" % i for i in range(1 << 17)]
    table = np.array(words, "S7").view(np.uint8).reshape(len(words), 7)
    return table, np.array([len(w) for w in words], np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers as compressed blocks of ``BLOCK`` rows, each with its size in front."""
    press = zstandard.ZstdCompressor(level=1)
    out = []
    for at in range(0, len(columns[0]), BLOCK):
        parts = []
        for column in columns:
            part = column[at : at + BLOCK].astype(np.uint32)
            part = np.diff(part, prepend=np.uint32(0))  # wraps around
            parts.append(part.view(np.uint8).reshape(-1, 4).T.tobytes())  # like bytes together
        block = press.compress(b"".join(parts))
        out.append(len(block).to_bytes(4, "little") + block)
    return b"".join(out)


def _blocks(packed, columns: int):
    """The blocks of ``_pack`` again, one at a time."""
    view, at = memoryview(packed), 0
    unpress = zstandard.ZstdDecompressor()
    while at < len(view):
        size = int.from_bytes(view[at : at + 4], "little")
        raw = np.frombuffer(unpress.decompress(view[at + 4 : at + 4 + size]), np.uint8)
        planes = raw.reshape(columns, 4, -1)
        yield [np.cumsum(np.ascontiguousarray(p.T).view(np.uint32).ravel(), dtype=np.uint32) for p in planes]
        at += 4 + size


def _unpack(packed, columns: int) -> list[np.ndarray]:
    parts = list(_blocks(packed, columns))
    return [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.uint32) for c in range(columns)]


def _halves(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return count & 0xFFFFFFFF, count >> 32


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 32


def merge_runs(runs):
    """Merge runs of ``(pair, low, high)``, each in order, into blocks ``(pair, count)``, in order.

    A count goes as two numbers of 32 bits, since many documents may share a pair.

    A heap holds the last pair of the block that each run stands at. Everything up to the least
    of them is complete: no run can bring it later.
    """
    readers = [_blocks(r, 3) for r in runs]
    at: list = [next(r, None) for r in readers]
    heap = [(int(block[0][-1]), k) for k, block in enumerate(at) if block is not None]
    heapq.heapify(heap)
    while heap:
        upto = heap[0][0]
        keys, counts = [], []
        for k, block in enumerate(at):
            if block is None:
                continue
            n = int(np.searchsorted(block[0], upto, side="right"))
            keys.append(block[0][:n])
            counts.append(_whole(block[1][:n], block[2][:n]))
            at[k] = [column[n:] for column in block]
        while heap and heap[0][0] == upto:
            _, k = heapq.heappop(heap)
            at[k] = next(readers[k], None)
            if at[k] is not None:
                heapq.heappush(heap, (int(at[k][0][-1]), k))
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=np.uint32(~key[0] if len(key) else 0)))
        yield key[first], np.add.reduceat(count, first)


def with_best(blocks, shift: int):
    """Add to merged blocks whether a count is the highest of its A id, which is the pair without
    its lower ``shift`` bits. The last id of a block waits for the next one."""
    held = (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def judged(key, count):
        first = np.flatnonzero(np.diff(key >> np.uint32(shift), prepend=~(key[:1] >> np.uint32(shift))))
        most = np.maximum.reduceat(count, first)
        return key, count, count == np.repeat(most, np.diff(first, append=len(key)))

    for key, count in blocks:
        key, count = np.concatenate([held[0], key]), np.concatenate([held[1], count])
        own = key >> np.uint32(shift)
        n = int(np.searchsorted(own, own[-1]))
        held = key[n:], count[n:]
        if n:
            yield judged(key[:n], count[:n])
    if len(held[0]):
        yield judged(*held)


class _Order:
    """Pairs as 32-bit numbers: radix of the A id, the rest of it, B id, from the upper bits down."""

    def __init__(self, a: Side, b: Side):
        self.bits_a, self.bits_b = (max(1, int(len(s.lengths) - 1).bit_length()) for s in (a, b))
        if self.bits_a + self.bits_b > 32 or self.bits_a < RADIX_BITS:
            raise ValueError("the vocabularies are too large for pairs of 32 bits")

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        radix, rest = a & ((1 << RADIX_BITS) - 1), a >> RADIX_BITS
        return ((radix << (self.bits_a - RADIX_BITS) | rest) << self.bits_b) | b

    def radix_shift(self) -> int:
        return self.bits_a + self.bits_b - RADIX_BITS


_RUNS = pa.schema(
    [("_run", pa.int64()), ("_at", pa.int64()), ("_n", pa.int64()), ("_radix", pa.int32()), ("_pairs", pa.binary()), ("_docs", pa.binary())]
)
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _write_runs(key_type: str, name_a: str, name_b: str):
    """The rows of a task's runs: a row per document, then a row per radix."""

    def run_rows(run: int, links: list[np.ndarray], documents: int, key_field: pa.Field):
        a, b = sides(name_a, name_b)
        shift = _Order(a, b).radix_shift()
        record = np.concatenate([np.zeros(0, np.int64), *links])
        record.sort()
        first = np.flatnonzero(np.diff(record, prepend=-1))
        times = np.diff(first, append=len(record))
        record = record[first]
        pair, at = record >> 24, record & ((1 << 24) - 1)
        bounds = np.searchsorted(pair >> shift, np.arange((1 << RADIX_BITS) + 1))
        rows = []
        for radix in range(1 << RADIX_BITS):
            low, high = int(bounds[radix]), int(bounds[radix + 1])
            if low < high:
                own = pair[low:high]
                begin = np.flatnonzero(np.diff(own, prepend=-1))
                rows.append((radix, _pack(own[begin], *_halves(np.diff(begin, append=len(own)))), _pack(at[low:high], times[low:high])))
        n = len(rows)
        radixes, pairs, docs = zip(*rows) if rows else ((), (), ())
        numbers = [pa.array([run] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([documents] * n, pa.int64())]
        blobs = [pa.array(radixes, pa.int32()), pa.array(pairs, pa.binary()), pa.array(docs, pa.binary())]
        empty = [pa.nulls(n, key_field.type), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays([*numbers, *blobs, *empty], [*_RUNS.names, "_key", *_NUMBERS, "groups_sha256"])

    def write(batches):
        from pyspark import TaskContext

        a, b = sides(name_a, name_b)
        order = _Order(a, b)
        run = TaskContext.get().partitionId() << 32
        links: list[np.ndarray] = []
        size = documents = 0
        field = None
        for batch in bounded(batches, 1, AT_ONCE):
            n, field = len(batch), batch.schema.field(0)
            if documents and documents + n > DOCS:
                yield run_rows(run, links, documents, field)
                run, links, size, documents = run + 1, [], 0, 0
            found = Aligned(plain_texts(batch.column(1)).to_pylist(), a, b)
            hashes = [hashlib.sha256(g).hexdigest() if k else "" for g, k in zip(found.groups(), found.n_a)]
            pairs = order.pairs(found.link_a, found.link_b)
            links.append(pairs << 24 | np.repeat(np.arange(documents, documents + n), found.n_links))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([run] * n, pa.int64()),
                    pa.array(range(documents, documents + n), pa.int64()),
                    *[pa.nulls(n, t) for t in _RUNS.types[2:]],
                    batch.column(0),
                    *[pa.array(getattr(found, c)) for c in _NUMBERS],
                    pa.array(hashes, pa.string()),
                ],
                [*_RUNS.names, "_key", *_NUMBERS, "groups_sha256"],
            )
            size, documents = size + len(pairs), documents + n
            if size >= RUN:
                yield run_rows(run, links, documents, field)
                run, links, size, documents = run + 1, [], 0, 0
        if documents:
            yield run_rows(run, links, documents, field)

    schema = "_run bigint, _at bigint, _n bigint, _radix int, _pairs binary, _docs binary, "
    return write, f"{schema}_key {key_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _counts(runs: DataFrame, n_runs: int, name_a: str, name_b: str) -> DataFrame:
    """``(_radix, _blocks)``: pairs, counts and whether a count is its A id's highest, per radix."""

    def merge(last: bool):
        def merged(table: pa.Table) -> pa.Table:
            radix = table.column("_radix")[0]
            blocks = merge_runs([x.as_buffer() for x in table.column("_pairs")])
            if last:
                blocks = with_best(blocks, _Order(*sides(name_a, name_b)).bits_b)
            packed = b"".join(_pack(b[0], *_halves(b[1]), *b[2:]) for b in blocks)
            return pa.table({"_radix": pa.array([radix.as_py()], pa.int32()), "_pairs": pa.array([packed], pa.binary())})

        return merged

    runs, n, turn = runs.select("_radix", "_pairs"), n_runs, 0
    while True:
        groups = max(1, -(-n // FAN))
        share = F.floor(F.rand(turn) * groups) if groups > 1 else F.lit(0)
        runs = runs.withColumn("_share", share).groupBy("_radix", "_share").applyInArrow(
            merge(groups == 1), "_radix int, _pairs binary"
        )
        if groups == 1:
            return runs
        runs, n, turn = freeze(runs), groups, turn + 1


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """Per row ``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    ``n_best`` is the number of links whose count is the highest of their A id in all rows, and
    ``count_sum`` the sum of the counts of all links.
    """
    key_type = docs.schema[key].dataType.simpleString()
    write, schema = _write_runs(key_type, side_a, side_b)
    rows = freeze(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(write, schema))
    documents, runs = rows.where("_at IS NOT NULL"), rows.where("_at IS NULL")
    n_runs = runs.select("_run").distinct().count()
    counts = _counts(runs, n_runs, side_a, side_b)
    salts = max(1, -(-n_runs // FAN))
    salted = runs.select("_radix", F.pmod(F.xxhash64("_run"), F.lit(salts)).alias("_salt"), "_run", "_n", "_pairs", "_docs")
    copies = counts.select(
        "_radix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt"), F.col("_pairs").alias("_counts")
    )
    given = salted.groupBy("_radix", "_salt").cogroup(copies.groupBy("_radix", "_salt")).applyInArrow(
        _contributions, "_run bigint, _given binary"
    )
    result = documents.select("_run", "_at", "_key", *_NUMBERS, "groups_sha256")
    return (
        result.groupBy("_run")
        .cogroup(given.groupBy("_run"))
        .applyInArrow(
            _documents,
            f"_key {key_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        )
        .withColumnRenamed("_key", key)
    )


def _contributions(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What each document of these runs gets from the pairs of one radix."""
    opened = []
    for run in runs.select(["_run", "_n", "_pairs", "_docs"]).to_pylist():
        pair, *holders = _unpack(run["_pairs"], 3)
        at, times = _unpack(run["_docs"], 2)
        bounds = np.concatenate([[0], np.cumsum(_whole(*holders))])
        opened.append([run["_run"], pair, bounds, at, times.astype(np.int64), np.zeros((2, run["_n"]), np.int64), 0])
    for packed in counts.column("_counts"):
        for key, low, high, best in _blocks(packed.as_buffer(), 4):
            count = _whole(low, high)
            for state in opened:
                _, pair, bounds, at, times, sums, done = state
                upto = int(np.searchsorted(pair, key[-1], side="right"))
                if upto > done:
                    found = np.repeat(np.searchsorted(key, pair[done:upto]), np.diff(bounds[done : upto + 1]))
                    stretch = slice(int(bounds[done]), int(bounds[upto]))
                    np.add.at(sums[0], at[stretch], times[stretch] * best[found])
                    np.add.at(sums[1], at[stretch], times[stretch] * count[found])
                    state[6] = upto
    packed = [zstandard.compress(sums.tobytes(), 1) for *_, sums, _ in opened]
    return pa.table({"_run": pa.array([s[0] for s in opened], pa.int64()), "_given": pa.array(packed, pa.binary())})


def _documents(documents: pa.Table, given: pa.Table) -> pa.Table:
    """The documents of a run with the sums of what all radixes gave."""
    sums = np.zeros((2, len(documents)), np.int64)
    for packed in given.column("_given"):
        sums += np.frombuffer(zstandard.decompress(packed.as_buffer()), np.int64).reshape(2, -1)
    at = documents.column("_at").to_numpy()
    names = ["_key", *_NUMBERS, "groups_sha256"]
    columns = {c: documents.column(c) for c in names}
    columns |= {"n_best": pa.array(sums[0][at]), "count_sum": pa.array(sums[1][at])}
    return pa.table({c: columns[c] for c in ["_key", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]})


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """``(key, groups)``: the groups of each text, as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    key_type = docs.schema[key].dataType.simpleString()

    def write(batches):
        a, b = sides(side_a, side_b)
        for batch in bounded(batches, 1, AT_ONCE):
            found = Aligned(plain_texts(batch.column(1)).to_pylist(), a, b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bytes(g).decode() for g in found.groups()], pa.string())], ["_key", "groups"]
            )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(write, f"_key {key_type}, groups string").withColumnRenamed("_key", key)


def align_digest(docs: DataFrame) -> DataFrame:
    """All documents with their numbers of tokens, groups and links."""
    return link_counts(docs)
