"""BPE encoding and decoding of whole texts, long ones as trees of pieces.

Encoding. A text of at most ``leaf`` characters is encoded where it is. A longer one becomes the
leaves of a tree, which are dealt over all tasks and encoded there:

- where there is white space, leaves end at it, and the tokens on both sides stand as they are;
- a run of more than ``leaf`` characters without any is normalised and split as the tokenizer
  does it, and a part that is still longer is cut in pieces, a piece to a leaf.

Then neighbours are joined, pair by pair up to the root, ``FAN`` leaves in a task of each round. Two
leaves of one part are joined by encoding a window around the cut once more. It begins with
``WINDOW`` tokens of each side, and a side that does not agree doubles its share, until the
window's first token is the left side's token at that place and its last token the right side's, or
the part's own end is reached. Then the left tokens before the window, those of the window and the
right tokens after it are the encoding of both sides together: in byte pair encoding a row of
tokens is the encoding of its text if and only if each two neighbours are the encoding of theirs,
and each pair of neighbours here lies on the left, in the window, or on the right.

A task holds ``FAN`` nodes of one text, and the last round one text's ids, as a row does anyway.

Decoding. The strings of the ids, joined by a space: the tokenizer has no decoder, so this is what
its ``decode(ids, skip_special_tokens=False)`` gives.

Null and empty texts, and texts of white space, have no ids and decode to the empty text; null ids
decode to it, too. Rows are told apart by their own number, so null and repeated keys stay rows of
their own. An empty table gives an empty one. Columns other than key and text are not looked at, and
names of theirs that begin with ``_`` do no harm.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from repoaudit.llm.common import bounded, plain_texts, ragged
from repoaudit.llm.wordbpe import TOKENIZER, WordBPE, load
from repoaudit.session import freeze

#: Characters of a leaf; leaves that a task joins; tokens of each side in the first window.
LEAF, FAN, WINDOW = 16_384, 16, 4

_SPACE = re.compile(r"[\x20\x09-\x0D]")


def stitch(left: np.ndarray, right: np.ndarray, model: WordBPE) -> np.ndarray:
    """The ids of two neighbouring pieces of one part as ids of the whole.

    ``left`` may hold parts before this one and ``right`` parts after it: a part goes up to a token
    that ends one, so windows stop there.
    """
    ends_left = np.flatnonzero(model.ends[left])
    ends_right = np.flatnonzero(model.ends[right])
    most_left = len(left) - (int(ends_left[-1]) + 1 if len(ends_left) else 0)
    most_right = int(ends_right[0]) + 1 if len(ends_right) else len(right)
    i, j = min(WINDOW, most_left), min(WINDOW, most_right)
    while True:
        ids = np.concatenate([left[len(left) - i :], right[:j]])
        text = "".join(model.tokens.take(pa.array(ids.astype(np.int64))).to_pylist())
        at_end = bool(model.ends[ids[-1]])
        merger = model.at_end if at_end else model.within
        text = text.removesuffix("</w>") if at_end else text
        window = np.array(merger.encode(text, add_special_tokens=False).ids, left.dtype)
        left_agrees = i == most_left or window[0] == ids[0]
        right_agrees = j == most_right or window[-1] == ids[-1]
        if left_agrees and right_agrees:
            return np.concatenate([left[: len(left) - i], window, right[j:]])
        if not left_agrees:
            i = min(2 * i, most_left)
        if not right_agrees:
            j = min(2 * j, most_right)


def join_all(nodes: list[np.ndarray], inside: list[bool], model: WordBPE) -> np.ndarray:
    """Join neighbours pair by pair until one is left; ``inside[k]`` says that node k goes on
    within the last part of node k - 1."""
    while len(nodes) > 1:
        joined = []
        for k in range(0, len(nodes) - 1, 2):
            if inside[k + 1] and len(nodes[k]) and len(nodes[k + 1]):
                joined.append(stitch(nodes[k], nodes[k + 1], model))
            else:
                joined.append(np.concatenate([nodes[k], nodes[k + 1]]))
        nodes, inside = joined + nodes[len(joined) * 2 :], inside[::2]
    return nodes[0]


def leaves(text: str, leaf: int, model: WordBPE):
    """``(kind, inside, piece)`` of each leaf of a text: ``text`` to be encoded as such, ``parts``
    that are split already, with a space between them, or a ``piece`` or ``last`` piece of a part."""
    at = 0
    while len(text) - at > leaf:
        cut = max(text.rfind(c, at, at + leaf) for c in " \t\n\v\f\r")
        if cut > at:
            yield "text", False, text[at:cut]
            at = cut
            continue
        if cut == at:  # white space alone, or white space before a long run
            at += 1
            continue
        found = _SPACE.search(text, at + leaf)
        end = found.start() if found else len(text)
        yield from _unsplit(text[at:end], leaf, model)
        at = end
    if at < len(text):
        yield "text", False, text[at:]


def _unsplit(run: str, leaf: int, model: WordBPE):
    """The leaves of a long run without white space."""
    special = "|".join(map(re.escape, model.added))
    for segment in re.split(f"({special})", run) if special else [run]:
        if segment in model.added:
            yield "text", False, segment
            continue
        few: list[str] = []
        size = 0
        normal = model.library.normalizer.normalize_str(segment)
        for part, _ in model.library.pre_tokenizer.pre_tokenize_str(normal):
            if len(part) > leaf or size + len(part) > leaf:
                if few:
                    yield "parts", False, " ".join(few)
                few, size = [], 0
            if len(part) > leaf:
                for k in range(0, len(part), leaf):
                    yield ("last" if k + leaf >= len(part) else "piece"), k > 0, part[k : k + leaf]
            else:
                few.append(part)
                size += len(part)
        if few:
            yield "parts", False, " ".join(few)


def _encode_leaf(kind: str, piece: str, model: WordBPE) -> np.ndarray:
    if kind == "text":
        return model.texts(pa.array([piece]))[0]
    merger = model.within if kind == "piece" else model.at_end
    found = merger.encode_batch_fast(piece.split(" ") if kind == "parts" else [piece], add_special_tokens=False)
    return np.array([i for one in found for i in one.ids], np.uint32)


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, leaf: int = LEAF
) -> DataFrame:
    """``(key, ids)``: the token ids of each text as an ``array<int>``, one row per row."""
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    long = F.coalesce(F.length("_text") > leaf, F.lit(False))

    def encode_short(batches):
        model = load(tokenizer)
        for batch in bounded(batches, 1):
            ids, starts = model.texts(plain_texts(batch.column(1)))
            lists = ragged(ids.astype(np.int32), np.diff(starts))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["_key", "ids"])

    short = rows.where(~long).mapInArrow(encode_short, f"_key {key_type}, ids array<int>")
    numbered = rows.select("_key", F.monotonically_increasing_id().alias("_row"), "_text").where(long)
    nodes = _tree(numbered, key_type, tokenizer, leaf)
    return short.unionByName(nodes.select("_key", "ids")).withColumnRenamed("_key", key)


def _tree(rows: DataFrame, key_type: str, tokenizer: str, leaf: int) -> DataFrame:
    """The ids of long texts ``(_key, _row, _text)``."""

    def cut(batches):
        model = load(tokenizer)
        for batch in bounded(batches, 2):
            for at in range(len(batch)):
                found = list(leaves(batch.column(2)[at].as_py(), leaf, model)) or [("text", False, "")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[at].as_py()] * len(found), batch.schema.field(0).type),
                        pa.array([batch.column(1)[at].as_py()] * len(found), pa.int64()),
                        pa.array(range(len(found)), pa.int64()),
                        *[pa.array([f[c] for f in found], t) for c, t in enumerate((pa.string(), pa.bool_(), pa.string()))],
                    ],
                    ["_key", "_row", "at", "kind", "inside", "piece"],
                )

    def encode_leaves(batches):
        model = load(tokenizer)
        for batch in bounded(batches, 5):
            kinds, pieces = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            found = [_encode_leaf(k, p, model).astype(np.int32) for k, p in zip(kinds, pieces)]
            lists = ragged(np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(f) for f in found], np.int64))
            columns = [batch.column(c) for c in (0, 1, 2, 4)]
            yield pa.RecordBatch.from_arrays([*columns, lists], ["_key", "_row", "at", "inside", "ids"])

    def join_nodes(nodes: pd.DataFrame) -> pd.DataFrame:
        model = load(tokenizer)
        nodes = nodes.sort_values("at")
        ids = join_all([np.asarray(n, np.int32) for n in nodes["ids"]], nodes["inside"].tolist(), model)
        first = nodes.iloc[:1].copy()
        first["at"] = first["at"] // FAN
        first["ids"] = [ids]
        return first

    pieces = rows.mapInArrow(cut, f"_key {key_type}, _row bigint, at bigint, kind string, inside boolean, piece string")
    schema = f"_key {key_type}, _row bigint, at bigint, inside boolean, ids array<int>"
    nodes = freeze(pieces.repartition("_row", "at").mapInArrow(encode_leaves, schema))
    last = nodes.agg(F.max("at")).first()[0] or 0
    while last > 0:
        nodes = nodes.groupBy("_row", F.expr(f"at div {FAN}")).applyInPandas(join_nodes, schema)
        last //= FAN
    return nodes


def decode(encoded: DataFrame, ids: str = "ids", output: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """Add the text that the ids of a column ``array<int>`` decode to."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([f for f in encoded.schema if f.name != output]).add(output, StringType())
    kept = [f.name for f in schema][:-1]
    at = kept.index(ids)

    def back(batches):
        names = load(tokenizer).tokens
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                lists = part.column(at)
                flat = lists.flatten()
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                strings = pa.ListArray.from_arrays(offsets, names.take(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(strings, " ")], [*kept, output])

    return encoded.select(*kept).mapInArrow(back, schema)


def bpe_digest(docs: DataFrame) -> DataFrame:
    """Per document: number of tokens, hash of its ids, hash of the text they decode to."""
    both = decode(encode(docs))
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(spelled, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
