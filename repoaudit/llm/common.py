"""What several operators share: tables, words of texts, ids for the rows of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A word, as the operators count them: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def plain_texts(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as one array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts, "")


#: Bytes of text that a task works on at once, but for a single longer text.
AT_ONCE = 4 << 20


def bounded(batches, column: int, size: int = AT_ONCE):
    """Batches cut so that each has about ``size`` bytes in a column of texts, or one text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a batch of texts, dictionary-encoded.

    ``codes`` has one entry per word, ``starts[i]:starts[i + 1]`` are those of text i and
    ``names`` the distinct words.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        full = pc.not_equal(flat, "")
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets = lists.offsets.to_numpy()
        self.starts = before[offsets - offsets[0]].astype(np.int64)
        encoded = flat.filter(full).dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = encoded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, self.names.to_pylist()), np.uint64, len(self.names))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
