"""Token ids of words for tokenizers of the kind "BPE with word ends", in bulk.

Such a tokenizer (``word_bpe_49k.json``) lowers letters, drops white space, splits what is left
into letters, digits and other signs, and merges the bytes of each part, the last of which
carries a word end. It never joins what ASCII white space separates, so a text's ids are those
of its words in a row, and the distinct words of a batch are enough.

Plain words, of ASCII and accented Latin letters, are split by one Arrow expression and merged by
tiktoken, which takes thousands of words in one call. A word end is a character of its own there
(U+0080, in no plain word), which the first two ranks glue to the byte before it; after that, a
merge has the rank of its place in the tokenizer's list. All other words, and the added tokens,
go to the tokenizer itself. ``tests/llm/test_bpe.py`` compares both ways.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from repoaudit.llm.common import Words

TOKENIZER = "word_bpe_49k.json"
#: Longest word, in bytes, that is merged in bulk.
SHORT = 200
#: Words that one call takes.
AT_A_TIME = 4_000

_END = "\x80"
#: The parts of a plain word in small letters, each to be followed by the end.
_PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{DF}-\x{F6}\x{F8}-\x{17F}]+|[0-9]|[^a-z0-9\x{DF}-\x{F6}\x{F8}-\x{17F}]+)"
_PLAIN = r"^[\x21-\x7E\x{C0}-\x{12F}\x{131}-\x{17F}]*$"
_SUFFIX = "</w>"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others in a row for what follows U+00FF."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class WordBPE:
    """A tokenizer with word ends: its vocabulary, its merges, and bulk encoding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        import tiktoken
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        vocabulary, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        self.library = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        #: The merges alone, for parts of words: within a word, and at its end.
        self.within = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
        self.at_end = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=_SUFFIX))

        tokens = vocabulary | self.added
        names = [""] * (max(tokens.values()) + 1)
        for name, at in tokens.items():
            names[at] = name
        #: The string of each id, and whether it ends a part of a word.
        self.tokens = pa.array(names)
        self.ends = np.array([n.endswith(_SUFFIX) or n in self.added for n in names])

        letters, end = _byte_letters(), _END.encode()

        def spelled(token: str) -> bytes:
            ends = token.endswith(_SUFFIX)
            body = token[: -len(_SUFFIX)] if ends else token
            return bytes(letters[c] for c in body) + end * ends

        ranks = {bytes([b]): b for b in range(256)}
        for key in (end, *(bytes([b]) + end for b in range(256)), *(spelled(a) + spelled(b) for a, b in merges)):
            ranks.setdefault(key, len(ranks))
        self._id_of = np.zeros(len(ranks), np.uint32)
        for token, at in vocabulary.items():
            self._id_of[ranks[spelled(token)]] = at
        self._merger = tiktoken.Encoding(
            "words", pat_str=r"[^\x{80}\s]+\x{80}", mergeable_ranks=ranks, special_tokens={}
        )

    def words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, starts)``: the ids of word i are ``ids[starts[i]:starts[i + 1]]``."""
        plain = pc.and_(
            pc.and_(pc.match_substring_regex(names, _PLAIN), pc.less_equal(pc.binary_length(names), SHORT)),
            pc.invert(pc.match_substring(names, "<|")),  # may begin an added token
        ).to_numpy(zero_copy_only=False).astype(bool)
        bulk_ids, bulk_lengths = self._bulk(names.filter(pa.array(plain)))
        other_ids, other_lengths = self._one_by_one(names.filter(pa.array(~plain)).to_pylist())
        lengths = np.zeros(len(names), np.int64)
        lengths[plain], lengths[~plain] = bulk_lengths, other_lengths
        starts = np.concatenate([[0], np.cumsum(lengths)])
        of_plain = np.repeat(plain, lengths)
        ids = np.zeros(starts[-1], np.uint32)
        ids[of_plain], ids[~of_plain] = bulk_ids, other_ids
        return ids, starts

    def _bulk(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(pc.utf8_lower(names), pattern=_PARTS, replacement="\\1" + _END)
        parts = pc.count_substring(marked, _END).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [
            np.array(self._merger.encode_ordinary(" ".join(marked.slice(at, AT_A_TIME).to_pylist())), np.int64)
            for at in range(0, len(marked), AT_A_TIME)
        ]
        ids = self._id_of[np.concatenate(found)] if found else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])  # where parts end, a word's last among them
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(parts)])])

    def _one_by_one(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        lengths = []
        for at in range(0, len(names), AT_A_TIME):
            for found in self.library.encode_batch_fast(names[at : at + AT_A_TIME], add_special_tokens=False):
                ids += found.ids
                lengths.append(len(found.ids))
        return np.array(ids, np.uint32), np.array(lengths, np.int64)

    def texts(self, texts: pa.Array, closing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, starts)`` of whole texts without nulls; ``closing`` is put after each of them."""
        words = Words(texts)
        ids, starts = self.words(words.names)
        codes, bounds = words.codes, words.starts
        if closing is not None:
            # One more word of one id, at the end of each text.
            ids, starts = np.append(ids, np.uint32(closing)), np.append(starts, starts[-1] + 1)
            codes = np.insert(codes, bounds[1:], len(starts) - 2)
            bounds = bounds + np.arange(len(bounds))
        lengths = starts[codes + 1] - starts[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(starts[codes] - before[:-1], lengths) + np.arange(before[-1])
        return ids[places], before[bounds]


@functools.cache
def load(name: str = TOKENIZER) -> WordBPE:
    """The tokenizer of this name, once per Python worker."""
    import public_tokenizers

    return WordBPE(name if os.path.isabs(name) else public_tokenizers.path(name))
