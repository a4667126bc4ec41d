"""Text: decoding, lines, trimming, regular expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Every character at which a text is cut into lines; \r\n counts once.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# The breaks at which a file opened as text is read line by line.
FILE_LINE_BREAK = r"\r\n|\r|\n"
_RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

SNIPPET_LENGTH = 200

# Non-ASCII characters that match an ASCII letter when case is ignored.
_FOLDING = ("ſKİı", "skii")

_WORD = r"[\p{L}\p{N}_]"
_WORD_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# Package name at the start of a requirement.
NAME_PATTERN = r"^([A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?)"


def decode_dropping(content: Column) -> Column:
    """Bytes to text; invalid UTF-8 sequences vanish."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.translate(F.make_valid_utf8(text), "\ufffd", "")
    )


def decode_replacing(content: Column) -> Column:
    """Bytes to text; invalid UTF-8 sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def code_text(files: DataFrame) -> DataFrame:
    """``content`` as text for checks of source code."""
    if files.schema["content"].dataType == T.StringType():
        return files
    return files.withColumn("content", decode_dropping(F.col("content")))


def manifest_text(files: DataFrame) -> DataFrame:
    """``content`` as text for the reading of manifests."""
    if files.schema["content"].dataType == T.StringType():
        return files
    return files.withColumn("content", decode_replacing(F.col("content")))


def split_lines(content: Column) -> Column:
    """Cut a text at every line break; a final break leaves one empty last element."""
    rare = reduce(or_, [F.contains(content, F.lit(char)) for char in _RARE_BREAKS])
    # Splitting on a single character avoids the regex engine.
    return F.when(rare, F.split(content, LINE_BREAK)).otherwise(F.split(content, "\n"))


def without_last_break(content: Column) -> Column:
    """The text without the line break at its end, if there is one."""
    return F.regexp_replace(content, rf"(?:{LINE_BREAK})\z", "")


def strip(text: Column) -> Column:
    """Trim all Unicode white space, the separators 0x1c to 0x1f included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fold_case(text: Column) -> Column:
    """Lower case such that a case-insensitive ASCII literal is found by ``contains``."""
    special = [F.contains(text, F.lit(char)) for char in _FOLDING[0]]
    some = (F.length(text) != F.octet_length(text)) & reduce(or_, special)
    return F.lower(F.when(some, F.translate(text, *_FOLDING)).otherwise(text))


def ignore_case(pattern: str) -> str:
    """A pattern searched without case, with the Unicode classes the rules assume.

    Java does not count 0x1f as white space, and counts combining marks as letters at a
    word boundary, so both are spelled out.
    """

    def exact(found: re.Match) -> str:
        return found[1] + (r"[\s\x1f]" if found[2] == "s" else _WORD_BOUNDARY)

    return "(?iU)" + re.sub(r"(?<!\\)((?:\\\\)*)\\([sb])", exact, pattern)


def snippet(line: Column) -> Column:
    """The trimmed line, cut at 200 characters."""
    text = strip(line)
    return F.when(
        F.length(text) > SNIPPET_LENGTH,
        F.concat(F.substring(text, 1, SNIPPET_LENGTH), F.lit("…")),
    ).otherwise(text)


def package_name(text: Column) -> Column:
    """Leading package name in lower case, or ''."""
    return F.lower(F.regexp_extract(text, NAME_PATTERN, 1))
