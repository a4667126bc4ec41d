"""Personal data in texts: patterns propose spans, checksums confirm them, context scores them.

Everything is a column expression; no row leaves the JVM. A row needs memory in proportion
to its own text only, and nothing is shuffled.

Kinds. ``email``, ``ip``, ``card`` and ``phone`` are found whatever their context; ``iban``
(confirmed by its remainder modulo 97) and ``ssn`` (confirmed by its ranges) only count
when their score reaches ``MIN_SCORE``. A score starts at the kind's prior, rises when a
word that usually announces the kind is near and falls when a word that speaks against it
is near.

The patterns are written so that a scan is linear: a run that fails is not tried again from
its middle (look-behind), and repeated groups never give back what they took (possessive).
Both leave the leftmost, non-overlapping matches as they are. Places are running totals, and context
is taken from blocks of the text, so the work grows with n log n of the spans of a text.

Null and empty texts have no spans. Rows are independent, so repeated rows and ties give
equal results, and other columns pass through unchanged; columns named like the result are
replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: Characters on each side of a span in which context words are looked for.
CONTEXT = 48
#: The score from which a span of a kind that needs support counts.
MIN_SCORE = 0.5
RAISE, LOWER = 0.35, 0.25
#: Code points of a block of text.
BLOCK = 512


class Kind(NamedTuple):
    """``always``: a confirmed span counts whatever its score. ``has``: a text without this
    cannot hold the kind, which spares the pattern."""

    name: str
    pattern: str
    prior: float
    always: bool
    for_words: str
    against_words: str
    has: str


KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        True,
        "e-?mail|contact|write|reply",
        "example|noreply",
        "@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        0.6,
        True,
        r"\bip\b|address|host|server|login",
        "version|section|release",
        ".",
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
        0.7,
        True,
        r"card|visa|credit|payment|\bcvv\b",
        r"order|serial|\bisbn\b|tracking",
        "",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        0.7,
        True,
        r"phone|\btel\b|call|mobile|\bfax\b",
        "score|points",
        "+",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        0.8,
        False,
        r"\biban\b|account|bank|transfer",
        "serial|part number",
        "",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        0.3,
        False,
        r"\bssn\b|social security|taxpayer",
        "phone|order|serial",
        "-",
    ),
)
BASE = tuple(k.name for k in KINDS if k.always)


def _running(values: Column, combine) -> Column:
    """Running totals of an array of whole numbers, none below 0. The reach of each element
    doubles until it covers all before it, so the work is n log n and no array grows."""
    reach = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda r: r < F.size(values))
    return F.aggregate(
        reach,
        values,
        lambda state, r: F.transform(state, lambda x, i: combine(x, F.coalesce(F.get(state, i - r), F.lit(0)))),
    )


def _found(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(kind.has)), found).otherwise(F.expr("cast(array() as array<string>)"))


def _steps(text: Column, kind: Kind, found: str) -> Column:
    """How far each match ends from the end of the one before: the gap and the match."""
    gaps = F.slice(F.split(text, kind.pattern, -1), 1, F.size(found))
    steps = F.zip_with(found, gaps, lambda m, g: F.length(g) + F.length(m))
    return F.when(F.size(found) > 0, steps).otherwise(F.expr("cast(array() as array<int>)"))


def _placed(found: str, steps: str) -> Column:
    """All matches with their places."""
    ends = _running(F.col(steps), lambda a, b: a + b)
    return F.zip_with(
        found,
        ends,
        lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")),
    )


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a place is found without walking to it."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def _cut(blocks: str, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``; beyond the last block there is none."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor(end / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.substring(near, start - first * BLOCK + 1, end - start)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right: every second digit from the right
    counts twice, less nine above nine."""
    reverse = F.split(F.reverse(digits), "")
    doubled = F.transform(
        reverse,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(match: Column) -> Column:
    """The remainder of an account number modulo 97, its first four characters moved to the
    end and letters read as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.ascii(c) - F.when(letter, 55).otherwise(48)
        return ((rest * F.when(letter, 100).otherwise(10) + value) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(
            parts,
            lambda p: (F.length(p) <= 3) & ((p == "") | (F.substring(p, 1, 3).cast("int") <= 255)),
        )
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        length = F.length(F.replace(match, F.lit(" "), F.lit("")))
        return length.between(15, 34) & (mod97(match) == 1)
    if kind == "ssn":
        area = F.substring(match, 1, 3).cast("int")
        zero = (F.substring(match, 5, 2) == "00") | (F.substring(match, 8, 4) == "0000")
        return (area > 0) & (area < 900) & (area != 666) & ~zero
    return F.lit(True)


def _score(blocks: str, kind: Kind, span: Column) -> Column:
    left = _cut(blocks, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"])
    right = _cut(blocks, span["end"], span["end"] + CONTEXT)
    near = F.lower(F.concat(left, F.lit(" "), right))
    return (
        F.lit(kind.prior)
        + F.when(near.rlike(kind.for_words), RAISE).otherwise(0.0)
        - F.when(near.rlike(kind.against_words), LOWER).otherwise(0.0)
    )


def _spans(blocks: str, kind: Kind) -> Column:
    """The confirmed spans of a kind, scored."""

    def scored(span: Column) -> Column:
        return F.struct(
            F.lit(kind.name).alias("kind"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            F.round(_score(blocks, kind, span), 2).alias("score"),
        )

    matches = F.filter(f"_pii_{kind.name}", lambda s: _confirmed(kind.name, s["match"]))
    spans = F.transform(matches, scored)
    return spans if kind.always else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)


def find_pii(df: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """Add the spans of each text as an array of ``(kind, start, end, score)``.

    Offsets are code points, the end is exclusive. Spans come by kind in the order of
    ``KINDS``, then by start; spans of one kind do not overlap, those of two kinds may.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    found = {k: f"_pii_found_{k.name}" for k in KINDS}
    steps = {k: f"_pii_steps_{k.name}" for k in KINDS}
    some = F.greatest(*[F.size(c) for c in found.values()]) > 0
    rows = df.withColumns({found[k]: _found(content, k) for k in KINDS})
    rows = rows.withColumns({steps[k]: _steps(content, k, found[k]) for k in KINDS})
    rows = rows.withColumns({f"_pii_{k.name}": _placed(found[k], steps[k]) for k in KINDS})
    rows = rows.withColumn("_pii_blocks", F.when(some, _blocks(content)))
    spans = F.concat(*[_spans("_pii_blocks", k) for k in KINDS])
    own = [*found.values(), *steps.values(), *[f"_pii_{k.name}" for k in KINDS], "_pii_blocks"]
    return rows.withColumn(output, spans).drop(*own)


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace each span by its kind in brackets; overlapping spans become one replacement,
    named after the first. Null stays null."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    content = F.col(text)
    rows = df.withColumns({"_pii_order": ordered, "_pii_blocks": F.when(F.size(spans) > 0, _blocks(content))})
    reached = _running(F.transform("_pii_order", lambda s: s["end"]), F.greatest)

    def piece(span: Column, at: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        rest = _cut("_pii_blocks", at, F.greatest(at, F.length(content)))
        fresh = F.concat(_cut("_pii_blocks", at, F.greatest(at, span["start"])), label)
        return F.when(span.isNull(), rest).when(span["start"] >= at, fresh).otherwise("")

    # One piece per span, and what is behind the last of them.
    pieces = F.zip_with("_pii_order", F.concat(F.array(F.lit(0)), reached), piece)
    masked = F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(content)
    return rows.withColumn(text, masked).drop("_pii_order", "_pii_blocks")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def pii_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds per row, a digest of their spans, and all spans as text."""
    found = find_pii(df.select(key, text), text, "_spans").select(key, "_spans")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        key,
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )
