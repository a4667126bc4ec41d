"""ISO-8601 timestamps."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

# Only times with an offset count; a naive time cannot be compared with the present.
_WITH_OFFSET = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
)
_MICROS_PER_DAY = 86_400_000_000


def as_utc(moment: datetime | None) -> datetime:
    """The reference time of a run; the present if none is given."""
    if moment is None:
        return datetime.now(timezone.utc)
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def iso_text(text: Column) -> Column:
    """Canonical form of a valid time text: seconds, micros if any, offset +hh:mm."""
    clock = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 5))
    seconds = F.coalesce(
        F.nullif(F.regexp_extract(text, r"^.{16}(:\d{2})", 1), F.lit("")), F.lit(":00")
    )
    micros = F.rpad(F.regexp_extract(text, r"[.,](\d{1,6})", 1), 6, "0")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    offset = F.regexp_replace(F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1), "Z", "+00:00")
    offset = F.regexp_replace(offset, r"^([+-]\d{2})(\d{2})$", "$1:$2")
    return F.concat(clock, seconds, fraction, offset)


def parse_offset_time(text: Column) -> Column:
    """Timestamp of an ISO-8601 text with offset, else null."""
    return F.when(text.rlike(_WITH_OFFSET), iso_text(text).try_cast("timestamp"))


def age_in_days(created: Column, as_of: datetime) -> Column:
    """Whole days since ``created``, rounded down, so the future is negative."""
    micros = F.lit(int(as_of.timestamp()) * 1_000_000 + as_of.microsecond)
    return F.floor((micros - F.unix_micros(created)) / F.lit(_MICROS_PER_DAY)).cast("int")
