"""Time stamps of the text formats, as column expressions.  Rounding is half-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units(t: Column, per_second: int) -> Column:
    """Whole units of a time; negative times and no time are 0."""
    return F.bround(F.greatest(t, F.lit(0.0)) * per_second, 0).cast("long")


def millis(t: Column) -> Column:
    """Milliseconds, 0 for null."""
    return F.coalesce(units(t, 1000), F.lit(0).cast("long"))


def _part(total: Column, size: int, wrap: int | None = None) -> Column:
    q = F.floor(total / size)
    return F.pmod(q, F.lit(wrap)) if wrap else q


def _clock(t: Column, per_second: int, form: str, hours: bool = True) -> Column:
    n = units(t, per_second)
    rest = [_part(n, per_second * 60, 60 if hours else None), _part(n, per_second, 60), F.pmod(n, F.lit(per_second))]
    return F.format_string(form, *([_part(n, per_second * 3600)] if hours else []), *rest)


def ts_srt(t: Column) -> Column:
    return _clock(t, 1000, "%02d:%02d:%02d,%03d")


def ts_vtt(t: Column) -> Column:
    return _clock(t, 1000, "%02d:%02d:%02d.%03d")


def ts_sbv(t: Column) -> Column:
    return _clock(t, 1000, "%d:%02d:%02d.%03d")


def ts_ass(t: Column) -> Column:
    return _clock(t, 100, "%d:%02d:%02d.%02d")


def ts_lrc(t: Column, ms: bool = False) -> Column:
    return _clock(t, 1000, "%02d:%02d.%03d", False) if ms else _clock(t, 100, "%02d:%02d.%02d", False)


STAMP = r"^\s*(?:(\d+):)?(\d+):(\d+)(?:[.,:](\d+))?\s*$"


def parse_ts(s: Column) -> Column:
    """Seconds of ``[H:]MM:SS[.frac]``; null where the text is no stamp."""
    part = lambda k: F.regexp_extract(s, STAMP, k)
    number = lambda c: F.when(c == "", F.lit(0)).otherwise(c.cast("long"))
    frac = part(4)
    whole = number(part(1)) * 3600 + number(part(2)) * 60 + number(part(3))
    return F.when(s.rlike(STAMP), whole + number(frac) / F.pow(F.lit(10.0), F.length(frac)))
