"""Times, sizes and rates. Offsets are long milliseconds; 0 is "unknown" where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit rates an encoder offers, in kbit/s.
RUNGS = (64, 96, 128, 192, 256, 320)


def div(a: Column, b) -> Column:
    """Integer division that truncates."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("long"), b.cast("long"))


def snapped_rate(kbps: Column) -> Column:
    """The nearest rung, the lower of two; 128 where unknown."""
    rungs = F.array(*[F.lit(r) for r in RUNGS])
    near = F.array_min(F.transform(rungs, lambda r: F.struct(F.abs(r - kbps).alias("d"), r.alias("r"))))["r"]
    return F.when(kbps <= 0, F.lit(128)).otherwise(near)


def seconds_ms(c: Column) -> Column:
    """Milliseconds of a text of seconds, truncated; 0 where it is no number."""
    return F.coalesce((c.try_cast("double") * 1000).cast("long"), F.lit(0).cast("long"))


def rate_kbps(c: Column) -> Column:
    n = c.try_cast("long")
    return F.when(n > 0, div(n, 1000)).otherwise(0)


def clock_ms(h: Column, m: Column, s: Column, fraction: Column) -> Column:
    """Clock parts as texts; the fraction rounds half up."""
    whole = (h.cast("long") * 60 + m.cast("long")) * 60 + s.cast("long")
    part = F.when(fraction != "", F.floor(F.concat(F.lit("0."), fraction).cast("double") * 1000 + 0.5)).otherwise(0)
    return (whole * 1000 + part).cast("long")


def timestamp_text(ms: Column) -> Column:
    """HH:MM:SS.mmm"""
    return F.format_string("%02d:%02d:%02d.%03d", div(ms, 3_600_000), div(ms % 3_600_000, 60_000), div(ms % 60_000, 1000), ms % 1000)


def duration_text(ms: Column) -> Column:
    """HhMMm"""
    return F.format_string("%dh%02dm", div(ms, 3_600_000), div(ms % 3_600_000, 60_000))


def clock_text(ms: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    h, m, s = div(ms, 3_600_000), div(ms % 3_600_000, 60_000), div(ms % 60_000, 1000)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def status_ms(line: Column) -> Column:
    """Position in an encoder's status line, null without one."""
    at = lambda i: F.regexp_extract(line, "time=([0-9]+):([0-9]{2}):([0-9]{2})(?:\\.([0-9]+))?", i)
    return F.when(at(1) != "", clock_ms(at(1), at(2), at(3), at(4)))


def runtime_minutes(ms: Column) -> Column:
    """Rounded to the minute."""
    return div(ms + 30_000, 60_000)


def minutes_text(minutes: Column) -> Column:
    """"10 hrs 12 min", without the part that is zero."""
    h, m = div(minutes, 60), minutes % 60
    return F.when(h == 0, F.format_string("%d min", m)).when(m == 0, F.format_string("%d hrs", h)).otherwise(F.format_string("%d hrs %d min", h, m))


def delta_text(minutes: Column) -> Column:
    """A signed difference: "12 min longer", "1 hrs 5 min shorter"."""
    word = F.when(minutes < 0, " shorter").otherwise(" longer")
    return F.when(minutes == 0, "same length").otherwise(F.concat(minutes_text(F.abs(minutes)), word))


def size_text(n: Column) -> Column:
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    return F.when(n >= gb, F.format_string("%.1f GB", n / gb)).when(n >= mb, F.format_string("%.1f MB", n / mb)).when(n >= kb, F.format_string("%.1f KB", n / kb)).otherwise(F.format_string("%d B", n.cast("long")))


def unwrapped_ms(codec: Column, time_base: Column, ts: Column, frames: Column, signed: bool = False) -> Column:
    """Duration of a stream whose 32-bit tick count wrapped, from its frame count; null where it did not wrap. Ticks and frames
    below one are unknown, unless they are ``signed``."""
    wrap = 1 << 32
    parts = F.split(time_base, "/")
    n, d = F.try_element_at(parts, F.lit(1)).try_cast("long"), F.try_element_at(parts, F.lit(2)).try_cast("long")
    about = frames.cast("long") * 1024
    k = div(about - ts + wrap // 2, wrap)
    fixed = ts + k * wrap
    known = F.lit(True) if signed else (ts > 0) & (frames > 0)
    ok = (codec == "aac") & known & (F.size(parts) == 2) & (n > 0) & (d > 0) & (k >= 1) & (F.abs(fixed - about) <= div(about, 100))
    return F.when(ok, div(fixed * 1000 * n, d))


def tolerance_ms(actual: Column) -> Column:
    """Ten seconds, or a hundredth where that is more."""
    return F.greatest(F.lit(10_000).cast("long"), div(actual, 100))


def leading_year(c: Column) -> Column:
    return F.regexp_extract(c, "^[0-9]{4}", 0)


def year_before_dash(c: Column) -> Column:
    """Text before the first dash of a date of four bytes or more."""
    return F.when(F.octet_length(c) >= 4, F.substring_index(c, "-", 1)).otherwise("")


def release_date(date: Column, year: Column) -> Column:
    """The date, else the year's first day, else null."""
    first = F.when(year.rlike("^[0-9]{4}\\z"), F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.to_date(F.try_to_timestamp(F.left(date, F.lit(10)), F.lit("yyyy-MM-dd")))), first)


def clamped(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def shift_input_ms(c: Column) -> Column:
    """A shift as typed, in milliseconds, held to an hour either way; 0 where it is no number."""
    return clamped(F.coalesce(c.try_cast("long"), F.lit(0).cast("long")), -3_600_000, 3_600_000)


def stage_progress(base: Column, span: Column, fraction: Column) -> Column:
    return base + span * clamped(fraction, 0.0, 1.0)


def doubled_rating(c: Column) -> Column:
    """Five stars as ten points; null where absent."""
    r = F.coalesce(c.try_cast("double"), F.lit(0.0)) * 2
    return F.when(r != 0, r)


def positive_int(c: Column) -> Column:
    n = c.try_cast("long")
    return F.when(n > 0, n)
