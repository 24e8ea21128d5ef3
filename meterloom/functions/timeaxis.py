"""Column expressions over the time axis. Stamps are ``timestamp_ntz``, so no session zone leaks in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLOT_MINUTES = 15
SLOTS_PER_DAY = 96
SLOTS_PER_WEEK = 672

# Monday-first weekday labels.
WEEKDAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_zone(ts: str | Column) -> Column:
    """Zone-aware stamp to wall-clock stamp (the session runs in UTC)."""
    return col(ts).cast("timestamp_ntz")


def lenient_stamp(text: str | Column) -> Column:
    """Text to stamp; anything unreadable becomes null instead of failing the job."""
    return F.try_to_timestamp(col(text)).cast("timestamp_ntz")


def lenient_date(text: str | Column) -> Column:
    return F.try_to_timestamp(col(text)).cast("date")


def date_of(ts: str | Column) -> Column:
    return F.to_date(col(ts))


def minute_of_day(ts: str | Column) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def slot_of(ts: str | Column, slot_minutes: int = SLOT_MINUTES) -> Column:
    return F.floor(minute_of_day(ts) / F.lit(slot_minutes)).cast("int")


def floor_to_slot(ts: str | Column, slot_minutes: int = SLOT_MINUTES) -> Column:
    c = col(ts)
    return c - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(c) % F.lit(slot_minutes), F.extract(F.lit("SECOND"), c)
    )


def stamp_from(date: str | Column, slot: str | Column, slot_minutes: int = SLOT_MINUTES) -> Column:
    return col(date).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), col(slot).cast("int") * F.lit(slot_minutes), F.lit(0)
    )


def time_text(slot: str | Column, slot_minutes: int = SLOT_MINUTES) -> Column:
    """Slot number as ``HH:MM:SS``."""
    m = col(slot).cast("int") * F.lit(slot_minutes)
    return F.format_string("%02d:%02d:00", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def minutes_from_text(hhmm: str | Column) -> Column:
    """``HH:MM`` to minutes after midnight."""
    c = col(hhmm)
    return F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int")


def stamp_text(ts: str | Column) -> Column:
    """Second-resolution text form used as an alignment key."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def day_of_year(d: str | Column) -> Column:
    return F.dayofyear(col(d))


def weekday(d: str | Column) -> Column:
    """Monday = 0."""
    return F.weekday(col(d))


def weekend_flag(d: str | Column) -> Column:
    return (F.weekday(col(d)) >= 5).cast("int")


def weekday_label(d: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_LABELS]), F.weekday(col(d)) + 1)


def iso_week(d: str | Column) -> Column:
    return F.weekofyear(col(d))


def iso_week_year(d: str | Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d))


def minute_of_week(ts: str | Column) -> Column:
    return F.weekday(col(ts)) * 1440 + minute_of_day(ts)


def round_half_even(x: str | Column, places: int) -> Column:
    """Ties go to the even digit. The value is cut to nine places first: the last bits of a distributed average depend on
    the order of addition and must not decide a tie."""
    scale = F.lit(10.0**places)
    return F.rint(F.round(col(x), 9) * scale) / scale
