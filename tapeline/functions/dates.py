"""Timestamps as the headline pipeline reads them: 14 digits or ISO, naive meaning UTC; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.functions.text import strip

_ISO = r"^(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{4})([0-9]{2})([0-9]{2}))[T ](?:([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?)?|([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?)(?:(Z)|([+-])([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2}))?)?)?\z"
_DIGITS = r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})Z?\z"
_ISO_PARTS = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})"
NEW_YORK = "America/New_York"


def _part(text: Column, pattern: str, *groups: int) -> Column:
    found = [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def utc_timestamp(value: Column) -> Column:
    """The instant as a UTC timestamp_ntz; null for days without a time, blanks and whatever can't be read."""
    text = strip(value)
    iso = text.rlike(_ISO)
    digits = text.rlike(r"^[0-9]{14}\z")

    def pick(g14: int, *g: int) -> Column:
        return F.when(digits, _part(text, _DIGITS, g14)).when(iso, _part(text, _ISO, *g)).cast("int")

    fraction = F.when(iso, F.rpad(F.substring(_part(text, _ISO, 10, 14), 1, 6), 6, "0"))
    second = F.coalesce(pick(6, 9, 13), F.lit(0)) + F.coalesce(fraction.cast("decimal(8,0)") / F.lit(1000000), F.lit(0))
    wall = F.when(digits | iso, F.try_make_timestamp_ntz(pick(1, 1, 4), pick(2, 2, 5), pick(3, 3, 6), pick(4, 7, 11), F.coalesce(pick(5, 8, 12), F.lit(0)), second.cast("decimal(16,6)")))
    # 24:00 and second 60 are no times here, though the constructor takes the latter
    sane = (pick(4, 7, 11) < 24) & (F.coalesce(pick(6, 9, 13), F.lit(0)) < 60)
    size = [F.coalesce(F.when(iso, _part(text, _ISO, g)).cast("int"), F.lit(0)) for g in (17, 18, 19)]
    sign = F.when(_part(text, _ISO, 16) == "-", -1).otherwise(1)
    return F.when(sane & (size[0] < 24) & (size[1] < 60) & (size[2] < 60), wall - F.make_dt_interval(F.lit(0), sign * size[0], sign * size[1], (sign * size[2]).cast("decimal(18,6)")))


def in_new_york(utc: Column) -> Column:
    """New York wall time of a UTC timestamp_ntz."""
    return F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), utc)


def iso_with_offset(local: Column, utc: Column) -> Column:
    """ISO text of a wall time with its offset from UTC; fractions only where there are any."""
    minutes = F.timestamp_diff("MINUTE", utc, local)
    whole = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(local, "SSSSSS")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), offset)


def target_date(local: Column, close: str = "16:00:00") -> Column:
    """The day a New York wall time counts for: the next one if it is strictly after the close."""
    return F.date_add(local.cast("date"), F.when(F.date_format(local, "HH:mm:ss.SSSSSS") > close + ".000000", 1).otherwise(0))


def next_weekday(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))


def flexible_day(value: Column) -> Column:
    """A day from an ISO day, an ISO timestamp (its own day, zone ignored) or yyyyMMdd; else null."""
    text = strip(value)
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z|^[0-9]{8}\z") | text.rlike(_ISO)
    return F.when(shaped, F.try_to_date(F.concat_ws("-", *(_part(text, _ISO_PARTS, g) for g in (1, 2, 3))), "yyyy-MM-dd"))
