"""Timestamps in any form to one unambiguous form.

A value is reduced to its shape mask (every digit 9, every letter a). Each distinct mask is given a parser
once; the parser then cuts the fields of all values of that mask out of one byte matrix and computes with
whole columns. Zones are tables of transitions, built once per worker from the installed IANA data.
"""

from __future__ import annotations

import functools
import re
import zoneinfo
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import numpy as np

NEW_YORK = "America/New_York"
# Offsets of zone abbreviations in seconds.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600,
    "PST": -28800, "PDT": -25200, "BST": 3600, "WET": 0, "WEST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800, "JST": 32400,
}
REGIONS = {"ET": NEW_YORK, "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTH_NUMBER = {n: i for i, m in enumerate(MONTHS, 1) for n in (m, m[:3])} | {"sept": 9}
WEEKDAY_NAMES = {n for d in WEEKDAYS for n in (d, d[:3])} | {"tues", "thur", "thurs"}

_MASK = str.maketrans({**{chr(c): "9" for c in range(48, 58)}, **{chr(c): "a" for k in (65, 97) for c in range(k, k + 26)}})
_DAYS = (
    r"(?P<Y>9999)(?P<s>[-/.])(?P<m>99?)(?P=s)(?P<d>99?)",
    r"(?P<m>99?)/(?P<d>99?)/(?P<Y>9999)",
    r"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999)",
    r"(?:(?P<w>a{3,9}),? +)?(?P<d>99?) +(?P<n>a{3,9}),? +(?P<Y>9999)",
    r"(?:(?P<w>a{3,9}),? +)?(?P<n>a{3,9})\.? +(?P<d>99?),? +(?P<Y>9999)",
    r"(?P<Y>9999)(?P<m>99)(?P<d>99)",
)
_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,]9+)?)?|(?P<h>99)(?P<i>99)(?P<c>99)?(?:[.,]9+)?"
_ZONE = r"(?P<o>[-+]99(?::?99)?)(?: *\[[a/_]+\])?|(?P<z>a+(?:[/_][a_/]+)?)|\[(?P<b>[a/_]+)\]"
_SHAPES = [re.compile(rf"{day}(?:(?: *(?P<T>a) *|,? +)(?:{_TIME})(?: *(?P<p>aa|a\.a\.)(?![a/_]))?(?: *(?:{_ZONE}))?)?") for day in _DAYS]
_COMPACT = re.compile(r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<h>99)(?P<i>99)(?P<c>99)?(?: *(?:(?P<o>[-+]99(?::?99)?)|(?P<z>a+)))?")
# Span of the zone tables, 1800 to 2500, and the years after which days and weekdays repeat, in seconds.
_FIRST, _LAST, _CYCLE = -5364662400, 16725225600, 146097 * 86400
_EPOCH = {10: 1, 13: 10**3, 16: 10**6, 19: 10**9}

#: What a parser returns: seconds since 1970 (of the instant, or of the bare day's midnight), is a bare day, is valid.
Parsed = tuple[np.ndarray, np.ndarray, np.ndarray]


def zone_version() -> str:
    """The release of the zone data that the transition tables are built from."""
    try:
        import tzdata

        return f"tzdata {tzdata.IANA_VERSION}"
    except ImportError:
        for root in zoneinfo.TZPATH:
            try:
                with open(f"{root}/tzdata.zi") as f:
                    return f.readline().strip("# \n")
            except OSError:
                continue
    return "unknown"


@functools.lru_cache(maxsize=None)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Transitions of a zone from 1800 to 2500: instants from which an offset holds, and the offsets. None: no such zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    at = lambda t: int((epoch + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())
    starts, offsets, before = [_FIRST], [at(_FIRST)], at(_FIRST)
    # rules that hold for a few days only lie between 1970 and 2100; after that each year has the same two changes
    steps = [*range(_FIRST, 0, 12 * 86400), *range(0, 4102444800, 4 * 86400), *range(4102444800, _LAST, 24 * 86400), _LAST]
    for a, b in zip(steps, steps[1:]):
        if (now := at(b)) != before:
            while b - a > 1:
                a, b = (mid, b) if at(mid := (a + b) // 2) == before else (a, mid)
            starts.append(b)
            offsets.append(now)
            before = now
    return np.array(starts, dtype=np.int64), np.array(offsets, dtype=np.int64)


def offset_at(table: tuple[np.ndarray, np.ndarray], instant: np.ndarray) -> np.ndarray:
    """Offsets at instants. Behind the table's end its last _CYCLE repeats: the last rules of a zone go by weekdays, and so do the years."""
    beyond = np.maximum(-((_LAST - 1 - instant) // _CYCLE), 0)
    return table[1][np.maximum(np.searchsorted(table[0], instant - beyond * _CYCLE, side="right") - 1, 0)]


def wall_to_instant(table: tuple[np.ndarray, np.ndarray], wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants of wall times, and whether there is one: a time that occurs twice is its first occurrence, a skipped one has none."""
    best, found = np.zeros_like(wall), np.zeros(len(wall), dtype=bool)
    for offset in np.unique(table[1]):
        instant = wall - offset
        fits = offset_at(table, instant) == offset
        best = np.where(fits & (~found | (instant < best)), instant, best)
        found |= fits
    return best, found


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of proleptic Gregorian dates, and whether they exist."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok = (y >= 1) & (m >= 1) & (m <= 12)
    ok &= (d >= 1) & (d <= lengths[np.where(ok, m, 0)] + ((m == 2) & leap))
    y0 = np.where(ok, y, 1970)
    months = (np.where(ok, y0, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    days = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + np.where(ok, d, 1) - 1
    return days, ok


def _number(cells: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(cells), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (cells[:, k].astype(np.int64) - 48)
    return out


def _words(values: list[str], span: tuple[int, int], by: Callable[[str], object]) -> list:
    cache: dict[str, object] = {}
    return [cache[w] if (w := v[span[0] : span[1]]) in cache else cache.setdefault(w, by(w)) for v in values]


def _zoned(wall: np.ndarray, ok: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Wall times at zones given by name, abbreviation or region letters."""
    out, ok, names = wall.copy(), ok.copy(), np.array(names, dtype=object)
    for name in set(names):
        at = np.flatnonzero(names == name)
        if (upper := name.upper()) in ABBREVIATIONS:
            out[at] -= ABBREVIATIONS[upper]
        elif (table := zone_table(REGIONS.get(upper, name)) if upper in REGIONS or "/" in name else None) is not None:
            out[at], real = wall_to_instant(table, wall[at])
            ok[at] &= real
        else:
            ok[at] = False
    return out, ok


@functools.lru_cache(maxsize=4096)
def parser_of(mask: str) -> Callable[[list[str]], Parsed] | None:
    """The parser of all values of a shape mask; None where the shape is no timestamp."""
    if mask.strip("9") == "" and len(mask) in _EPOCH:
        unit = _EPOCH[len(mask)]
        return lambda values: ((cells := np.array([int(v) for v in values], dtype=np.int64)) // unit, np.zeros(len(cells), bool), np.ones(len(cells), bool))
    shape = next((m for s in (_COMPACT, *_SHAPES) if (m := s.fullmatch(mask))), None)
    if shape is None:
        return None
    span = {k: shape.span(k) for k, v in shape.groupdict().items() if v is not None}
    timed = "H" in span or "h" in span

    def parse(values: list[str]) -> Parsed:
        cells = np.array([v.encode("latin-1") for v in values]).view(np.uint8).reshape(len(values), -1)
        year = _number(cells, span["Y"])
        if "n" in span:
            month = np.array(_words(values, span["n"], lambda w: MONTH_NUMBER.get(w.lower(), 0)), dtype=np.int64)
        else:
            month = _number(cells, span["m"])
        days, ok = _days(year, month, _number(cells, span["d"]))
        if "w" in span:
            ok &= np.array(_words(values, span["w"], lambda w: w.lower() in WEEKDAY_NAMES), dtype=bool)
        if "T" in span:
            ok &= np.array(_words(values, span["T"], lambda w: w in "Tt"), dtype=bool)
        wall = days * 86400
        if not timed:
            return wall, np.ones(len(values), bool), ok
        hour, minute, second = (_number(cells, span[a]) if a in span else _number(cells, span[b]) if b in span else np.zeros(len(values), np.int64) for a, b in (("H", "h"), ("M", "i"), ("S", "c")))
        zone = ["UTC"] * len(values)
        if "p" in span:
            mark = _words(values, span["p"], lambda w: w.replace(".", "").upper())
            half, other = np.array([{"AM": 0, "PM": 12}.get(x, -1) for x in mark]), np.array([x not in ("AM", "PM") for x in mark])
            if other.any():  # two letters after the time that are no half of the day may be a zone
                zone = [x if o else z for x, o, z in zip(mark, other, zone)]
                ok &= ~(other & ("z" in span or "o" in span or "b" in span))
            ok &= other | ((hour >= 1) & (hour <= 12))
            hour = np.where(other, hour, hour % 12 + half)
        ok &= (hour < 24) & (minute < 60) & (second < 60)
        wall = wall + hour * 3600 + minute * 60 + second
        if "o" in span:
            a, b = span["o"]
            sign = np.where(cells[:, a] == 45, -1, 1)
            hours, minutes = _number(cells, (a + 1, a + 3)), _number(cells, (b - 2, b)) if b - a > 3 else np.zeros(len(values), np.int64)
            ok &= (hours <= 18) & (minutes < 60)
            return wall - sign * (hours * 3600 + minutes * 60), np.zeros(len(values), bool), ok
        for k in ("z", "b"):
            if k in span:
                zone = [v[span[k][0] : span[k][1]] for v in values]
        instant, ok = _zoned(wall, ok, zone)
        return instant, np.zeros(len(values), bool), ok

    return parse


#: Values from this length on are shortened before they are masked; no shape but with an unknown zone's name reaches _LONGEST then.
_LONG, _LONGEST = 64, 400
_RUNS = re.compile(r" {2,}")
_FRACTION = re.compile(r"([.,][0-9]{9})[0-9]+")


def _shortened(value: str) -> str:
    """The same timestamp with blanks collapsed and fractions cut after nine digits, which no form shows."""
    return _FRACTION.sub(r"\1", _RUNS.sub(" ", value))


def parse_all(values: list[str]) -> Parsed:
    """Seconds, bare-day marks and validity of trimmed values; texts of no known shape are not valid."""
    values = [v if len(v) <= _LONG else _shortened(v) for v in values]
    n = len(values)
    seconds, bare, ok = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    masks = "\x1e".join(v.replace("\x1e", "\x1f") for v in values).translate(_MASK).split("\x1e") if n else []
    groups: dict[str, list[int]] = {}
    for i, m in enumerate(masks):
        groups.setdefault(m, []).append(i)
    for mask, at in groups.items():
        if len(mask) <= _LONGEST and mask.isascii() and (parse := parser_of(mask)) is not None:
            index = np.array(at)
            seconds[index], bare[index], ok[index] = parse([values[i] for i in at])
    return seconds, bare, ok


def to_utc_second(values: list[str]) -> list[str | None]:
    """`yyyy-MM-dd HH:mm:ss` in UTC of each value; None without a time of day, or where there is no such instant."""
    seconds, bare, ok = parse_all(values)
    ok &= ~bare & (seconds >= -62135596800) & (seconds <= 253402300799)
    text = np.datetime_as_string(np.where(ok, seconds, 0).astype("datetime64[s]"))
    return [t.replace("T", " ") if good else None for t, good in zip(text.tolist(), ok.tolist())]


def to_local_day(values: list[str], zone: str = NEW_YORK) -> list[str | None]:
    """`yyyy-MM-dd` in the zone: a bare day is that day there, an instant counts on its day there."""
    seconds, bare, ok = parse_all(values)
    local = np.where(bare, seconds, seconds + offset_at(zone_table(zone), seconds))
    ok &= (local >= -62135596800) & (local <= 253402300799)
    text = np.datetime_as_string(np.where(ok, local, 0).astype("datetime64[s]").astype("datetime64[D]"))
    return [t if good else None for t, good in zip(text.tolist(), ok.tolist())]
