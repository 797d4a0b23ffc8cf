"""Reading one moment out of a loosely written date, in Python (run once per distinct value)."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Offsets in minutes of the abbreviations in use in the zones that orgs have.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ist": 330, "npt": 345, "gst": 240, "bst": 60, "cet": 60, "cest": 120,
    "est": -300, "edt": -240, "aest": 600, "aedt": 660, "wet": 0, "west": 60, "msk": 180,
}

_MON = r"(?P<{m}>" + "|".join([*LONG_MONTHS, "sept", *MONTHS]) + r")\b\.?"
_TIME = r"(?P<{p}h>\d{{1,2}})(?:[:.](?P<{p}mi>\d{{2}})(?:[:.](?P<{p}s>\d{{2}})(?:[.,](?P<{p}f>\d{{1,9}}))?)?(?:\s*(?P<{p}ap>[ap])\.?\s?m\b\.?)?|\s*(?P<{p}ap2>[ap])\.?\s?m\b\.?)"
_YEAR = r"(?P<{y}>\d{{4}}|\d{{2}})(?!\d)(?!\s*:)"
#: The shapes of a date; where several fit, the one that starts first holds, of those the earlier listed.
_SHAPES = (
    r"(?<!\d)(?P<y1>\d{4})(?P<sep1>[-/.])(?P<m1>\d{1,2})(?P=sep1)(?P<d1>\d{1,2})(?!\d)",
    r"(?<!\d)(?P<y2>\d{4})(?P<m2>\d{2})(?P<d2>\d{2})(?:t?(?P<ch>\d{2})(?P<cmi>\d{2})(?P<cs>\d{2})?(?:[.,](?P<cf>\d{1,9}))?)?(?!\d)",
    r"(?<!\d)(?P<d3>\d{1,2})\s?(?P<sep3>[-/.])\s?(?P<m3>\d{1,2})\s?(?P=sep3)\s?(?P<y3>\d{4}|\d{2})(?!\d)",
    r"(?<!\d)(?P<d4>\d{1,2})(?:st|nd|rd|th)?(?:\s+of)?[\s\-/.,]*" + _MON.format(m="m4") + r"[\s\-/.,]*" + _YEAR.format(y="y4"),
    r"\b" + _MON.format(m="m5") + r"[\s\-/.,]*(?P<d5>\d{1,2})(?:st|nd|rd|th)?(?!\d)[\s\-/.,]+(?:" + _TIME.format(p="e") + r"(?:\s+(?P<ezone>[a-z]{1,4}|[+-]\d{2}:?\d{2}))?\s+)?" + _YEAR.format(y="y5"),
)
_DATE = re.compile("|".join(f"(?:{s})" for s in _SHAPES))
_AFTER = re.compile(
    r"(?:t|[\s,;|\-]|\bat\b|@)*" + _TIME.format(p="a") + r"(?:\s*(?:hours|hrs|hour|hr)\b\.?)?"
)
_ZONE = re.compile(
    r"[\s(\[]*(?:(?:utc|gmt)\s*)?(?P<sign>[+\-−])(?P<zh>\d{1,2}):?(?P<zm>\d{2})?(?!\d)|[\s(\[]*(?P<abbr>" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\b"
)
_DIGITS = re.compile(r"(?<!\d)(?:\d{16}|\d{13}|\d{10})(?!\d)")
_EPOCH = date(1970, 1, 1).toordinal()


@lru_cache(64)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (ZoneInfoNotFoundError, ValueError):
        return None


def _month(text: str) -> int:
    return MONTHS.index(text[:3]) + 1


def _clock(g: dict, p: str) -> tuple[int, int, int, int] | None:
    """Hour, minute, second, microsecond; None for a time that no clock shows (24:00 is the day's end)."""
    h, mi, s = int(g[p + "h"]), int(g[p + "mi"] or 0), int(g[p + "s"] or 0)
    half = g.get(p + "ap") or g.get(p + "ap2")
    if half:
        if not 1 <= h <= 12 and not (h > 12 and half == "p"):
            return None
        h = h if h > 12 else h % 12 + 12 * (half == "p")
    elif g[p + "mi"] is None:
        return None
    us = int((g[p + "f"] or "0").ljust(6, "0")[:6])
    if h > 24 or mi > 59 or s > 60 or (h == 24 and (mi or s or us)):
        return None
    return h, mi, min(s, 59), us


def to_epoch_us(value: str | None, tz: str | None) -> int | None:
    """Microseconds since 1970 UTC of the first real calendar day that value names, None if it names none.

    The day comes before the month unless the second number exceeds 12 or the year comes first; two-digit years
    are 20yy. No readable clock time means 00:00. A zone in the value holds before tz, and UTC where tz is unknown.
    A wall time that occurs twice is the first, a skipped one is read with the offset before the change.
    """
    if not value:
        return None
    low = value.lower()
    at = 0
    while m := _DATE.search(low, at):
        g = m.groupdict()
        if g["y1"]:
            y, mo, d = int(g["y1"]), int(g["m1"]), int(g["d1"])
        elif g["y2"]:
            y, mo, d = int(g["y2"]), int(g["m2"]), int(g["d2"])
        elif g["d3"]:
            y, mo, d = int(g["y3"]), int(g["m3"]), int(g["d3"])
            if mo > 12:
                mo, d = d, mo
        elif g["d4"]:
            y, mo, d = int(g["y4"]), _month(g["m4"]), int(g["d4"])
        else:
            y, mo, d = int(g["y5"]), _month(g["m5"]), int(g["d5"])
        y += 2000 * (y < 100)
        try:
            day = date(y, mo, d)
        except ValueError:
            at = m.start() + 1
            while at < len(low) and low[at - 1].isalnum() and low[at].isalnum() and low[at].isdigit() == low[at - 1].isdigit():
                at += 1  # not into the middle of a run that was just refused
            continue
        clock, end, zone = None, m.end(), g["ezone"]
        if g["ch"]:
            clock = _clock(g | {"cap": None}, "c")
        elif g["eh"]:
            clock = _clock(g, "e")
        elif t := _AFTER.match(low, end):
            clock, end = _clock(t.groupdict(), "a"), t.end()
        h, mi, s, us = clock or (0, 0, 0, 0)
        z = _ZONE.match(zone) if zone else _ZONE.match(low, end)
        wall = ((day.toordinal() - _EPOCH) * 86400 + h * 3600 + mi * 60 + s) * 1_000_000 + us
        if z and z["sign"]:
            offset = (int(z["zh"]) * 60 + int(z["zm"] or 0)) * (1 if z["sign"] == "+" else -1)
            return wall - offset * 60_000_000
        if z:
            return wall - ABBREVIATIONS[z["abbr"]] * 60_000_000
        info = _zone(tz)
        if info is None:
            return wall
        local = datetime(day.year, day.month, day.day, h % 24, mi, s) + timedelta(days=h // 24)
        return wall - round(info.utcoffset(local.replace(tzinfo=info)).total_seconds()) * 1_000_000
    if (e := _DIGITS.search(low)) and sum(c.isdigit() for c in low) == len(e.group()):
        return int(e.group()) * {10: 1_000_000, 13: 1_000, 16: 1}[len(e.group())]
    return None
