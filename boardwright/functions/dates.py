"""Calendar dates in free text, as Catalyst expressions: the substring, its ISO form, its year."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwright.functions.bind import let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_M = "|".join(MONTHS)
#: In order of priority: year first, day and month name, month name and day, three numbers.
ISO = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
DAY_NAME = rf"(?i)\b(\d{{1,2}})\s*(?:st|nd|rd|th)?[\s\-./]*({_M})[a-z]*[\s\-./,]*(\d{{2,4}})\b"
NAME_DAY = rf"(?i)\b({_M})[a-z]*[\s\-./]*(\d{{1,2}})\s*(?:st|nd|rd|th)?[\s,]*(\d{{4}})\b"
NUMBERS = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\b"
ANY = "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in (ISO, DAY_NAME, NAME_DAY, NUMBERS))


def find_date(text: Column) -> Column:
    """The leftmost date-like substring, '' for none."""
    return F.coalesce(F.trim(F.regexp_extract(text, ANY, 0)), F.lit(""))


def _month(token: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(token, 1, 3)))
    return at.cast("int")


def _groups(text: Column, pattern: str) -> Column:
    """The three groups of the first match, split at a mark that no group holds; null where nothing matches."""
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", F.split(F.regexp_replace(found, pattern, "$1|$2|$3"), r"\|"))


def _iso(text: Column, pattern: str, read: Callable[[Column, Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The date of a pattern's first match, null if it is none."""

    def valid(p: Column) -> Column:
        year = F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"])
        ok = year.between(2000, 2099) & p["m"].between(1, 12) & p["d"].between(1, 31)
        return F.when(ok, F.format_string("%04d-%02d-%02d", year, p["m"], p["d"]))

    def parts(g: Column) -> Column:
        y, m, d = read(g[0], g[1], g[2])
        return let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), valid)

    return let(_groups(text, pattern), lambda g: F.when(g.isNotNull(), parts(g)))


def _numbers(a: Column, b: Column, y: Column) -> tuple[Column, Column, Column]:
    first, second = a.try_cast("int"), b.try_cast("int")
    swap = (second > 12) & (first <= 12)
    return y.try_cast("int"), F.when(swap, first).otherwise(second), F.when(swap, second).otherwise(first)


def normalize_date(text: Column) -> Column:
    """'YYYY-MM-DD' by the first pattern that gives a month 1-12, a day 1-31 and a year 2000-2099, '' for none.

    Not checked against the calendar. Two-digit years are 20yy; numbers are day first unless only the second can be
    a day. A month's name may run on in other letters. A pattern is tried only where those before it gave nothing.
    """
    n = lambda c: c.try_cast("int")
    return F.coalesce(
        _iso(text, ISO, lambda y, m, d: (n(y), n(m), n(d))), _iso(text, DAY_NAME, lambda d, m, y: (n(y), _month(m), n(d))),
        _iso(text, NAME_DAY, lambda m, d, y: (n(y), _month(m), n(d))), _iso(text, NUMBERS, _numbers), F.lit(""),
    )


def year_of(text: Column) -> Column:
    """Year of the normalised date, else a bare 20yy, else null."""
    bare = F.regexp_extract(text, r"\b(20\d{2})\b", 1).try_cast("int")
    return let(normalize_date(text), lambda iso: F.when(iso != "", F.substring(iso, 1, 4).try_cast("int")).otherwise(bare))
