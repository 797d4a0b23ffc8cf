import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardwright.functions import dates, text
from boardwright.functions.instants import to_epoch_us


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


DATES = [
    ("20 Jun 2026", "20 Jun 2026", "2026-06-20"), ("09-06-2026", "09-06-2026", "2026-06-09"), ("06/25/2026", "06/25/2026", "2026-06-25"),
    ("20.06.26", "20.06.26", "2026-06-20"), ("June 20, 2026", "June 20, 2026", "2026-06-20"), ("2nd June 2026", "2nd June 2026", "2026-06-02"),
    ("Sept 5 2026", "Sept 5 2026", "2026-09-05"), ("Last Date: 30-06-2026", "30-06-2026", "2026-06-30"),
    ("Posted 01/02/2026, closes 2026-03-04", "01/02/2026", "2026-03-04"), ("2026-02-31", "2026-02-31", "2026-02-31"),
    ("5 marks 2026", "5 marks 2026", "2026-03-05"), ("25/13/2026", "25/13/2026", ""), ("2026-13-01", "2026-13-01", ""), ("31-12-1999", "31-12-1999", ""),
    ("20 Jun 202", "20 Jun 202", ""), ("Advt 12/2026", "", ""), ("", "", ""),
]


def test_date_cases(spark):
    raw = [d[0] for d in DATES]
    assert column(spark, raw, dates.find_date) == [d[1] for d in DATES]
    assert column(spark, raw, dates.normalize_date) == [d[2] for d in DATES]
    assert column(spark, ["Posted 01/02/2026, closes 2026-03-04"], lambda c: dates.normalize_date(dates.find_date(c))) == ["2026-02-01"]
    assert column(spark, ["1 Jan 2024", "in 2031", "x", None], dates.year_of) == [2024, 2031, None, None]


def test_null_text(spark):
    assert column(spark, [None], dates.find_date) == [""]
    assert column(spark, [None], text.title_form) == [""]
    assert column(spark, [None, " \t"], text.link_form) == ["", ""]
    assert column(spark, [None], text.url_key) == [""]
    assert column(spark, [None], text.title_key) == [""]


def test_forms(spark):
    titles = ["Clerk | Agra", "AGRA|clerk!", "a-b c", "ABC", "| |", "पद (५)"]
    got = column(spark, titles, text.title_form)
    assert got[0] == got[1] == "agra|clerk" and got[2] == got[3] == "abc" and got[4] == "" and got[5] == "पद५"
    links = ["HTTPS://A.x/p/?b=2&a=1", " https://a.x/p?a=1&b=2\n", "https://a.x/p#q", "https://a.x/p//", "#"]
    got = column(spark, links, text.link_form)
    assert got[0] == got[1] == "https://a.x/p?a=1&b=2" and got[2] == "https://a.x/p#q" and got[3] == "https://a.x/p/" and got[4] == "#"


def test_keys_and_labels(spark):
    assert column(spark, [" HTTP://a/B/?q=1#x ", "#", "javascript:void(0);", "a/#b"], text.url_key) == ["http://a/b", "", "", "a"]
    assert column(spark, ["https://WWW.a.in//", "http://a.in"], text.seed_url_key) == ["a.in", "a.in"]
    assert column(spark, ["a.b.gov.in", "www.x.com", "in"], text.registered_domain) == ["b.gov.in", "x.com", "in"]
    assert column(spark, ["x.nic.in", "iitd.in", "a.gov.in", "bank.xx", "a.com", "zz"], text.domain_family) == ["nic.in", "academic", "gov.in", "banking", "psu", "other"]
    pct = [(1, 16, 6.2, "NOISE"), (4, 5, 80.0, "HIGH"), (1, 2, 50.0, "MEDIUM"), (1, 5, 20.0, "LOW"), (0, 0, 0.0, "NOISE")]
    rows = spark.createDataFrame(pct, "a int, b int, p double, l string")
    for r in rows.select("p", "l", text.percent(F.col("a"), F.col("b")).alias("x"), text.quality_label(text.percent(F.col("a"), F.col("b"))).alias("y")).collect():
        assert (r.p, r.l) == (r.x, r.y)


def test_small_scalars(spark):
    assert column(spark, ["<a & 'b'>"], text.escape_html) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert column(spark, ["x/a_b-c.pdf?q"], text.file_title) == ["A B C"]
    assert column(spark, ["Click here (2.3 MB)", "Senior Clerk", None], text.is_generic_title) == [True, False, True]
    assert column(spark, ["a.PDF", "b.docx", "c.zip", "d.png?x", "e"], text.content_route) == ["pdf", "office", "archive", "image", "html"]
    assert column(spark, ["ReadTimeout", "id 5003", "KeyError", "", None], text.failure_class) == ["server_down", "server_down", "error", None, None]
    assert column(spark, ["The cat, a DOG"], lambda c: F.concat_ws(" ", text.with_bigrams(text.alnum_tokens(c)))) == ["the cat dog the_cat cat_dog"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab éA |-.!पद5\t ", max_size=20), min_size=1, max_size=8))
def test_forms_against_python(spark, values):
    def form(t):
        parts = ["".join(c for c in p if c.isalnum() or c in "पद") for p in t.lower().split("|")]
        return "|".join(sorted(p for p in parts if p))

    assert column(spark, values, text.title_form) == [form(v) for v in values]
    keys = [re.sub(r"[^a-z0-9]+", " ", v.lower()).strip() for v in values]
    assert column(spark, values, text.title_key) == keys


US = 1_000_000
MOMENTS = [
    ("2026-01-02", "UTC", 1767312000), ("02/01/2026", "UTC", 1767312000), ("01/13/2026", "UTC", 1768262400), ("2.1.26", "UTC", 1767312000),
    ("2nd January 2026", "UTC", 1767312000), ("Jan 2, 2026", "UTC", 1767312000), ("Fri Jan 2 00:00:00 2026", "UTC", 1767312000), ("20260102T000000Z", "Asia/Kolkata", 1767312000),
    ("2026-01-02 05:30 IST", "UTC", 1767312000), ("Apply by 02-JAN-2026 5.30 am (IST)", "UTC", 1767312000), ("2026-01-02", "Asia/Kolkata", 1767312000 - 19800), ("1767312000", "Asia/Kolkata", 1767312000),
    ("1767312000000", "UTC", 1767312000), ("1767312000000000", "UTC", 1767312000), ("2026-01-02T00:00:00-05:00", "UTC", 1767312000 + 18000), ("2026-01-01 24:00", "UTC", 1767312000),
    ("2025-10-26 02:30", "Europe/Berlin", 1761438600), ("2025-03-30 02:30", "Europe/Berlin", 1743298200), ("12 Jan 2026 12:00 a.m.", "UTC", 1768176000),
    ("32nd July 2026", "UTC", None), ("2026-13-05", "UTC", None), ("31/02/2026", "UTC", None), ("00-00-0000", "UTC", None), ("TBA", "UTC", None), ("", "UTC", None), (None, None, None),
    ("2026-01-02 99:99", "UTC", 1767312000), ("2026-01-02", "No/Where", 1767312000), ("2026-01-02", None, 1767312000),
]


@pytest.mark.parametrize("value,tz,seconds", MOMENTS)
def test_moments(value, tz, seconds):
    assert to_epoch_us(value, tz) == (None if seconds is None else seconds * US)


def test_fraction():
    assert to_epoch_us("2026-01-02T00:00:00.058+00:00", None) == 1767312000 * US + 58000
