import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boardwright.operators.snapshots import FIELDS, snapshot_changes
from boardwright.operators.timestamps import extend_dictionary, normalise_dates

SCHEMA = "snapshot_id int, received_at timestamp, org_key string, status string, jobs array<struct<title string, link string, apply_link string, pdf_link string, date string, date_iso string, tier string>>, change string"


def brute(rows):
    v = {}
    for r in rows:
        k = (r[0], r[2])
        if k not in v or r[1] >= v[k][1]:
            v[k] = r
    eff, out = {}, set()
    ids = sorted({k[0] for k in v})
    orgs = {k[1] for k in v}
    for s in ids:
        for o in orgs:
            if (s, o) in v:
                if v[s, o][3] == "ok":
                    e = {}
                    for j in v[s, o][4] or []:
                        e.setdefault(j[1] or "", set()).add(tuple(x or "" for i, x in enumerate(j) if i != 1))
                    eff[s, o] = e
                else:
                    eff[s, o] = eff.get((s - 1, o), {})
    for s in ids[1:]:
        for o in orgs:
            a, b = eff.get((s - 1, o)), eff.get((s, o))
            if a is None and b is None:
                continue
            if a is None or b is None:
                out.add((s, o, "", "org_added" if a is None else "org_removed"))
            elif v[s, o][3] != v[s - 1, o][3]:
                out.add((s, o, "", "status"))
            a, b = a or {}, b or {}
            out |= {(s, o, k, "added") for k in b.keys() - a.keys()} | {(s, o, k, "removed") for k in a.keys() - b.keys()}
            out |= {(s, o, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def test_random_snapshots(spark):
    rng, rows, at = random.Random(5), [], datetime(2026, 1, 1)
    for s in range(1, 6):
        for o in range(12):
            for again in range(rng.choice([0, 1, 1, 1, 2])):
                jobs = [(rng.choice(["a", "b", None]), f"l{rng.randrange(4)}", None, rng.choice(["", None]), "", "", "x") for _ in range(rng.randrange(4))]
                jobs = list({j[1]: j for j in jobs}.values())
                jobs += jobs[:1]  # a repeat
                rows.append((s, at + timedelta(minutes=len(rows)), f"o{o}", rng.choice(["ok", "ok", "failed"]), jobs, "extra"))
    rng.shuffle(rows)
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert len(FIELDS) == 6


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert snapshot_changes(empty).collect() == []
    t = datetime(2026, 1, 1)
    rows = [(1, None, "a", "ok", None, None), (2, t, "a", "ok", [("t", None, None, None, None, None, None)], None), (2, t, None, "ok", None, None), (None, t, "a", "ok", None, None)]
    assert [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()] == [(2, "a", "", "added")]


def test_dates_of_rows(spark, tmp_path):
    rows = [(1, "a", "2026-01-02", None, "x"), (2, "b", "", "1767312000", "x"), (3, None, "2026-01-02", "TBA 5", "x"), (4, "a", None, None, "x")] + [(i, "a", "2026-01-02", "", "x") for i in range(5, 60)]
    jobs = spark.createDataFrame(rows, "job_id long, org_key string, date string, date_iso string, tz string")
    zones = spark.createDataFrame([("a", "Asia/Kolkata")], "org_key string, tz string")
    got = {(r.job_id, r.field): r.epoch_us for r in normalise_dates(jobs, zones).collect()}
    assert got[1, "date"] == (1767312000 - 19800) * 10**6 and got[2, "date_iso"] == got[3, "date"] == 1767312000 * 10**6
    assert len(got) == 3 + 55
    assert normalise_dates(jobs.limit(0), zones).collect() == []
    path = f"file://{tmp_path}/dictionary"
    values = spark.createDataFrame([("1.1.2026", "UTC")], "value string, tz string")
    extend_dictionary(values, path)
    more = extend_dictionary(values.union(spark.createDataFrame([("2.1.2026", "UTC")], values.schema)), path)
    assert more.count() == 2  # the known value was not parsed again
    assert more.agg(F.max("epoch_us")).first()[0] == 1767312000 * 10**6
