import random

import pytest
from pyspark.sql import functions as F

from boardwright.operators import browse, classify, diff, export, models, registry, report, resolve, scoring
from boardwright.operators.components import components
from boardwright.plans.vocabulary import POSTINGS

POSTING = "org_key string, pos long, title string, link string, date string, relevance string"


def merged(spark, rows, **kw):
    df = spark.createDataFrame([("o", i, *r) for i, r in enumerate(rows, 1)], POSTING)
    return sorted(tuple(r) for r in resolve.merge_postings(df, **kw).collect())


def test_merge_cases(spark):
    rows = [
        ("Programmer Posts 2026", "/a/x", "", "uncertain"), ("programmer posts, 2026", "/a/x.pdf", "01-07-2026", "relevant"),
        ("Programmer posts 2026", "/b/y.pdf", "", "excluded"), ("Another title", "/a/x?id=9", "", "excluded"), ("View", "/c/1", "", "uncertain"), ("View", "/c/2.pdf", "", "uncertain"),
    ]
    got = merged(spark, rows)
    assert len(got) == 4
    assert got[0] == ("o", 1, "Programmer Posts 2026", "/a/x", "/a/x", "/a/x.pdf", "01-07-2026", "relevant", 3)


def naive(rows):
    """The scan by its plain statement: first group with the URL, or with the title and without this kind of link."""
    import re

    def url(x):
        x = x.strip()
        return "" if x in ("", "#", "javascript:void(0);") else re.sub("/$", "", x.split("?")[0].split("#")[0]).strip().lower()

    rank, groups = {"relevant": 2, "uncertain": 1, "excluded": 0}, []
    for pos, (title, link, date, rel) in enumerate(rows, 1):
        if not title:
            continue
        pdf = link.lower().endswith(".pdf") or ".pdf?" in link.lower()
        key = re.sub("[^a-z0-9]+", " ", title.lower()).strip()
        hit = None
        for g in groups:
            same = url(link) and url(link) in [url(u) for u in (g["apply"], g["pdf"]) if u]
            if same or (key == g["key"] and key not in resolve.GENERIC_KEYS and len(key) > 8 and not g["pdf" if pdf else "apply"]):
                hit = g
                break
        if hit is None:
            hit = {"pos": pos, "title": title, "key": key, "date": "", "rel": rel, "apply": "", "pdf": "", "n": 0}
            groups.append(hit)
        hit["date"] = hit["date"] or date
        hit["rel"] = rel if rank[rel] > rank[hit["rel"]] else hit["rel"]
        hit["n"] += 1
        slot = "pdf" if pdf else "apply"
        hit[slot] = hit[slot] or link
    return sorted(("o", g["pos"], g["title"], g["apply"] or g["pdf"], g["apply"], g["pdf"], g["date"], g["rel"], g["n"]) for g in groups)


@pytest.mark.parametrize("seed", range(3))
def test_merge_against_plain_scan(spark, seed, monkeypatch):
    rng = random.Random(seed)
    titles = ["Programmer Posts", "programmer  posts", "Long title two", "View", "x", ""]
    links = ["/a", "/a/", "/a.pdf", "/b?x=1", "/b", "/b.pdf", "", "#", "/c.pdf?d"]
    rows = [(rng.choice(titles), rng.choice(links), rng.choice(["", "d1"]), rng.choice(["relevant", "uncertain", "excluded"])) for _ in range(40)]
    expected = naive(rows)
    assert merged(spark, rows) == expected
    monkeypatch.setattr(resolve, "SCAN_ROWS", 1)
    assert merged(spark, rows) == expected  # split into independent parts


def test_merge_nulls_and_empty(spark):
    df = spark.createDataFrame([("o", 1, None, None, None, None), ("o", 2, " \t", "l", "d", "x"), (None, 3, "t", "l", "d", "x"), ("o", 4, " t ", None, None, None)], POSTING)
    assert [tuple(r) for r in resolve.merge_postings(df).collect()] == [("o", 4, "t", "", "", "", "", "", 1)]  # untitled postings take no part
    assert resolve.merge_postings(df.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_allowed_links(spark):
    orgs = spark.createDataFrame([("g", "https://www.x.gov.in/a"), ("e", "http://y.example")], "org_key string, url string")
    rows = [("g", "https://z.gov.in/1"), ("g", "https://x.com"), ("g", "/rel"), ("g", " "), ("g", None), ("e", "https://sub.y.example"), ("e", "https://evily.example"), ("u", "https://y.example"), ("u", "https://all.example")]
    kept = resolve.allow_links(spark.createDataFrame(rows, "org_key string, link string"), orgs, ("all.example",))
    assert sorted(tuple(r) for r in kept.collect()) == [("e", "https://sub.y.example"), ("g", "/rel"), ("g", "https://z.gov.in/1"), ("u", "https://all.example")]


def test_link_scores(spark):
    rows = [("/careers/sci.pdf", "Recruitment of Scientist B", False, 115), ("/careers/sci.pdf", "Recruitment of Scientist B", True, 65), ("/notice/1.pdf", "Advertisement for Scientist", False, 25), ("/tender/1", "Tender notice", False, -40)]
    df = spark.createDataFrame(rows, "u string, t string, a boolean, s int")
    assert all(r.s == r.x for r in df.select("s", scoring.extraction_score(F.col("u"), F.col("t"), F.col("a")).alias("x")).collect())


def test_layers(spark):
    rows = [
        ("FAQ", "o", "", "C0"), ("Advt (1.5 MB)", "o", "", "C0"), ("Surveyor needed", "lab_rokfetpiium", "", "C2"), ("Staff  Nurse", "o", "", "C3"), ("Result of System Analyst test", "o", "", "C3"),
        ("System Analyst II", "o", "", "C4"), ("Web Designer", "o", "", "C5"), ("Gardener wanted", "o", "/uploads/x", "C6"), ("Computer aide", "o", "", "C8"), ("Museum aide", "o", "", "C8"),
        ("Museum aide", "bank_x", "", "C14"), ("Apprentice wanted", "lab_nisrolmaium", "", "C9"), ("Gardener wanted", "lab_nisrolmaium", "", "C11"), ("Gardener wanted", "o", "/software/notice", "C12"), ("Apprentice wanted", "o", "", "C14"), (None, None, None, "C0"),
    ]
    df = spark.createDataFrame([(*r, "1.1.2026") for r in rows], "title string, org_key string, link string, by string, date string")
    for r in classify.annotate(df, POSTINGS).collect():
        assert r.by == r.decided_by, r
    old = classify.annotate(df.withColumn("date", F.lit("1.1.2025")), POSTINGS).select("relevance", "decided_by").distinct().collect()
    assert [tuple(r) for r in old] == [("excluded", "F3")]


def test_models_decide_open_rows_only(spark):
    """Layers C1, C7, C10 and C13 in their places: before C8, before C11 and before C14."""
    from dataclasses import replace

    v = replace(POSTINGS, names=(r"(?i)\bstaff nurse institute\b",))
    rows = [
        (1, "o", "Young Professional", "", 3.0, "C7"), (2, "o", "Database Architect", "", -9.0, "C4"), (3, "bank_a", "Plain title", "", -9.0, "C14"), (4, "o", "Plain title", "", -9.0, "C7"),
        (5, "o", "Plain title", "", 9.0, "C14"), (6, "o", "wantedword title", "", 0.0, "C10"), (7, "o", "unwantedword title", "", 0.0, "C10"), (8, "lab_nisrolmaium", "unwantedword title", "", 0.0, "C10"),
        (9, "o", "Plain title", "https://a/file/1", 0.0, "C13"), (10, "o", "Staff Nurse Institute clerk", "", 0.0, "C14"), (11, "lab_nisrolmaium", "Plain title", "", 0.0, "C11"), (12, "o", "museum", "", 3.0, "C8"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "k long, org_key string, title string, link string").withColumn("date", F.lit(""))
    margins = spark.createDataFrame([(r[0], r[4]) for r in rows if r[4]], "k long, margin double")
    words = [("computer", [1.0, 0.0]), ("wantedword", [1.0, 0.1]), ("medical", [0.0, 1.0]), ("unwantedword", [0.1, 1.0])]
    texts = spark.createDataFrame([("https://a/file/1", "x " * 40), ("https://a/file/1", "y " * 40)], "link string, text string")
    got = classify.annotate_with_models(df, v, "k", lambda _: margins, spark.createDataFrame(words, "word string, vec array<double>"), texts, ("degree",)).collect()
    assert {r.k: r.decided_by for r in got} == {r[0]: r[5] for r in rows}
    assert {r.k: r.relevance for r in got if r.decided_by in ("C7", "C10", "C13")} == {1: "relevant", 4: "excluded", 6: "relevant", 7: "excluded", 8: "excluded", 9: "excluded"}


def test_proximity_windows(spark):
    near = "x " * 30 + "qualification " + "y " * 20 + "computer"
    far = "qualification " + "y " * 400 + "computer " + "nurse"
    rows = spark.createDataFrame([(1, near), (2, far), (3, "short"), (4, None)], "i int, t string")
    p = classify.proximity(F.col("t"), ("computer",), ("nurse",), ("qualification",))
    assert [r.x for r in rows.select("i", p.alias("x")).orderBy("i").collect()] == ["relevant", "excluded", None, None]


def test_bayes(spark):
    rows = spark.createDataFrame([(1, True, ["a", "b"]), (2, False, ["b", "c"]), (3, False, ["c"]), (4, None, ["z"])], "k long, y boolean, f array<string>")
    priors, weights = models.train_bayes(rows, "f", "y")
    w = {r.feature: (r.lp_pos, r.lp_neg) for r in weights.collect()}
    from math import isclose, log

    assert isclose(w["a"][0], log(2 / 5)) and isclose(w["c"][1], log(3 / 6)) and set(w) == {"a", "b", "c"}
    m = {r.k: r.margin for r in models.predict_bayes(rows, "f", "k", priors, weights).collect()}
    assert m[1] > m[2] and isclose(m[4], log(2 / 5) - log(3 / 5))


def test_nearest_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    one = sorted(tuple(r)[:3] for r in models.nearest(df, df, "k", "v", 3).collect())
    assert len(one) == 180 and one == sorted(tuple(r)[:3] for r in models.nearest(df, df, "k", "v", 3, most_queries=7).collect())
    assert models.nearest(df.limit(0), df, "k", "v", 3).collect() == []


def test_vectors(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>")
    t = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["z"])], "k long, w array<string>")
    assert {r.k: [round(x, 6) for x in r.x] for r in models.title_vectors(t, "k", "w", e, ("a",)).collect()} == {1: [0.5, 0.5]}
    got = {r.k: (round(r.wanted, 6), r.unwanted) for r in models.profile_similarity(t, "k", "w", e, ("a",), ("none",)).collect()}
    assert got == {1: (round(0.5**0.5, 6), 0.0), 2: (0.0, 0.0)}
    assert models.subset_embeddings(e, spark.createDataFrame([("a",), ("a",)], "word string")).count() == 1


def test_diff_runs(spark):
    post = lambda run, hs: [("o", run, h) for h in hs]
    rows = post(1, "ab") + post(2, "bc") + post(4, "a") + post(6, "b")
    p = spark.createDataFrame(rows, "org_key string, run_id int, hash string")
    o = spark.createDataFrame([("o", r, "error" if r == 3 else "ok") for r in range(1, 7)], "org_key string, run_id int, status string")
    got = sorted((r.run_id, r.hash) for r in diff.run_alerts(p, o).collect())
    assert got == [(1, "a"), (1, "b"), (2, "c"), (4, "a"), (6, "b")]
    state = spark.createDataFrame([("o", "x"), ("p", "y")], "org_key string, hash string")
    now = spark.createDataFrame([("o", "z"), ("o", "z")], "org_key string, hash string")
    out = spark.createDataFrame([("o", "ok"), ("p", "error")], "org_key string, status string")
    assert sorted(tuple(r) for r in diff.next_state(now, state, out).collect()) == [("o", "z"), ("p", "y")]
    assert diff.new_postings(now, state).count() == 2
    assert [tuple(r) for r in diff.gone_postings(now, state, out).collect()] == [("o", "x")]
    assert [tuple(r) for r in diff.changed_orgs(state, diff.next_state(now, state, out)).collect()] == [("o", 1, 1)]


def test_reports(spark):
    h = spark.createDataFrame([(i, float(p)) for i, p in enumerate([10, 30, 20, 50])], "seq int, relevant_pct double")
    assert [(r.seq, r.delta) for r in report.trend(h, 2).orderBy("seq").collect()] == [(2, None), (3, 30.0)]
    assert tuple(report.trend_change(h).first()) == (10.0, 50.0, 40.0)
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, pos int, v string")
    assert sorted(tuple(r) for r in report.first_seen(rows, ["k"], "pos").collect()) == [("a", 1, "x"), ("b", 3, "z")]
    big = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id")
    got = [(r.a, r.id) for r in report.ordered_index(big, [F.col("a"), F.col("id")]).orderBy("idx").collect()]
    assert got == sorted(got) and report.ordered_index(big, [F.col("a"), F.col("id")]).agg(F.max("idx")).first()[0] == 1000
    assert report.ordered_index(big.limit(0), [F.col("a"), F.col("id")]).collect() == []


def test_registry(spark):
    a = spark.createDataFrame([("k", "A", 0), ("m", "A", 1)], "org_key string, url string, pos int")
    b = spark.createDataFrame([("k", "B", 0)], a.schema)
    assert {r.org_key: r.url for r in registry.last_write_wins([a, b]).collect()} == {"k": "B", "m": "A"}
    al = {r.org_key: r.duplicate_of for r in registry.mark_aliases(spark.createDataFrame([("a", "http://X/"), ("b", "https://www.x"), ("c", ""), ("d", None)], "org_key string, url string"), "org_key").collect()}
    assert al == {"a": None, "b": "a", "c": None, "d": None}
    homes = spark.createDataFrame([(k, f"h{k}") for k in "abcd"], "org_key string, url string")
    cache = spark.createDataFrame([("ha", "cached")], "home string, career_url string")
    links = spark.createDataFrame([("b", "x.pdf", 10.0, 1), ("b", "y", 9.0, 2), ("b", "z", 9.0, 3)], "org_key string, url string, score double, pos int")
    guess = spark.createDataFrame([("c", "g1", 1.0), ("c", "g2", 2.0)], "org_key string, url string, score double")
    pages = spark.createDataFrame([("g1", 0.9), ("g2", 0.1)], "url string, page_score double")
    got = {r.org_key: (r.career_url, r.via) for r in registry.resolve_career(homes, cache, links, guess, pages).collect()}
    assert got == {"a": ("cached", "cache"), "b": ("y", "link"), "c": ("g1", "guess"), "d": ("hd", "home")}
    sub = spark.createDataFrame([(1, "u", 5.0, 1), (1, "u", 6.0, 2), (1, "v", 0.0, 3), (1, "w", 6.0, 4)], "page_id int, url string, score double, pos int")
    assert [(r.url, r["rank"]) for r in registry.subpage_links(sub).orderBy("rank").collect()] == [("u", 1), ("w", 2)]


def test_chunks():
    c = export.Chunker(limit=60, intro="hi\n")
    done = [m for line in [("Org", "a" * 20, "l"), ("Org", "b" * 20, "l"), ("Org", "c" * 20, "l")] for m in c.add(*line)] + c.end()
    assert [n for n, _ in done] == list(range(len(done))) and all(len(t) <= 60 for _, t in done)
    assert done[0][1].startswith("hi\n**Org**") and all(t.startswith("**Org**") for _, t in done[1:])


def test_export(spark):
    p = spark.createDataFrame([("a", 2, "t2", None), ("a", 1, "t1", "l"), ("a", 3, "<b>", "l")], "org_key string, pos long, title string, link string")
    p = p.select("*", *[F.lit("").alias(c) for c in ("apply_link", "pdf_link", "date", "date_iso")], F.lit("relevant").alias("tier"), F.lit("uncertain").alias("relevance"))
    orgs = spark.createDataFrame([("a", "A", "u", "main")], "org_key string, name string, url string, category string")
    out = spark.createDataFrame([("a", 1, "ok"), ("b", 1, "error")], "org_key string, run_id int, status string")
    got = {r.org_key: r for r in export.export_orgs(p, orgs, out).collect()}
    assert [j.title for j in got["a"].jobs] == ["t1", "t2", "<b>"] and got["a"].jobs[1].link == "" and got["b"].name == "B" and got["b"].jobs == []
    mail = export.mail_sections(p, orgs).first()
    assert mail.body.startswith("A\n[check] t1 - l") and "&lt;b&gt;" in mail.html


def test_browse(spark):
    rows = [("A", "main", "Clerk", "2026-01-01", "relevant", 1), ("b", "main", "nurse", "", "uncertain", 2), ("b", "other", "Clerk", "2026-02-01", "relevant", 3)]
    df = spark.createDataFrame(rows, "name string, category string, title string, date_iso string, tier string, tie int")
    ties = lambda d, mode: [r.tie for r in d.orderBy(*browse.sort_order(mode, "tie")).collect()]
    assert ties(df, "newest") == [3, 1, 2] and ties(df, "oldest") == [1, 3, 2] and ties(df, "org") == [1, 3, 2]
    assert ties(browse.browse(df, tier="relevant", text="CLERK", category="main"), "org") == [1]
    assert [r.tie for r in browse.page(df, browse.sort_order("newest", "tie"), 1, 1).collect()] == [1]
    assert [r.is_new for r in browse.with_newness(df, "2026-01-10").orderBy("tie").collect()] == [True, False, False]
