import random
import re
import shutil

from pyspark.sql import functions as F

from boardwright.llm import blocking, copies, linkage, neardups, queries, residue, survivors
from boardwright.session import scratch_path

JOBS = "job_id long, title string, link string, org_key string, source string, scraped_at timestamp, apply_link string, pdf_link string, date string, nid long, h1 string"
INCOMING = "incoming_id long, batch_id int, title string, link string, date string, org_key string"
WORDS = "recruitment of clerk nurse post project engineer agra pune delhi board office notice walk in interview for grade two".split()


def made(seed, n):
    """Titles that are edits of few, with hot copies, nulls and texts of every dressing."""
    rng, rows = random.Random(seed), []
    base = [rng.sample(WORDS, rng.randrange(6, 14)) + [f"x{i}"] for i in range(max(2, n // 12))]
    for i in range(n):
        t = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(t))
            t = rng.choice([t[:k] + t[k + 1 :], t[:k] + [f"w{rng.randrange(40)}"] + t[k:], t[:k] + [f"e{rng.randrange(40)}"] + t[k + 1 :], t[k:] + t[:k]])
        title = rng.choice([" ".join, "  ".join, ", ".join, " | ".join])(t)
        title = rng.choice([title, title.upper(), title + "!", None, "", "one two"]) if rng.random() < 0.2 else title
        link = rng.choice([f"https://a.x/{i % 9}", f"HTTPS://a.x/{i % 9}/ ", f"https://a.x/p?b={i % 4}&a=1", f"https://a.x/p?a=1&b={i % 4}", None, "  "])
        rows.append((i + 1, title, link, "o", rng.choice(["s", "t", None]), None, None, "#", "", 7, "clash"))
    return rows


def words(t):
    return set(re.findall(r"\w+", (t or "").lower()))


def form(t):
    return "|".join(sorted(p for p in (re.sub(r"\W", "", x) for x in (t or "").lower().split("|")) if p))


def link_form(x):
    x = (x or "").strip().lower()
    path, _, query = x.partition("?")
    return re.sub("/$", "", path) + ("?" + "&".join(sorted(query.split("&"))) if query else "")


def is_alike(a, b):
    a, b = words(a), words(b)
    return len(a) >= 6 and len(b) >= 6 and 10 * len(a & b) >= 7 * len(a | b)


def brute_pairs(rows):
    return {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if form(a[1]) != form(b[1]) and is_alike(a[1], b[1])}


def test_near_pairs(spark):
    for seed in (1, 2):
        rows = made(seed, 260)
        got = [tuple(r) for r in neardups.near_pairs(spark.createDataFrame(rows, JOBS)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_near_pairs_where_no_word_is_rare(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(WORDS[:9], rng.randrange(6, 10))), *[None] * 9) for i in range(1, 150)]
    got = {tuple(r) for r in neardups.near_pairs(spark.createDataFrame(rows, JOBS)).collect()}
    assert got == brute_pairs(rows) and got


def test_near_pairs_edges(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    texts = [long, long + " more", None, "", "a b", " ".join(f"v{i}" for i in range(16)), " ".join(f"v{i}" for i in range(18)), " ".join(f"v{i}" for i in range(12)), " ".join(f"v{i}" for i in range(25))]
    rows = [(i, t, *[None] * 9) for i, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, JOBS)
    assert sorted(tuple(r) for r in neardups.near_pairs(df).collect()) == sorted(brute_pairs(rows)) == [(1, 2), (6, 7), (6, 8), (7, 9)]
    index = linkage.LinkageIndex.create(df.filter("job_id in (2, 6, 9)"), scratch_path(spark, "edges"))
    inc = df.filter("job_id not in (2, 6, 9)").select(F.col("job_id").alias("incoming_id"), F.lit(0).alias("batch_id"), "title", "link", "date", "org_key")
    assert sorted(r.incoming_id for r in linkage.Probe(index, inc, "incoming_id", "batch_id").known().collect()) == [1, 7, 8]
    assert neardups.near_pairs(df.limit(0)).collect() == []


def test_classes(spark):
    rows = made(4, 200)
    got = {r.job_id: (r.class_id, r.links) for r in neardups.near_classes(spark.createDataFrame(rows, JOBS)).collect()}
    titled = {r[0] for r in rows if len(words(r[1])) >= 6}
    assert set(got) == titled
    parent = {i: i for i in titled}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {r[0]: r[1] for r in rows}
    for a in titled:
        for b in titled:
            if a < b and is_alike(by[a], by[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert {i: c for i, (c, _) in got.items()} == {i: top(i) for i in titled}


def test_classes_of_all_rows(spark):
    """p1_classes has a row for each row of jobs; short titles are classed by exact copies, null ones alone."""
    rows = made(4, 90) + [(200 + i, t, link, *[None] * 9) for i, (t, link) in enumerate([("one two", "https://b.x"), (None, "https://b.x"), ("One, two!", "HTTPS://b.x/"), ("one two", None), ("", "https://b.x"), ("--", "https://b.x")])]
    df = spark.createDataFrame([r[:11] for r in rows], JOBS)
    path = scratch_path(spark, "tables")
    df.write.parquet(f"{path}/jobs.parquet")
    got = queries.p1_classes(spark, path).collect()
    assert sorted(r.job_id for r in got) == sorted(r[0] for r in rows)
    by, near = {r.job_id: (r.class_id, r.links) for r in got}, {r.job_id: (r.class_id, r.links) for r in neardups.near_classes(df).collect()}
    assert near and near.items() <= by.items()
    assert [by[i] for i in range(200, 206)] == [(200, 0), (201, 0), (200, 0), (203, 0), (204, 0), (205, 0)]


def test_copies(spark):
    rows = made(5, 400)
    first, expected = {}, set()
    for r in rows:
        k = (form(r[1]), link_form(r[2]))
        if all(k):
            if k in first:
                expected.add((first[k], r[0]))
            first.setdefault(k, r[0])
    df = spark.createDataFrame(rows, JOBS).repartition(5)
    got = [tuple(r) for r in copies.copies_found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    one = {r.first_id: r.copies for r in copies.collapsed(df).collect()}
    assert set(one) == set(first.values()) and sum(one.values()) == len(first) + len(expected)
    assert copies.copies_found(df.limit(0)).collect() == [] and copies.collapsed(df.limit(0)).collect() == []


def test_copies_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(copies, "RANGE_BITS", 1 << 8)
    monkeypatch.setattr(copies, "SEGMENT_BITS", 1 << 3)
    assert copies.ranges(200) == 10
    df = spark.createDataFrame(made(6, 200), JOBS)
    small = sorted(map(tuple, copies.copies_found(df).collect()))
    monkeypatch.undo()
    assert small == sorted(map(tuple, copies.copies_found(df).collect()))


def test_singletons_are_not_shuffled_however_many_ranges(spark, monkeypatch):
    """The share of distinct rows that the filter lets through stays small when the rows need many filters."""
    df = spark.range(20_000).selectExpr("id as job_id", "concat('title ', id) as title", "concat('https://a.x/', id) as link")
    monkeypatch.setattr(copies, "RANGE_BITS", 1 << 14)
    monkeypatch.setattr(copies, "SEGMENT_BITS", 1 << 12)
    assert copies.ranges(20_000) == 15
    assert copies.probed(df, "job_id").filter("maybe").count() < 1000


def brute_clusters(rows):
    """Least (batch, id) of the cluster of each row (ref, title, link); rows without a form and of few words have none."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    usable = [r for r in rows if len(words(r[1])) >= 6 or (form(r[1]) and link_form(r[2]))]
    for i, a in enumerate(usable):
        for b in usable[i + 1 :]:
            same = form(a[1]) == form(b[1]) and form(a[1]) and link_form(a[2]) == link_form(b[2]) and link_form(a[2])
            if same or is_alike(a[1], b[1]):
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    return {r[0]: find(r[0]) for r in usable}


def test_clusters(spark):
    """The mapping after each batch is that of all rows so far; clusters merge, and only what is touched is written."""
    rows = made(21, 110)
    history, later = rows[:70], [(r[0], i // 20, *r[1:3], "1.1.2026", "o") for i, r in enumerate(rows[70:])]
    # 901 is alike to two clusters of history that aren't alike to each other
    history += [(500, "a b c d e f g h i j", "https://q/1", *history[0][3:]), (501, "c d e f g h i j k l", "https://q/2", *history[0][3:])]
    later.append((901, 1, "b c d e f g h i j k", "https://q/3", "", "o"))
    jobs, df = spark.createDataFrame(history, JOBS), spark.createDataFrame(later, INCOMING)
    all_rows = [((-1, r[0]), r[1], r[2]) for r in history] + [((r[1], r[0]), r[2], r[3]) for r in later]
    expected = brute_clusters(all_rows)
    one = linkage.LinkageIndex.create(jobs, scratch_path(spark, "c1"), links=True, part_rows=20)
    step = linkage.LinkageIndex(spark, shutil.copytree(one.path, scratch_path(spark, "c2")))
    got = {r.incoming_id: (r.representative_batch, r.representative) for r in linkage.Probe(one, df, "incoming_id", "batch_id").clusters().collect()}
    assert got == {r[0]: expected[r[1], r[0]] for r in later if (r[1], r[0]) in expected}
    assert got[901] == (-1, 500)
    for b in sorted({r[1] for r in later}):
        batch, so_far = df.filter(F.col("batch_id") == b), brute_clusters([r for r in all_rows if r[0][0] <= b])
        step.append(batch, "incoming_id", "batch_id")
        got = {r.incoming_id: (r.representative_batch, r.representative) for r in linkage.Probe(step, batch, "incoming_id", "batch_id").clusters().collect()} if b else {}
        assert not b or got == {r[0]: so_far[b, r[0]] for r in later if r[1] == b and (b, r[0]) in so_far}
    assert (501,) in {(r.ref.id,) for r in spark.read.parquet(f"{step.path}/merges").collect()}


def test_a_probe_reads_the_parts_of_its_keys(spark):
    """A batch's reading is bounded by its keys, not by the history."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(8)), f"https://a.x/{i}", *made(1, 2)[0][3:]) for i in range(400)]
    index = linkage.LinkageIndex.create(spark.createDataFrame(rows, JOBS), scratch_path(spark, "pruned"), part_rows=10)
    probe = linkage.Probe(index, spark.createDataFrame([(1, 0, rows[7][1], "https://b/1", "", "o")], INCOMING), "incoming_id", "batch_id")
    assert index.parts == 40 and {(r.incoming_id, r.kind) for r in probe.known().collect()} == {(1, "near")}
    keys = blocking.blocks(probe.nodes, index.counts, index.total, blocking.MEETS_LONG)
    parts = lambda d: d.select(F.regexp_extract(F.input_file_name(), r"part=(\d+)", 1).alias("p")).distinct().count()
    assert 0 < parts(index._parts_of("blocks", keys, "key")) <= keys.count() < parts(spark.read.parquet(f"{index.path}/blocks"))


def test_linkage(spark):
    rows = made(7, 300)
    history, later = rows[:180], rows[180:]
    index = linkage.LinkageIndex.create(spark.createDataFrame(history, JOBS), scratch_path(spark, "linkage"))
    inc = [(r[0], i // 40, r[1], r[2], "1.1.2026", "o") for i, r in enumerate(later)]
    df = spark.createDataFrame(inc, INCOMING)
    got = {r.incoming_id: r.kind for r in linkage.Probe(index, df, "incoming_id", "batch_id").known().collect()}
    expected = {}
    for i, r in enumerate(later):
        before = history + later[:i]
        k = (form(r[1]), link_form(r[2]))
        if all(k) and any((form(b[1]), link_form(b[2])) == k for b in before):
            expected[r[0]] = "copy"
        elif any(is_alike(r[1], b[1]) for b in before):
            expected[r[0]] = "near"
    assert got == expected
    # batch by batch, the index appended to, gives the same
    again = {}
    for b in sorted({x[1] for x in inc})[:2]:
        one = df.filter(F.col("batch_id") == b)
        again |= {r.incoming_id: r.kind for r in linkage.Probe(index, one, "incoming_id", "batch_id").known().collect()}
        index.append(one, "incoming_id", "batch_id")
    assert again == {k: v for k, v in expected.items() if k in {x[0] for x in inc if x[1] < 2}}
    linked = linkage.LinkageIndex.create(spark.createDataFrame(history, JOBS), scratch_path(spark, "l2"), links=True)
    links = {r.incoming_id: r for r in linkage.Probe(linked, df, "incoming_id", "batch_id").links().collect()}
    assert set(links) == set(expected) and all((r.match_batch, r.match) < (b, i) for i, b in ((x[0], x[1]) for x in inc) if (r := links.get(i)))
    empty = linkage.Probe(linked, df.limit(0), "incoming_id", "batch_id")
    assert empty.known().collect() == [] and empty.links().collect() == [] and empty.clusters().collect() == []


def test_linkage_without_history(spark):
    none = spark.createDataFrame([], JOBS)
    index = linkage.LinkageIndex.create(none, scratch_path(spark, "none"))
    df = spark.createDataFrame([(1, 0, "a b c d e f g", "l", "", "o"), (2, 0, "a b c d e f h", "m", "", "o"), (3, 1, None, None, None, None)], INCOMING)
    assert {r.incoming_id: r.kind for r in linkage.Probe(index, df, "incoming_id", "batch_id").known().collect()} == {2: "near"}


def test_links_of_all_known_rows(spark):
    """Repeats within the batches and copies of short titles are linked too: links() has the keys of known()."""
    rows = made(8, 240)
    index = linkage.LinkageIndex.create(spark.createDataFrame(rows[:100], JOBS), scratch_path(spark, "l3"), links=True)
    more = ["solely in the batches a b c", "Solely, in the batches: a b c", "one two"]
    later = [(r[0], 1 + i // 40, r[1], r[2], "1.1.2026", "o") for i, r in enumerate(rows[100:])] + [(900 + i, 9, t, f"https://b.x/{i // 2}", "", "o") for i, t in enumerate([*more, "one two", "One two!"])]
    probe = linkage.Probe(index, spark.createDataFrame(later, INCOMING), "incoming_id", "batch_id")
    links = {r.incoming_id: r for r in probe.links().collect()}
    assert set(links) == {r.incoming_id for r in probe.known().collect()} >= {901, 903}
    assert (links[901].match, links[901].from_history, links[903].match) == (900, False, 902)


def test_links_to_the_row_that_agrees_best(spark):
    """Not the oldest row of a title, but that of the same link and day; titles of six words and short copies."""
    title = "clerk post at agra board office"
    history = [(1, title, "https://a.x/1", "o", "s", None, None, "#", "1.1.2026", 7, "c"), (2, title, "https://a.x/2", "o", "s", None, None, "#", "2.1.2026", 7, "c")]
    history += [(3, "one two", "https://a.x/3", "o", "s", None, None, "#", "1.1.2026", 7, "c"), (4, "one two", "https://a.x/3", "o", "s", None, None, "#", "2.1.2026", 7, "c")]
    index = linkage.LinkageIndex.create(spark.createDataFrame(history, JOBS).coalesce(1), scratch_path(spark, "best"), links=True)
    later = [(10, 1, title, "https://a.x/2", "2.1.2026", "o"), (11, 1, "One two", "https://a.x/3", "2.1.2026", "o"), (12, 2, title, "https://a.x/5", "5.1.2026", "o"), (13, 2, title, "https://a.x/5", "5.1.2026", "o")]
    got = {r.incoming_id: (r.match, r.from_history) for r in linkage.Probe(index, spark.createDataFrame(later, INCOMING), "incoming_id", "batch_id").links().collect()}
    assert got == {10: (2, True), 11: (4, True), 12: (1, True), 13: (12, False)}


def test_nearest_of_each_pattern(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(4), True, rng.randrange(4), rng.randrange(4), i) for i in rng.sample(range(1000), 40)]
    keep = {(n, h, x, y): min(r[4] for r in rows if r[:4] == (n, h, x, y)) for n, h, x, y, _ in rows}
    least = spark.createDataFrame([(*k, v) for k, v in keep.items()], "nid long, h boolean, link long, day long, ref long")
    pairs = spark.createDataFrame([(n, True, x, y) for n in range(4) for x in range(5) for y in range(5)], "b long, h boolean, link long, day long")
    got = linkage.nearest(pairs, least).collect()
    pick = lambda r, a, b: min((v for (n, _, x, y), v in keep.items() if n == r.b and (x == r.link) == a and (y == r.day) == b), default=None)
    assert len(got) == 100 and all((r.r11, r.r10, r.r01, r.r00) == (pick(r, True, True), pick(r, True, False), pick(r, False, True), pick(r, False, False)) for r in got)


def test_pattern_scores():
    counts = {(3, 1, 1): 60, (1, 0, 0): 300, (2, 1, 0): 20, (1, 0, 1): 10}
    s = linkage.pattern_scores(counts)
    assert s[3, 1, 1] > s[2, 1, 0] > s[1, 0, 0] and linkage.pattern_scores({}) == {}


def test_survivors(spark):
    from datetime import datetime as dt

    rows = [
        (1, "Clerk", "https://a/x", "o", "low", dt(2026, 1, 1), "http://1", None, "1.1.2026"), (2, "Clerk post", "https://A/x/", "o", "high", dt(2026, 1, 1), "http://2", "#", "soon"),
        (3, "clerk post", "https://a/x", "o", "high", dt(2026, 1, 2), "N/A", "", "2.1.2026"), (4, "alone", "https://b", "o", "low", None, None, None, None), (5, None, None, "o", None, None, None, None, None),
        (6, None, "https://c", "o", None, None, None, None, None), (7, "--", "https://c", "o", "zz", None, None, None, ""),
    ]
    jobs = spark.createDataFrame([(*r, 1, "c") for r in rows], JOBS)
    trust = spark.createDataFrame([("low", 1), ("high", 5)], "source string, trust int")
    got = sorted(tuple(r) for r in survivors.survivors(jobs, trust).collect())
    assert got == [(1, 3, 2, 0, 3), (6, 0, 0, 0, 0)]
    assert survivors.survivors(jobs.limit(0), trust).collect() == []


def test_truth_follows_reliable_sources(spark):
    rows = []
    for g in range(30):  # two good sources agree, a bad one differs, and in the last group good stands against bad
        for s, v in (("good", "t"), ("fine", "t"), ("bad", "u")):
            if g < 29 or s != "fine":
                rows.append((len(rows), f"{v} {g}", f"https://a/{g}", "o", s, None, None, None, None, 1, "c"))
    got = {r.group_id: r.value for r in survivors.discover_truth(spark.createDataFrame(rows, JOBS)).filter("field = 'title'").collect()}
    assert len(got) == 30 and all(v.startswith("t ") for v in got.values())
    assert survivors.discover_truth(spark.createDataFrame([], JOBS)).collect() == []


RESIDUE = {
    "placeholder": ["{{ job.title }}", "Walk-in for {designation} at X, Y, ABC12345", "<%= title %> posts", "Recruitment of <?= $heading ?>, N", "%%title%%", "@@org.name@@ | x", "[[advtNo]]", "__post_name__", "{%heading%}", "«vacancy.title»", "&lt;notice_title&gt;", "$title", "%s", "{0} posts in {1}", "[Insert name of post]", "[designation goes here]", "<post title here>", "(enter number)", "XX name of post XX", "${advtNo}", "#{NOTICE_TITLE}", "{{model.postName|default:''}}", "[department to be filled]"],
    "filler": ["Lorem ipsum dolor sit amet", "Your headline here", "undefined", "null | null", "[object Object]", "Test test 123", "xxxxxxxx", "Untitled document", "Hello world", "Sample notice title :: Agra Board ABC12345", "शीर्षक यहाँ लिखें"],
    "error": ["404 Not Found", "Error 500", "HTTP Status 503 - Service Unavailable", "Gateway Timeout (504)", "Erreur 404 : page introuvable", "Internal Server Error - Agra Board ABC12345", "Access Denied", "पृष्ठ उपलब्ध नहीं है", "ERR_404", "500 | Server fault", "Fatal error: Uncaught TypeError"],
    "script": ["Please enable JavaScript", "JavaScript is disabled", "Verify you are human", "कृपया जावास्क्रिप्ट सक्षम करें", "Veuillez activer JavaScript", "Checking your browser", "Your browser does not support scripts"],
    None: ["", None, "View", "JavaScript Developer | Board | Advt ABC12345", "Error Analysis Scientist, Agra (ABC12345)", "<Electrical> Cook under Agra Board", "{Civil} Wing Agra: Cook at Pune, code ABC12345", "[Insert Sheet B] Cook merit order Agra", "Template drawing Cook for $9000 grant, Agra", "Cook (50% by promotion, 50% direct) Agra", "Form 404 for Cook, Agra Board - #ABC12345", "Room 404 Agra Hospital: Cook interview moved", "Engagement of Cook in Agra [ABC_12345]", "Missing Persons Cell Agra: Cook", "Loading Supervisor | Agra Authority", "JavaScript and TypeScript Trainer Agra", "Tutorial: how to use {{ title }} in templates of notices", "Notes on `{{ title }}` and its use"],
}


def test_residue(spark):
    rows = [(k, t) for k, ts in RESIDUE.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i long, t string")
    got = {r.i: r.kind for r in residue.residue(df, "i", "t").collect()}
    assert {i: (k, t) for i, (k, t) in enumerate(rows) if got.get(i) != k} == {}
    assert residue.without_residue(df, "t").count() == len(RESIDUE[None])
    both = df.select("i", residue.residue_kind(F.col("t")).alias("k")).collect()
    assert all(got.get(r.i) == r.k for r in both)


def test_residue_beside_words_of_tutorials(spark):
    cases = {
        "Parse error: syntax error, unexpected end of file": "error", "Documentation Officer - please enable JavaScript": "script", "Documentation Officer lorem ipsum": "filler", "Recruitment of Documentation Officer {{department}}": "placeholder",
        "Tutorial Fellow (e.g. physics) for {{department}} at Agra": "placeholder", "Syntax error - 404 Not Found": "error", "Documentation Officer, Agra": None, "Template syntax: {{ title }} prints the heading of a notice": None, "Placeholders such as {{ title }} and their use in notices": None,
        "How to use the library - Agra | Recruitment to the posts of {{designation}}": "placeholder",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.k for r in df.select("t", residue.residue_kind(F.col("t")).alias("k")).collect()} == cases


def test_blocks_meet(spark):
    import numpy as np

    rng, counts = np.random.default_rng(1), np.ones(blocking.ORDER_SLOTS, np.int64)
    pool = rng.integers(-(2**62), 2**62, 24)
    counts[pool[:12] & (blocking.ORDER_SLOTS - 1)] = 5000
    pool = np.concatenate([pool, rng.integers(-(2**62), 2**62, 90)])
    for most in [17] * 150 + [24, 40, 60, 90] * 30:
        a = rng.choice(pool, rng.integers(max(6, most // 2), most), replace=False)
        b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - rng.integers(0, 4)), replace=False), rng.choice(pool, rng.integers(0, 3))]))
        if len(b) >= 6 and 17 * len(set(a) & set(b)) >= 7 * (len(a) + len(b)):
            row, key, _ = blocking.all_blocks(np.concatenate([a, b]), np.array([len(a), len(b)]), counts, 10_000, blocking.MEETS_LONG)
            assert set(key[row == 0]) & set(key[row == 1])
