from pyspark.sql import functions as F

from boardwright.operators.diff import run_alerts
from boardwright.session import scratch_path
from boardwright.sources import feeds, html
from boardwright.streaming import watch

PAD = "<p>" + "filler text " * 12 + "</p>"
PAGE = f"""<html><head><script>var x = "<a href='/no'>no</a>";</script></head><body><nav><a href="/jobs">Jobs menu</a></nav>{PAD}
<ul><li>Posted 01/02/2026 <a href="/careers/sci.pdf">Recruitment of Scientist B</a></li>
<li class="archive"><a href="/careers/old-one.html">Recruitment of Officer</a>
<li><a href="/careers/sci.pdf#x">Recruitment of Scientist again</a>
<li><div><div><div><div><div>Junior Engineer vacancy, last date 5 Mar 2026 <a href="/files/a.html">View</a></div></div></div></div></div>
<li><a href="javascript:void(0)">Recruitment nothing</a><a href="/about">About us</a></ul></body></html>"""
ROWS = f"""<html><body>{PAD}<table><tr><th>h</th></tr><tr><td>Result sheet of 2.3.2026</td><td><a href="x/1.pdf">PDF</a></td></tr><tr><td>nothing</td></tr></table></body></html>"""


def pages(spark, *docs):
    return spark.createDataFrame([(i, "https://a.example/p/", d) for i, d in enumerate(docs)], "page_id long, url string, html string")


def test_anchor_extraction(spark):
    got = {r.title: r for r in html.extract_postings(pages(spark, PAGE, None, "short")).collect()}
    sci = got["Recruitment of Scientist B"]
    assert sci.link == "https://a.example/careers/sci.pdf" and sci.date == "01/02/2026" and sci.date_iso == "2026-02-01" and sci.score == 115
    assert "Recruitment of Scientist again" not in got and "About us" not in got and "Jobs menu" not in got  # first of a target, noise, menu
    assert not any("Officer" in t and r.score != 45 + 35 + 15 - 50 for t, r in got.items())
    assert any("Junior Engineer vacancy" in t and r.date == "5 Mar 2026" for t, r in got.items())


def test_row_fallback(spark):
    got = html.extract_postings(pages(spark, ROWS)).collect()
    assert [(r.via, r.date_iso, r.link) for r in got] == [("row", "2026-03-02", "https://a.example/p/x/1.pdf")]


def test_large_page(spark):
    """A page stays one row until its postings leave it: nothing of it is repeated for each element or shuffled, and all of it is read."""
    n = 20_000
    item = lambda i: f"<li><a href='/jobs/{i}'>{'View' if i % 1000 == 0 else f'Recruitment of Clerk {i}'}</a> 0{i % 9 + 1}/02/2026</li>"
    doc = "<html><body><ul>" + "".join(map(item, range(n))) + "</ul></body></html>"
    found = html.extract_postings(pages(spark, doc, PAGE, ROWS))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.select("page_id", "pos", "date_iso", "score", F.length("title").alias("n"), F.xxhash64("title").alias("h")).collect()
    got = [r for r in rows if r.page_id == 0]
    assert sorted(r.pos for r in got) == list(range(n)) and {r.score for r in got} == {95}
    assert all(r.date_iso == f"2026-02-0{r.pos % 9 + 1}" for r in got)
    whole = {(r.n, r.h) for r in got if r.pos % 1000 == 0}  # the text around a link that says nothing is the page's
    assert len(whole) == 1 and min(whole)[0] > 30 * n and max(r.n for r in got if r.pos % 1000) < 30
    assert sorted(r.page_id for r in rows if r.page_id) == [1, 1, 1, 2]


def test_plain_tags_are_read_as_by_the_parser():
    """What PLAIN_TAG reads itself gives what HTMLParser gives, whatever stands beside it."""
    import random

    class Tolerant(html.Outline):
        parse_starttag, parse_endtag = html.HTMLParser.parse_starttag, html.HTMLParser.parse_endtag

    parts = ["<a href='/x?a=1&amp;b=2'>", '<A HREF="y">', "<a href=z>", "<a href='q&copy=1'>", "</a>", "</A >", "<li class=x>", '<li class="archive" id="i">', "</li>", "<td>", "<tr>", "<br/>", "<br />", "<p", ">", "<img alt='5 < 6'>", "<img alt>",
             "<script>if (a<b) '</a>'", "</script>", "<style>", "</style>", "<!-- <a href='n'> -->", "<!doctype html>", "<nav>", "</nav>", "text ", "a &amp; b &lt", "<div id='i'class='o'>", "</div>", "<title>", "</title>", "<?x>", "</>", "<a\n href='u'\n>", "&#39;", "<b id=\"é\">"]
    rng = random.Random(5)
    for _ in range(3000):
        doc = "".join(rng.choices(parts, k=rng.randint(1, 30)))
        a, b = html.Outline(doc), Tolerant(doc)
        assert html.outlined(a, "https://a.example/") == html.outlined(b, "https://a.example/"), doc
        assert (a.words, a.tag, a.attrs, a.parent, a.opened) == (b.words, b.tag, b.attrs, b.parent, b.opened), doc
    links = ["https://a.b/c", "https://a.b/c?x=1&y=%20", "HTTPS://A.b/c", "https://a.b/c/../d", "http://a.b/", "https://a.b/c?", "https://a.b/c#", "https://a.b//x"]
    assert [html._joined("https://z.example/p/", x) for x in links] == [html.urljoin("https://z.example/p/", x) for x in links]


def test_short_cuts_of_the_rules(spark):
    """Sure words, plain words and the dates' common beginning decide as the whole rules do."""
    import random

    from boardwright.functions.dates import find_date
    from boardwright.functions.text import information_left
    from boardwright.operators.scoring import EXCLUDED, RELEVANT, hit

    parts = ["view", "more", " ", "  ", "12", "2026", "Dec", "december", "Decemberx", "here", "there", "Clerk", "ad", "advt", "-", "/", ".", ",", "_", "पद", "É", "İş", "1st", "Jan 5, 2026", "05/03/2026", "2026-01-02", "sign-in", "tender", "project associate", "skip to", "read", "old", "mayor", "PDF", "apply online", "(", ")"]
    rng = random.Random(7)
    texts = [(rng.choice((" ", "")).join(rng.choices(parts, k=rng.randint(0, 7))),) for _ in range(4000)]
    t = F.col("t")
    bare = F.trim(F.regexp_replace(t, r"[\s,.\-|]+$", ""))
    generic = (F.length(bare) < 4) | F.lower(bare).isin(*html.BARE_TITLES) | (information_left(bare) < 4)
    says = information_left(F.regexp_replace(t, html.AROUND_PHRASES, " ")) >= 4
    pairs = [(html._generic(t), generic), (html._says(t), says), (html._date(t), find_date(t)), (html._hit(t, RELEVANT), hit(t, RELEVANT)), (html._hit(t, EXCLUDED), hit(t, EXCLUDED))]
    rows = spark.createDataFrame(texts, "t string")
    assert [rows.filter(~a.eqNullSafe(b)).collect() for a, b in pairs] == [[]] * len(pairs)


def test_malformed_page(spark):
    bad = "<div><p>a<p>b<b>c<li><a href='/careers/x'>Recruitment <i>of</i> Clerk" + PAD
    assert [r.link for r in html.extract_postings(pages(spark, bad)).collect()] == ["https://a.example/careers/x"]


def test_other_extractors(spark):
    doc = f"""<html><body>{PAD}<div class="job-card"><h3>Clerk</h3><a href="/c">x</a></div><a href="/r1">Detailed advt R101</a><a href="/r0">Form R101</a>
    <table><tr><th>a</th></tr><tr><td>1</td><td>Cook</td><td>3</td><td>4</td><td>5</td></tr><tr><td>1</td></tr></table></body></html>"""
    p = pages(spark, doc)
    assert [(r.strategy, r.title) for r in html.card_postings(p, ("clerk",)).collect()] == [(1, "Clerk")]
    assert [(r.code, r.link) for r in html.group_by_code(html.page_links(p)).collect()] == [("R101", "https://a.example/r1")]
    assert [r.title for r in html.table_postings(p, F.lit("Org")).collect()] == ["Org — Cook"]
    assert html.keyword_links(p, ("advt",)).count() == 1
    loc = pages(spark, "<urlset><url><loc> https://a/x/job-list_1/ </loc></url></urlset>")
    assert [(r.url, r.text) for r in html.sitemap_locations(loc).collect()] == [("https://a/x/job-list_1/", "job list 1")]


def test_script_app(spark):
    docs = spark.createDataFrame([("<div id='root'></div>",), ("<p>x</p>",), (None,), ("<script " + "a='1' " * 500 + "></script>",)], "h string")
    assert [r.x for r in docs.select(html.is_script_app(F.col("h")).alias("x")).collect()] == [True, False, False, True]


def feed(spark, body):
    return spark.createDataFrame([("k", body, "HQ")], "k string, body string, centre string")


def test_json_feeds(spark):
    body = '{"posts":[{"id":7,"title":{"rendered":"<b>Clerk</b> post"},"date":"2026-01-02T00:00:00"},{"name":"ab","subject":"Long subject","link":"https://x/1"},{"id":1}]}'
    got = [tuple(r)[1:] for r in feeds.flexible_records(feed(spark, body), "k", "body", F.lit("https://b")).orderBy("pos").collect()]
    assert got == [(0, "Clerk post", "https://b/7", "2026-01-02"), (1, "Long subject", "https://x/1", "")]
    assert feeds.flexible_records(feed(spark, "not json"), "k", "body", F.lit("b")).collect() == []
    assert feeds.flexible_records(feed(spark, None), "k", "body", F.lit("b")).collect() == []
    paged = '{"data":{"content":[{"id":"1","title":"T","locations":["a","b","c","d"]},{"id":"1","title":"U"},{"id":"2","title":"V"}]}}'
    got = sorted((r.id, r.title) for r in feeds.paged_records(feed(spark, paged), "k", "body", F.lit("Org"), F.lit("L")).collect())
    assert got == [("1", "Org — T (a, b, c)"), ("2", "Org — V")]
    centre = '[[{"title":"<p>One</p>","link":"l","expiry_date":"x"},{"slug":"two-three","event_date":"y"}],[{"title":"One","link":"l"}]]'
    got = sorted((r.title, r.date) for r in feeds.centre_records(feed(spark, centre), "k", "body", "centre").collect())
    assert got == [("One", "x"), ("two three", "y")]
    dept = '[{"id":"1","title":"T","slug":"s","job_type":"full","end_date":"2026-01-02T1","departments":[{"name":"D"}]},{"title":"U"}]'
    got = [(r.title, r.link, r.date) for r in feeds.department_records(feed(spark, dept), "k", "body", F.lit("b")).orderBy("pos").collect()]
    assert got == [("T (D) [full]", "b/s", "2026-01-02"), ("U", "b", "")]


def test_rss(spark):
    rss = "<?xml version='1.0'?><rss><channel><item><title><![CDATA[Recruitment : Clerk]]></title><link>l</link><category>Vacancies</category></item><item><title>n</title><category>News</category></item></channel></rss>"
    assert [(r.title, r.link) for r in feeds.rss_items(feed(spark, rss), "k", "body").collect()] == [("Clerk", "l")]
    assert feeds.rss_items(feed(spark, "<html></html>"), "k", "body").collect() == []


def test_watch_equals_batch(spark):
    runs = {1: "ab", 2: "bc", 4: "a", 6: "bb"}
    rows = [(o, r, h) for o in "op" for r, hs in runs.items() for h in hs]
    outcomes = [(o, r, "error" if r == 3 and o == "o" else "ok") for o in "op" for r in range(1, 7)]
    p = spark.createDataFrame(rows, "org_key string, run_id long, hash string")
    q = spark.createDataFrame(outcomes, "org_key string, run_id long, status string")
    source, sink = scratch_path(spark, "arrivals"), scratch_path(spark, "sink")
    arrivals = watch.arrivals_of(p, q)
    for low in (1, 3, 5):
        arrivals.filter(F.col("run_id").between(low, low + 1)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(watch.ARRIVAL).option("maxFilesPerTrigger", 1).parquet(source)
    query = watch.watch(stream, sink, scratch_path(spark, "checkpoint"))
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.schema(watch.ALERT).parquet(sink).collect())
    expected = sorted(tuple(r) for r in run_alerts(p, q).select("org_key", "run_id", "hash").distinct().collect())
    assert got == expected and ("o", 4, "a") in got and ("p", 3, "b") not in got


def test_learn_online(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([("h", "c")], "home_url string, career_url string").write.parquet(src)
    s = spark.readStream.schema("home_url string, career_url string").parquet(src)
    watch.learn_online(s, out, f"file://{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(out).count() == 1


def test_home_candidates_and_documents(spark):
    doc = f"<html><body>{PAD}<a href='/careers/'>Careers</a><a href='/careers/'>Careers again</a><a href='/careers/x.pdf'>Careers</a><a href='https://b.example/careers'>Careers</a><a href='/zzz'>zzz</a></body></html>"
    got = [(r.url, r.text) for r in html.home_candidates(pages(spark, doc), ("career",)).collect()]
    assert got == [("https://a.example/careers/", "Careers")]
    t = html.document_texts(spark.createDataFrame([("u", "x" * 9000), ("u", "x" * 9000)], "url string, text string")).first()
    assert len(t.text) == 5000 and len(t.cache_key) == 16


def test_state_files(spark, tmp_path):
    from boardwright.sources import state

    schema = "org_key string, hash string"
    assert state.read_json(spark, f"file://{tmp_path}/none", schema).collect() == []
    (tmp_path / "s.json").write_text('{"org_key":"o","hash":"a"}\nnot json\n')
    before = state.read_json(spark, f"file://{tmp_path}/s.json", schema)
    assert [tuple(r) for r in before.collect()] == [("o", "a")]
    assert not state.write_state(before, before, f"file://{tmp_path}/a")
    after = spark.createDataFrame([("o", "b")], schema)
    assert state.write_state(before, after, f"file://{tmp_path}/b") and spark.read.parquet(f"file://{tmp_path}/b").count() == 1
    for i in range(3):
        last = state.append_history(spark.createDataFrame([(i, 1.0)], "seq int, relevant_pct double"), f"file://{tmp_path}/h", 2)
    assert sorted(r.seq for r in last.collect()) == [1, 2]


def test_domain_placement(spark):
    from boardwright.operators.models import max_similarity
    from boardwright.operators.registry import one_task_per_domain

    urls = spark.createDataFrame([(f"https://h{i}.d{i % 3}.gov.in/",) for i in range(30)], "url string")
    placed = one_task_per_domain(urls, "url").withColumn("p", F.spark_partition_id())
    assert placed.groupBy("domain").agg(F.count_distinct("p").alias("n")).filter("n > 1").count() == 0
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "word string, vec array<double>")
    t = spark.createDataFrame([(1, ["c", "b"]), (2, ["z"])], "k long, w array<string>")
    assert [(r.k, r.word, r.profile_word, round(r.cosine, 3)) for r in max_similarity(t, "k", "w", e, ["a"]).collect()] == [(1, "c", "a", 0.707)]
