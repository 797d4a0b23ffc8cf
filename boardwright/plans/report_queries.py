"""Queries of diff, report, registry, browse, export, source and streaming operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright.functions import text
from boardwright.operators import browse, diff, export, registry, report, resolve, scoring
from boardwright.plans.posting_queries import PATTERNS, _any, _host, _q, _strip
from boardwright.session import read_table, scratch_path
from boardwright.sources import feeds, html
from boardwright.streaming import watch as watching

SHARED_HOSTS = ("nisrolmaium.ac.example", "gov.example")
ERROR_ROWS = "case when run_id % 7 = 3 and length(org_key) % 3 = 0 then 'error' when run_id % 11 = 5 and length(org_key) % 4 = 0 then 'server_down' else 'ok' end"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage(_t(spark, d, "jobs"), _t(spark, d, "org_registry"))


def coverage_total(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage_total(coverage_report(spark, d))


def tier_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.tier_summary(_t(spark, d, "jobs"), _t(spark, d, "orgs").filter("snapshot_id = 1"))


def source_percentages(spark: SparkSession, d: str) -> DataFrame:
    return report.tier_percentages(_t(spark, d, "jobs"), "source")


def _outcomes(jobs: DataFrame) -> DataFrame:
    return jobs.select("org_key", "run_id").distinct().withColumn("status", F.expr(ERROR_ROWS))


def outcome_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.outcome_totals(_outcomes(_t(spark, d, "jobs")))


def run_alerts(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "jobs")
    return diff.run_alerts(diff.with_hash(jobs).select("job_id", "org_key", "run_id", "hash"), _outcomes(jobs)).select("job_id", "run_id", "hash")


def new_per_run(spark: SparkSession, d: str) -> DataFrame:
    return report.running_total(run_alerts(spark, d).groupBy("run_id").agg(F.count("*").alias("new_postings")))


def state_changes(spark: SparkSession, d: str) -> DataFrame:
    jobs = diff.with_hash(_t(spark, d, "jobs"))
    return diff.changed_orgs(jobs.filter("run_id <= 20"), jobs.filter("run_id > 20"))


def next_state(spark: SparkSession, d: str) -> DataFrame:
    jobs = diff.with_hash(_t(spark, d, "jobs"))
    now = jobs.filter("run_id = 21")
    return diff.next_state(now, jobs.filter("run_id <= 20").select("org_key", "hash").distinct(), _outcomes(now))


def gone_postings(spark: SparkSession, d: str) -> DataFrame:
    jobs = diff.with_hash(_t(spark, d, "jobs"))
    now = jobs.filter("run_id > 20")
    return diff.gone_postings(now, jobs.filter("run_id <= 20").select("org_key", "hash").distinct(), _outcomes(now).filter("run_id = 21"))


def allowed_links(spark: SparkSession, d: str) -> DataFrame:
    kept = resolve.allow_links(_t(spark, d, "jobs").select("job_id", "org_key", "link"), _t(spark, d, "org_registry"), SHARED_HOSTS)
    return kept.select("job_id", "org_key")


def posting_merge(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "jobs").withColumn("link", F.coalesce("link", F.lit("")))
    return resolve.merge_postings(jobs, "run_id")


def merge_whole_orgs(spark: SparkSession, d: str) -> DataFrame:
    """Over all runs at once: an org with too many rows for one scan is split into independent parts."""
    jobs = _t(spark, d, "jobs").withColumn("pos", F.col("job_id"))
    return resolve.merge_postings(jobs)


def _browsed(spark: SparkSession, d: str, mode: str) -> DataFrame:
    flat = browse.flatten(_t(spark, d, "orgs").filter("snapshot_id = 6 and status = 'ok'"))
    once = flat.groupBy("org_key", "link").agg(F.min(F.struct("date_iso", "title", "tier", "name", "category")).alias("r")).select("org_key", "link", "r.*")
    found = browse.browse(once, category="other", text="e").withColumn("tie", F.concat_ws("|", "org_key", "link"))
    return report.ordered_index(found, browse.sort_order(mode, "tie")).select("idx", "org_key", "link", "date_iso")


def browse_newest(spark: SparkSession, d: str) -> DataFrame:
    return _browsed(spark, d, "newest")


def browse_oldest(spark: SparkSession, d: str) -> DataFrame:
    return _browsed(spark, d, "oldest")


def browse_by_org(spark: SparkSession, d: str) -> DataFrame:
    return _browsed(spark, d, "org")


def orgs_with_jobs(spark: SparkSession, d: str) -> DataFrame:
    return browse.orgs_with_jobs(_t(spark, d, "orgs"))


def relevant_markdown(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "jobs").select("job_id", "org_key", "relevance", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "link", "date")])
    return export.markdown_rows(jobs, _t(spark, d, "org_registry"), "job_id").withColumn("idx", F.col("idx").cast("long"))


def top_bottom(spark: SparkSession, d: str) -> DataFrame:
    return report.top_bottom(coverage_report(spark, d)).select("side", "rank", "org_key", "relevant_pct")


def _history(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).alias("seq")
    n = _t(spark, d, "events").groupBy(day).agg(F.count("*").alias("total"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("relevant"))
    return n.withColumn("relevant_pct", text.percent(F.col("relevant"), F.col("total")))


def trend(spark: SparkSession, d: str) -> DataFrame:
    return report.trend(_history(spark, d))


def trend_change(spark: SparkSession, d: str) -> DataFrame:
    return report.trend_change(_history(spark, d))


def archive_tail(spark: SparkSession, d: str) -> DataFrame:
    return report.archive_tail(_history(spark, d), 20)


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    message = F.expr("case event_id % 6 when 0 then 'ReadTimeout: timed out' when 1 then concat('HTTP ', cast(event_id as string)) when 2 then 'KeyError: title' when 3 then '' when 4 then 'Connection reset by peer' else 'list index out of range' end")
    e = _t(spark, d, "events").select("event_id", message.alias("error"), F.expr("cast(400 + event_id % 110 as int)").alias("status"))
    return e.select("event_id", text.failure_class(F.col("error")).alias("failure"), text.retry_needed(F.col("status"), F.col("error")).alias("retry"))


def registry_aliases(spark: SparkSession, d: str) -> DataFrame:
    return registry.mark_aliases(_t(spark, d, "org_registry").drop("duplicate_of"), "org_key").select("org_key", "duplicate_of")


def seed_registry(spark: SparkSession, d: str) -> DataFrame:
    cols = lambda t, i: t.select("org_key", "name", "url", F.lit(i).alias("pos"))
    seeded = _t(spark, d, "orgs").groupBy("org_key").agg(F.max("name").alias("name"), F.max("url").alias("url"))
    return registry.last_write_wins([cols(seeded, 0), cols(_t(spark, d, "org_registry"), 1)]).select("org_key", "name", "url")


def added_seeds(spark: SparkSession, d: str) -> DataFrame:
    seeds = _t(spark, d, "orgs").groupBy("org_key").agg(F.max("name").alias("name"), F.max("url").alias("url"))
    return registry.add_seeds(_t(spark, d, "org_registry").select("org_key", "name", "url"), seeds)


def portal_grid(spark: SparkSession, d: str) -> DataFrame:
    hosts = _t(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.lower(F.concat(F.lit("asia."), F.replace("n_name", F.lit(" "), F.lit("-")), F.lit(".gov.example"))).alias("host"))
    states = _t(spark, d, "nation").select(F.replace("n_name", F.lit(" "), F.lit("-")).alias("state"))
    return registry.portal_grid(states, _t(spark, d, "region").select(F.replace("r_name", F.lit(" "), F.lit("-")).alias("department")), hosts)


def org_batch(spark: SparkSession, d: str) -> DataFrame:
    return registry.batch(_t(spark, d, "org_registry"), 40, 60).select("org_key", "url")


def first_seen_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "jobs").filter("link is not null").select("org_key", "link", "job_id", "title")
    return report.first_seen(rows, ["org_key", "link"], "job_id").select("job_id", "org_key")


def best_links(spark: SparkSession, d: str) -> DataFrame:
    link, title = F.coalesce("link", F.lit("")), F.coalesce("title", F.lit(""))
    rows = _t(spark, d, "jobs").select("job_id", "org_key", scoring.discovery_score(link, title, PATTERNS).alias("score"))
    return report.best_candidates(rows.filter("score > 0"), "org_key", "score", "job_id")


def broken_hosts(spark: SparkSession, d: str) -> DataFrame:
    tries = _t(spark, d, "jobs").select("job_id", text.host(F.col("link")).alias("host"), F.expr("case when job_id % 5 = 0 then 'timeout' else 'ok' end").alias("status")).filter("host != ''")
    attempts = tries.select("host", F.col("job_id").alias("attempt"), "status")
    return registry.without_broken_hosts(tries.select("job_id", "host"), attempts)


def export_documents(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "jobs").filter("run_id = 5").withColumn("tier", F.col("relevance"))
    docs = export.export_orgs(jobs, _t(spark, d, "org_registry"), _outcomes(jobs))
    one = F.explode_outer("jobs").alias("j")
    return docs.select("org_key", "name", "status", "category", one).select("org_key", "name", "status", "category", "j.title", "j.link", "j.tier")


def export_run_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document per run and org; export_documents is the run that its SQL names."""
    jobs = _t(spark, d, "jobs").withColumn("tier", F.col("relevance"))
    docs = export.export_orgs(jobs, _t(spark, d, "org_registry"), _outcomes(jobs), ["run_id"])
    return docs.select("run_id", "org_key", "name", "status", "category", F.explode_outer("jobs").alias("j")).select("run_id", "org_key", "name", "status", "category", "j.title", "j.link", "j.tier")


def chat_chunks(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "jobs").filter("relevance = 'relevant'").join(F.broadcast(_t(spark, d, "org_registry").select("org_key", "name")), "org_key")
    text_of = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return export.chat_chunks(jobs.select(F.col("run_id").cast("string").alias("channel"), F.struct("org_key", "job_id").alias("o"), "name", text_of("title"), text_of("link")).withColumn("ord", F.concat_ws("|", "o.org_key", F.lpad(F.col("o.job_id").cast("string"), 12, "0"))).drop("o"))


def mail_sections(spark: SparkSession, d: str) -> DataFrame:
    return export.mail_sections(_t(spark, d, "jobs"), _t(spark, d, "org_registry"), ["run_id"])


def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return export.log_tail(_t(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"))


def feed_records(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document per run and org, written out of jobs, read back by the flexible reader."""
    one = F.to_json(F.struct(F.col("title").alias("name"), F.col("link").alias("href"), F.col("date_iso").alias("last_date"), F.col("job_id").alias("id")))
    rows = _t(spark, d, "jobs").filter("title is not null").select("run_id", "org_key", "job_id", one.alias("r"))
    docs = rows.groupBy("run_id", "org_key").agg(F.array_sort(F.collect_list(F.struct("job_id", "r"))).alias("x"))
    docs = docs.select(F.concat_ws("/", "org_key", F.col("run_id").cast("string")).alias("feed"), F.concat(F.lit('{"results":['), F.concat_ws(",", F.transform("x", lambda s: s["r"])), F.lit("]}")).alias("body"))
    return feeds.flexible_records(docs, "feed", "body", F.lit("https://feed.example"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Landed pages: the postings of each run and org as an HTML list under a menu."""
    cell = lambda c: text.escape_html(F.coalesce(c, F.lit("")))
    li = F.concat(F.lit('<li class="item"><a href="'), cell("link"), F.lit('">'), cell("title"), F.lit("</a> "), cell("date"), F.lit("</li>"))
    rows = _t(spark, d, "jobs").select("run_id", "org_key", "job_id", li.alias("li"))
    docs = rows.groupBy("run_id", "org_key").agg(F.min("job_id").alias("page_id"), F.array_sort(F.collect_list(F.struct("job_id", "li"))).alias("x"))
    body = F.concat(F.lit("<html><body><nav><a href='/about'>About us</a></nav><ul>"), F.concat_ws("", F.transform("x", lambda s: s["li"])), F.lit("</ul></body></html>"))
    return docs.select("page_id", F.concat(F.lit("https://"), "org_key", F.lit(".example/")).alias("url"), body.alias("html"))


def html_postings(spark: SparkSession, d: str) -> DataFrame:
    return html.extract_postings(_pages(spark, d))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return html.page_links(_pages(spark, d)).select("page_id", "pos", "link")


def script_apps(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><script>"), F.repeat(F.lit("<i>"), (F.col("doc_id") % 900).cast("int")), F.lit("</script><body>"), F.coalesce("text", F.lit("")), F.lit("</body></html>"))
    return _t(spark, d, "documents").select("doc_id", html.is_script_app(page).alias("is_app"))


def watch_stream(spark: SparkSession, d: str) -> DataFrame:
    """All runs through the stream, a third of them at a time, until nothing is left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    jobs = _t(spark, d, "jobs").filter("org_key is not null")
    arrivals = watching.arrivals_of(diff.with_hash(jobs), _outcomes(jobs))
    source, sink = scratch_path(spark, "arrivals"), scratch_path(spark, "alerts")
    runs = jobs.agg(F.max("run_id")).first()[0] or 0
    step = max(1, -(-(runs + 1) // 3))
    for low in range(0, runs + 1, step):  # three files, in order of landing
        arrivals.filter(F.col("run_id").between(low, low + step - 1)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(watching.ARRIVAL).option("maxFilesPerTrigger", 1).parquet(source)
    query = watching.watch(stream, sink, scratch_path(spark, "watch"))
    query.awaitTermination()
    return spark.read.schema(watching.ALERT).parquet(sink)


def queries() -> dict:
    return {f.__name__: f for f in (coverage_report, coverage_total, tier_summary, source_percentages, outcome_totals, run_alerts, new_per_run, state_changes, next_state, gone_postings, allowed_links, posting_merge, merge_whole_orgs, browse_newest, browse_oldest, browse_by_org, orgs_with_jobs, relevant_markdown, top_bottom, trend, trend_change, archive_tail, failure_classes, registry_aliases, seed_registry, added_seeds, portal_grid, org_batch, first_seen_links, best_links, broken_hosts, export_documents, export_run_documents, chat_chunks, mail_sections, log_tail, feed_records, event_props, html_postings, html_links, script_apps, watch_stream)}


_HASH = f"sha256(coalesce({_strip('title')}, '') || coalesce({_strip('link')}, ''))"
_PCT = "case when {w} = 0 then 0.0 else round_even(100.0 * {p} / {w}, 1) end"
_LABEL = "case when relevant_pct >= 80 then 'HIGH' when relevant_pct >= 50 then 'MEDIUM' when relevant_pct >= 20 then 'LOW' else 'NOISE' end"
_COVERAGE = f"""cnt as (select org_key, count_if(relevance = 'relevant') as relevant, count_if(relevance = 'uncertain') as uncertain from jobs group by 1),
 nm as (select org_key, min(name) as name from org_registry group by 1),
 cov0 as (select org_key, coalesce(name, upper(org_key)) as name, coalesce(relevant, 0) as relevant, coalesce(uncertain, 0) as uncertain, coalesce(relevant, 0) + coalesce(uncertain, 0) as total from nm full join cnt using (org_key)),
 cov1 as (select *, {_PCT.format(p='relevant', w='total')} as relevant_pct from cov0), cov as (select *, {_LABEL} as signal_quality from cov1)"""
_RUNS = f"""h as (select job_id, org_key, run_id, {_HASH} as hash from jobs), oc as (select distinct org_key, run_id, {ERROR_ROWS} as status from jobs),
 ok as (select org_key, run_id, lag(run_id) over (partition by org_key order by run_id) as before from oc where status = 'ok'),
 al as (select h.job_id, h.run_id, h.hash from h join ok using (org_key, run_id) where not exists (select 1 from h k where k.org_key = h.org_key and k.run_id = ok.before and k.hash = h.hash))"""
_HISTORY = f"hist0 as (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) as seq, count(*) as total, count_if(event_type in ('click', 'purchase')) as relevant from events group by 1), hist as (select *, {_PCT.format(p='relevant', w='total')} as relevant_pct from hist0)"
_HALVES = f"h as (select org_key, run_id, {_HASH} as hash from jobs), a as (select distinct org_key, hash from h where run_id <= 20), b as (select distinct org_key, hash from h where run_id > 20)"


def _browse_sql(order: str) -> str:
    return f"""with f as (select org_key, name, category, unnest(jobs) as j from orgs where snapshot_id = 6 and status = 'ok'),
 o as (select org_key, j.link as link, j.date_iso as date_iso, j.title as title, j.tier as tier, name, category, row_number() over (partition by org_key, j.link order by j.date_iso nulls first, j.title nulls first, j.tier nulls first, name nulls first, category nulls first) as r from f),
 k as (select *, nullif(date_iso, '') as day, concat_ws('|', org_key, link) as tie from o where r = 1 and category = 'other' and (coalesce(contains(lower(title), 'e'), false) or coalesce(contains(lower(name), 'e'), false)))
 select cast(row_number() over (order by {order}) as bigint) as idx, org_key, link, date_iso from k"""


def oracle_sql() -> dict[str, str]:
    link, title = "coalesce(link, '')", "coalesce(title, '')"
    worse = f"greatest({_any('l', scoring.PENALTY)}, {_any('t', scoring.PENALTY)})"
    return {
        "coverage_report": f"with {_COVERAGE} select * from cov",
        "coverage_total": f"with {_COVERAGE}, s as (select coalesce(sum(relevant), 0)::bigint as relevant, coalesce(sum(uncertain), 0)::bigint as uncertain, coalesce(sum(total), 0)::bigint as total from cov), p as (select *, {_PCT.format(p='relevant', w='total')} as relevant_pct from s) select *, {_LABEL} as signal_quality from p",
        "tier_summary": "with o as (select org_key, max(cast(status = 'ok' as int)) as ok from orgs where snapshot_id = 1 group by 1) select count(*) as total, count_if(relevance = 'relevant') as relevant, count_if(relevance = 'uncertain') as uncertain, count_if(relevance = 'excluded') as excluded, (select count_if(ok = 1) from o) as orgs_scraped, (select count_if(ok = 0) from o) as orgs_failed from jobs",
        "source_percentages": f"with n as (select source, count(*) as total, count_if(relevance = 'relevant') as relevant, count_if(relevance = 'uncertain') as uncertain, count_if(relevance = 'excluded') as excluded from jobs group by 1) select *, {', '.join(f'{_PCT.format(p=t, w="total")} as {t}_pct' for t in ('relevant', 'uncertain', 'excluded'))} from n",
        "outcome_totals": f"with oc as (select distinct org_key, run_id, {ERROR_ROWS} as status from jobs) select run_id, count(*) as orgs, count_if(status = 'ok') as ok, count_if(status = 'error') as error, count_if(status = 'server_down') as server_down from oc group by 1",
        "run_alerts": f"with {_RUNS} select * from al",
        "new_per_run": f"with {_RUNS}, n as (select run_id, count(*) as new_postings from al group by 1) select *, cast(sum(new_postings) over (order by run_id) as bigint) as running_total from n",
        "state_changes": f"with {_HALVES}, f as (select coalesce(a.org_key, b.org_key) as org_key, a.hash is null as added, b.hash is null as removed from a full join b on a.org_key = b.org_key and a.hash = b.hash) select org_key, count_if(added) as added, count_if(removed) as removed from f group by 1 having count_if(added) + count_if(removed) > 0",
        "next_state": f"with h as (select org_key, run_id, {_HASH} as hash, {ERROR_ROWS} as status from jobs), ok as (select distinct org_key from h where run_id = 21 and status = 'ok') select distinct org_key, hash from h where run_id <= 20 and org_key not in (select org_key from ok) union select distinct org_key, hash from h where run_id = 21 and org_key in (select org_key from ok)",
        "gone_postings": f"with {_HALVES}, ok as (select distinct org_key from (select org_key, {ERROR_ROWS} as status from jobs where run_id = 21) where status = 'ok') select a.org_key, a.hash from a where org_key in (select org_key from ok) and not exists (select 1 from b where b.org_key = a.org_key and b.hash = a.hash)",
        "allowed_links": f"""with r as (select org_key, regexp_replace({_host('url')}, '^www\\.', '') as h from org_registry), al as (select org_key, list_filter([h, case when regexp_matches(h, '(\\.gov\\.in|\\.nic\\.in|\\.edu\\.in|\\.ac\\.in|\\.co\\.in|\\.org\\.in|\\.res\\.in)$') then array_to_string(string_split(h, '.')[-3:], '.') end, case when regexp_matches(h, '(\\.edu|\\.org|\\.com|\\.net|\\.in)$') then array_to_string(string_split(h, '.')[-2:], '.') end, {', '.join(map(_q, SHARED_HOSTS))}], lambda x: x <> '') as doms from r),
  j as (select job_id, org_key, link, coalesce({_host('link')}, '') as host from jobs where trim(link, ' ') <> '') select j.job_id, j.org_key from j left join al using (org_key) where host = '' or len(list_filter(coalesce(doms, [{', '.join(map(_q, SHARED_HOSTS))}]), lambda x: host = x or ends_with(host, '.' || x))) > 0""",
        "browse_newest": _browse_sql("day desc nulls last, tie"),
        "browse_oldest": _browse_sql("day asc nulls last, tie"),
        "browse_by_org": _browse_sql("lower(name) asc nulls last, day desc nulls last, tie"),
        "orgs_with_jobs": "select distinct org_key from orgs where len(jobs) > 0",
        "relevant_markdown": f"with n as (select org_key, min(name) as name from org_registry group by 1), b as (select job_id, coalesce(name, upper(org_key)) as org, {title} as title, {link} as link, coalesce(nullif(date, ''), '-') as date from jobs left join n using (org_key) where relevance = 'relevant'), i as (select *, row_number() over (order by lower(org), lower(title), job_id) as idx from b) select cast(idx as bigint) as idx, job_id, '| ' || concat_ws(' | ', cast(idx as varchar), replace(org, '|', '\\|'), '[' || replace(title, '|', '\\|') || '](' || link || ')', date) || ' |' as line from i",
        "top_bottom": f"with {_COVERAGE}, held as (select * from cov where total > 0), r as (select *, row_number() over (order by relevant_pct desc, org_key) as best, row_number() over (order by relevant_pct, org_key) as worst from held) select 'top' as side, cast(best as int) as rank, org_key, relevant_pct from r where best <= 5 union all select 'bottom', cast(worst as int), org_key, relevant_pct from r where worst <= 5",
        "trend": f"with {_HISTORY}, l as (select * from hist order by seq desc limit 10) select *, round_even(relevant_pct - lag(relevant_pct) over (order by seq), 1) as delta from l",
        "trend_change": f"with {_HISTORY} select arg_min(relevant_pct, seq) as first_pct, arg_max(relevant_pct, seq) as last_pct, round_even(arg_max(relevant_pct, seq) - arg_min(relevant_pct, seq), 1) as change from hist",
        "archive_tail": f"with {_HISTORY} select * from hist order by seq desc limit 20",
        "failure_classes": f"with e as (select event_id, case event_id % 6 when 0 then 'ReadTimeout: timed out' when 1 then 'HTTP ' || event_id when 2 then 'KeyError: title' when 3 then '' when 4 then 'Connection reset by peer' else 'list index out of range' end as error, 400 + event_id % 110 as status from events) select event_id, case when error = '' then null when regexp_matches(lower(error), {_q('|'.join(text.NETWORK_SIGNS))}) then 'server_down' else 'error' end as failure, status in (401, 403, 429, 502, 503, 504) or regexp_matches(lower(error), 'connectionreseterror|10054|connection aborted|remotedisconnected|timeout') as retry from e",
        "registry_aliases": rf"with k as (select org_key, regexp_replace(regexp_replace(lower({_strip('url')}), '/+$', ''), '^https?://(?:www\.)?|^www\.', '') as u from org_registry), f as (select u, min(org_key) as first from k where u <> '' group by 1) select org_key, case when first <> org_key then first end as duplicate_of from k left join f using (u)",
        "seed_registry": "with s as (select org_key, max(name) as name, max(url) as url from orgs group by 1) select org_key, name, url from org_registry union all select org_key, name, url from s where org_key not in (select org_key from org_registry)",
        "added_seeds": "with s as (select org_key, max(name) as name, max(url) as url from orgs group by 1) select org_key, name, url from org_registry union all select * from s where not exists (select 1 from org_registry r where r.org_key = s.org_key)",
        "portal_grid": "with g as (select lower(replace(n_name, ' ', '-')) as s, lower(replace(r_name, ' ', '-')) as d from nation, region), k as (select lower('asia.' || replace(n_name, ' ', '-') || '.gov.example') as host from nation where n_nationkey % 3 = 0) select d || '_' || s as org_key, 'https://' || case when d || '.' || s || '.gov.example' in (select host from k) then d || '.' || s else s end || '.gov.example' as url from g",
        "org_batch": "select org_key, url from org_registry where duplicate_of is null or duplicate_of = '' order by org_key limit 60 offset 40",
        "first_seen_links": "select min(job_id) as job_id, org_key from jobs where link is not null group by org_key, link",
        "best_links": f"with b as (select job_id, org_key, {link} as l, {title} as t from jobs), s as (select job_id, org_key, greatest(0, 40 * {_any('l', PATTERNS)} + 30 * {_any('t', PATTERNS)} + 20 * {_any('t', scoring.BONUS)} - 20 * {worse}) as score from b), r as (select *, cast(row_number() over (partition by org_key order by score desc, job_id) as int) as rank from s where score > 0) select job_id, org_key, score, rank from r where rank <= 8",
        "broken_hosts": f"with t as (select job_id, {_host('link')} as host, case when job_id % 5 = 0 then 'timeout' else 'ok' end as status from jobs), dn as (select host from (select host, arg_min(status, job_id) as s from t group by 1) where s = 'timeout') select job_id, host from t where host <> '' and host not in (select host from dn)",
        "export_documents": f"with j as (select * from jobs where run_id = 5), oc as (select distinct org_key, {ERROR_ROWS} as status from j) select oc.org_key, coalesce(r.name, upper(oc.org_key)) as name, status, coalesce(category, 'other') as category, coalesce(title, '') as title, coalesce(link, '') as link, coalesce(relevance, '') as tier from oc left join org_registry r using (org_key) left join j using (org_key)",
        "log_tail": "select event_id as seq, event_type from events order by event_id desc limit 100",
        "feed_records": r"""with b as (select org_key || '/' || run_id as feed, job_id, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') as title, link, date_iso, cast(row_number() over (partition by run_id, org_key order by job_id) - 1 as int) as pos from jobs where title is not null)
  select feed, pos, title, coalesce(case when length(link) > 5 then link end, 'https://feed.example/' || job_id) as link, coalesce(case when date_iso <> '' then substr(date_iso, 1, 10) end, '') as date from b where length(title) > 3""",
        "event_props": "select event_id, try_cast(props->>'$.k' as int) as k from events",
        "script_apps": "with p as (select doc_id, '<html><script>' || repeat('<i>', cast(doc_id % 900 as int)) || '</script><body>' || coalesce(text, '') || '</body></html>' as html, text from documents) select doc_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) < 600 and 17 + 3 * (doc_id % 900) > 2000 as is_app from p",
    }
