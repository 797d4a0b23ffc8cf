"""Queries of text, date, score and classification operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright.functions import dates, text
from boardwright.operators import classify, models, scoring
from boardwright.plans.vocabulary import POSTINGS
from boardwright.session import read_table

PATTERNS = ("notice", "recruitment", "career", "advt")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "jobs")


def posting_dates(spark: SparkSession, d: str) -> DataFrame:
    date = F.coalesce("date", F.lit(""))
    return _jobs(spark, d).select("job_id", dates.find_date(date).alias("found"), dates.normalize_date(date).alias("iso"), dates.year_of(date).alias("year"))


def posting_keys(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", text.url_key(F.col("link")).alias("url_key"), text.title_key(F.col("title")).alias("title_key"))


def posting_identity(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", text.identity_hash(F.col("title"), F.col("link")).alias("hash"))


def host_families(spark: SparkSession, d: str) -> DataFrame:
    h = _jobs(spark, d).select("job_id", text.host(F.col("link")).alias("host"))
    return h.select("job_id", "host", text.registered_domain(F.col("host")).alias("domain"), text.domain_family(F.col("host")).alias("family"))


def title_scalars(spark: SparkSession, d: str) -> DataFrame:
    t, link = F.coalesce("title", F.lit("")), F.coalesce("link", F.lit(""))
    iso = F.when(F.col("date_iso").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_iso"))
    n = text.newness(iso.try_cast("date"), F.to_date(F.lit("2026-06-01")))
    return _jobs(spark, d).select(
        "job_id", text.is_pdf_link(F.col("pdf_link")).alias("is_pdf"), text.escape_html(t).alias("escaped"), text.content_route(link).alias("route"),
        n["days"].alias("days"), n["is_new"].alias("is_new"), F.concat_ws(" ", text.alpha_tokens(t)).alias("alpha"), F.concat_ws(" ", text.with_bigrams(text.alnum_tokens(t))).alias("bigrams"),
    )


def generic_titles(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", text.is_generic_title(F.col("title")).alias("generic"), text.file_title(F.coalesce("pdf_link", F.lit(""))).alias("file_title"))


def link_scores(spark: SparkSession, d: str) -> DataFrame:
    link, title = F.coalesce("link", F.lit("")), F.coalesce("title", F.lit(""))
    x = _jobs(spark, d).select("job_id", scoring.extraction_score(link, title).alias("extraction"), scoring.discovery_score(link, title, PATTERNS).alias("discovery"))
    return x.withColumn("strength", scoring.strength(F.col("discovery")))


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    v = POSTINGS
    hit = lambda words: scoring.keyword_predicate(F.col("title"), list(words))
    return _jobs(spark, d).select("job_id", hit(v.core).alias("core"), hit(v.other).alias("other"), hit(v.generic).alias("generic"), hit(v.exclude).alias("exclude"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    homes = read_table(spark, d, "org_registry").select("org_key", "url")
    links = _jobs(spark, d).select("org_key", "link").join(homes, "org_key")
    return scoring.learn_segments(links, "url", "link")


def segment_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d)


def learned_link_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs(spark, d).select("job_id", F.coalesce("link", F.lit("")).alias("link"), F.coalesce("title", F.lit("")).alias("title"))
    out = scoring.learned_score(rows, _vocabulary(spark, d), "job_id", "link", "title")
    return out.select("job_id", F.round("score", 6).alias("score"))


def candidate_urls(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.candidate_urls(read_table(spark, d, "org_registry"), _vocabulary(spark, d), "org_key", "url")
    return out.select("org_key", "url", F.round("score", 6).alias("score"), "rank")


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text", scoring.page_features(F.col("text")).alias("f"))
    return docs.select("doc_id", *[F.round(F.col(f"f.{k}"), 6).alias(k) for k in scoring.PAGE_WEIGHTS], F.round(scoring.page_score(F.col("text"), F.col("f")), 6).alias("score"))


def posting_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs(spark, d).select("job_id", "org_key", "title", "link", F.coalesce("date", F.lit("")).alias("date"))
    return classify.annotate(rows, POSTINGS).select("job_id", "date_iso", "relevance", "decided_by")


def overlap_similarities(spark: SparkSession, d: str) -> DataFrame:
    t = text.alpha_tokens(F.coalesce("title", F.lit("")))
    s = lambda p: F.round(classify.overlap_similarity(t, p), 6)
    return _jobs(spark, d).select("job_id", s(POSTINGS.wanted_profile).alias("wanted"), s(POSTINGS.unwanted_profile).alias("unwanted"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.with_bigrams(text.alnum_tokens(F.coalesce("title", F.lit(""))))
    return _jobs(spark, d).filter("relevance is not null").select("job_id", (F.col("relevance") == "relevant").alias("y"), tokens.alias("features"))


def bayes_weights(spark: SparkSession, d: str) -> DataFrame:
    _, weights = models.train_bayes(_examples(spark, d), "features", "y")
    return weights.select("feature", *[F.round(c, 6).alias(c) for c in ("lp_pos", "lp_neg")])


def bayes_margins(spark: SparkSession, d: str) -> DataFrame:
    rows = _examples(spark, d)
    priors, weights = models.train_bayes(rows, "features", "y")
    return models.predict_bayes(rows, "features", "job_id", priors, weights).select("job_id", F.round("margin", 4).alias("margin"))


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = models.centroids(read_table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "dim", F.round("mean", 6).alias("mean"))


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    out = models.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)
    return out.select("query", "rank", "key", F.round("cosine", 5).alias("cosine"))


def label_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    c = models.packed_centroids(e, "label", "embedding")
    both = e.select("vec_id", "label", "embedding").join(F.broadcast(c), "label")  # ten labels
    return both.select("vec_id", F.round(models.cosine(F.col("embedding"), F.col("centroid")), 5).alias("cosine"))


def title_word_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs(spark, d).select("job_id", text.alpha_tokens(F.coalesce("title", F.lit(""))).alias("w"))
    return models.word_pairs(rows, "job_id", "w").filter("n >= 2")


def text_proximity(spark: SparkSession, d: str) -> DataFrame:
    p = classify.proximity(F.col("text"), ("computer", "software", "server", "typing"), ("nurse", "forest", "hostel"), ("degree", "qualification", "experience"))
    return read_table(spark, d, "documents").select("doc_id", p.alias("relevance"))


def queries() -> dict:
    return {f.__name__: f for f in (posting_dates, posting_keys, posting_identity, host_families, title_scalars, generic_titles, link_scores, keyword_hits, segment_vocabulary, learned_link_scores, candidate_urls, page_scores, posting_classes, overlap_similarities, bayes_weights, bayes_margins, label_centroids, nearest_vectors, label_similarity, title_word_pairs, text_proximity)}


# The SQL below states each query anew for DuckDB. Shared pieces are Python helpers that give SQL text.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _iso(x: str) -> str:
    def n(p: str, g: int) -> str:
        return f"try_cast(regexp_extract({x}, {_q(p)}, {g}) as int)"

    def m(p: str, g: int) -> str:
        return f"nullif(list_position([{', '.join(map(_q, dates.MONTHS))}], lower(substr(regexp_extract({x}, {_q(p)}, {g}), 1, 3))), 0)"

    a, b = n(dates.NUMBERS, 1), n(dates.NUMBERS, 2)
    swap = f"({b} > 12 and {a} <= 12)"
    parts = [
        (n(dates.ISO, 1), n(dates.ISO, 2), n(dates.ISO, 3)),
        (n(dates.DAY_NAME, 3), m(dates.DAY_NAME, 2), n(dates.DAY_NAME, 1)),
        (n(dates.NAME_DAY, 3), m(dates.NAME_DAY, 1), n(dates.NAME_DAY, 2)),
        (n(dates.NUMBERS, 3), f"case when {swap} then {a} else {b} end", f"case when {swap} then {b} else {a} end"),
    ]
    one = lambda y, mo, da: f"case when (case when {y} < 100 then {y} + 2000 else {y} end) between 2000 and 2099 and {mo} between 1 and 12 and {da} between 1 and 31 then printf('%04d-%02d-%02d', case when {y} < 100 then {y} + 2000 else {y} end, {mo}, {da}) end"
    return "coalesce(" + ", ".join(one(*p) for p in parts) + ", '')"


def _year(x: str, iso: str) -> str:
    return rf"coalesce(case when {iso} <> '' then cast(substr({iso}, 1, 4) as int) end, try_cast(regexp_extract({x}, '\b(20\d{{2}})\b', 1) as int))"


def _host(x: str) -> str:
    return rf"lower(regexp_extract({x}, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _family(h: str) -> str:
    return f"""case when contains({h}, '.nic.in') then 'nic.in' when contains({h}, '.ac.in') or contains({h}, '.edu.in') or regexp_matches({h}, {_q(text.ACADEMIC_MARKS)}) then 'academic'
      when contains({h}, '.gov.in') then 'gov.in' when regexp_matches({h}, {_q(text.BANKING_MARKS)}) then 'banking'
      when contains({h}, '.co.in') or contains({h}, '.com') or contains({h}, '.org') then 'psu' else 'other' end"""


def _any(x: str, words: tuple[str, ...]) -> str:
    return f"cast(regexp_matches(lower({x}), {_q('|'.join(words))}) as int)"


def _kw(x: str, words: tuple[str, ...]) -> str:
    import re

    body = "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in words)
    return rf"coalesce(regexp_matches({x}, {_q(rf'(?i)(?:^|[^\pL\pN_])(?:{body})(?:$|[^\pL\pN_])')}), false)"


def _segments(x: str) -> str:
    return rf"list_filter(string_split(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"


_VOCABULARY = f"""seg as (select {_family(_host('r.url'))} as family, unnest({_segments('j.link')}) as s from jobs j join org_registry r using (org_key)),
 counts as (select family, lower(s) as segment, count(*) as n from seg where s not in ({', '.join(map(_q, scoring.NOISE_SEGMENTS))}) group by all),
 vocab as (select family, segment, n, cast(sum(n) over (partition by family) as bigint) as total from counts)"""
_SEEDS = f"[{', '.join(map(_q, scoring.SEED_PATHS))}]"


def _segment_score(n: str, total: str, s: str) -> str:
    return f"(ln(1 + coalesce({n}, 0)::double) / ln(1 + greatest(coalesce({total}, 0), 1)::double) + 0.2 * cast(list_contains({_SEEDS}, {s}) as double))"


def _tokens(x: str, letters: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^{letters}]+'), lambda t: length(t) > 1)"


def _overlap(tokens: str, profile: tuple[str, ...]) -> str:
    p = f"[{', '.join(map(_q, profile))}]"
    norm = f"list_sum(list_transform(list_distinct({tokens}), lambda t: power(len(list_filter({tokens}, lambda y: y = t)), 2)))"
    return f"case when len({tokens}) > 0 then len(list_filter({tokens}, lambda t: list_contains({p}, t))) / sqrt({norm}) else 0.0 end"


def _classify_sql() -> str:
    v = POSTINGS
    first = f"org_key in ({', '.join(map(_q, v.first_orgs))})"
    overrides = "\n".join(f" when org_key = {_q(o)} and contains(' ' || low || ' ', {_q(p)}) then '{c}|C2'" for o, p, c in v.overrides)
    wanted = " + ".join(f"cast(contains(url, {_q(w)}) as int)" for w in v.wanted_urls)
    unwanted = " + ".join(f"cast(contains(url, {_q(w)}) as int)" for w in v.unwanted_urls)
    return rf"""with base as (select job_id, org_key, coalesce(title, '') as title, coalesce(date, '') as date, lower(coalesce(link, '')) as url, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) as plain from jobs),
 iso as (select *, lower(plain) as low, {_iso('date')} as date_iso from base),
 tok as (select *, {_tokens('plain', 'a-z')} as w, {_year('date', 'date_iso')} as year from iso),
 sim as (select *, {_overlap('w', v.wanted_profile)} as yes, {_overlap('w', v.unwanted_profile)} as no from tok),
 said as (select job_id, date_iso, case when year <= 2025 then 'excluded|F3'
  when length(plain) < 4 or low in ({', '.join(map(_q, v.menu))}) or regexp_matches(plain, {_q(v.noise)}) or regexp_matches(low, '\d+(?:\.\d+)?\s*(?:kb|mb)\b') then 'excluded|C0'
  {overrides}
  when {_kw('title', v.exclude)} then 'excluded|C3' when {_kw('title', v.core)} then 'relevant|C4' when {_kw('title', v.other)} then 'relevant|C5'
  when {unwanted} > 0 then 'excluded|C6' when yes >= {v.overlap} and yes > no then 'relevant|C8'
  when no >= {v.overlap} and no > yes and not starts_with(coalesce(org_key, ''), '{v.guarded_prefix}') then 'excluded|C8'
  when {_kw('title', v.generic)} and {first} then 'relevant|C9' when {first} then 'relevant|C11' when {wanted} >= 2 then 'relevant|C12'
  when {_kw('title', v.generic)} then 'relevant|C14' else 'uncertain|C14' end as c from sim)
 select job_id, date_iso, split_part(c, '|', 1) as relevance, split_part(c, '|', 2) as decided_by from said"""


def _page_sql() -> str:
    n = lambda of, rx: f"len(regexp_extract_all({of}, {_q(rx)}))"
    logit = " + ".join(f"{w} * least({k}, {top})" for k, (w, top) in scoring.PAGE_WEIGHTS.items())
    tags = {"table_rows": r"(?i)<tr[\s>]", "list_items": r"(?i)<li[\s>]", "links": r"(?i)<a[\s>]", "pdf_links": "(?i)href=[\"'][^\"']*\\.pdf[\"']"}
    return rf"""with p as (select doc_id, text as html, substr(text, 1, {scoring.LONGEST_PAGE}) as page from documents),
 t as (select *, regexp_replace(regexp_replace(page, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') as txt from p),
 f as (select *, greatest(length(txt), 1) / 1000.0 as kilo, {', '.join(f"{n('page', rx)} as {k}" for k, rx in tags.items())} from t),
 g as (select doc_id, html, {n('txt', scoring.PAGE_DATES)} / kilo as date_density, {n('txt', scoring.PAGE_JOBS)} / kilo as job_kw_density, {n('txt', scoring.PAGE_ANTI)}::double as anti_kw_count,
  table_rows::double as table_rows, list_items::double as list_items, pdf_links::double as pdf_links, links / kilo as link_density, (table_rows + list_items) / greatest(links, 1) as structured_ratio from f)
 select doc_id, {', '.join(f"round({k}, 6) as {k}" for k in scoring.PAGE_WEIGHTS)}, round(case when length(html) >= 200 then 1 / (1 + exp(-({scoring.PAGE_BIAS} + {logit}))) else 0.0 end, 6) as score from g"""


_EXAMPLES = f"""tok as (select job_id, relevance = 'relevant' as y, {_tokens("coalesce(title, '')", 'a-z0-9')} as w from jobs where relevance is not null),
 ex as (select job_id, y, list_concat(w, list_transform(list_zip(w[1:greatest(len(w) - 1, 0)], w[2:]), lambda p: p[1] || '_' || p[2])) as features from tok),
 flat as (select y, unnest(features) as feature from ex),
 cnt as (select feature, count_if(y) as pos, count_if(not y) as neg from flat group by feature),
 wt as (select feature, ln((pos + 1.0) / (sum(pos) over () + count(*) over ())) as lp_pos, ln((neg + 1.0) / (sum(neg) over () + count(*) over ())) as lp_neg from cnt)"""


def oracle_sql() -> dict[str, str]:
    v = POSTINGS
    link, title = "coalesce(link, '')", "coalesce(title, '')"
    bad = f"greatest({_any('l', scoring.EXCLUDED)}, {_any('t', scoring.EXCLUDED)})"
    worse = f"greatest({_any('l', scoring.PENALTY)}, {_any('t', scoring.PENALTY)})"
    minus = " + ".join(f"2.0 * cast(contains(lower(l) || chr(10) || lower(t), {_q(w)}) as int)" for w in scoring.NAVIGATION)
    date = "coalesce(date, '')"
    plain = _strip("link")
    bare = f"lower({_strip(rf'''regexp_replace(split_part(split_part({plain}, '?', 1), '#', 1), '/$', '')''')})"
    second = "list_extract(string_split(regexp_replace(host, '^www\\.', ''), '.'), -2)"
    labels = "string_split(regexp_replace(host, '^www\\.', ''), '.')"
    return {
        "posting_dates": f"with b as (select job_id, {date} as date from jobs), i as (select *, {_iso('date')} as iso from b) select job_id, trim(regexp_extract(date, {_q(dates.ANY)}, 0)) as found, iso, {_year('date', 'iso')} as year from i",
        "posting_keys": rf"select job_id, coalesce(case when {plain} in ('', '#', 'javascript:void(0);') then '' else {bare} end, '') as url_key, coalesce(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') as title_key from jobs",
        "posting_identity": f"select job_id, sha256(coalesce({_strip('title')}, '') || coalesce({_strip('link')}, '')) as hash from jobs",
        "host_families": f"with h as (select job_id, coalesce({_host('link')}, '') as host from jobs) select job_id, host, array_to_string(case when {second} in ({', '.join(map(_q, text.SECOND_LEVEL))}) and contains(regexp_replace(host, '^www\\.', ''), '.') then {labels}[-3:] else {labels}[-2:] end, '.') as domain, {_family('host')} as family from h",
        "title_scalars": rf"""with b as (select *, {title} as t, {link} as l, lower(split_part(split_part({_strip(link)}, '?', 1), '#', 1)) as path, {_tokens(title, 'a-z0-9')} as w,
  case when regexp_matches(date_iso, '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast(date_iso as date) end as day from jobs)
  select job_id, coalesce(ends_with(lower(pdf_link), '.pdf') or contains(lower(pdf_link), '.pdf?'), false) as is_pdf, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped,
  case when regexp_matches(path, '\.pdf$') then 'pdf' when regexp_matches(path, '\.(?:docx?|xlsx?|pptx?|odt|rtf|csv)$') then 'office' when regexp_matches(path, '\.(?:jpe?g|png|gif|webp|svg|tiff?)$') then 'image' when regexp_matches(path, '\.(?:zip|rar|7z|t?gz|tar)$') then 'archive' else 'html' end as route,
  cast(day - date '2026-06-01' as int) as days, coalesce(day - date '2026-06-01' between -14 and 0, false) as is_new, array_to_string({_tokens('t', 'a-z')}, ' ') as alpha,
  array_to_string(list_concat(w, list_transform(list_zip(w[1:greatest(len(w) - 1, 0)], w[2:]), lambda p: p[1] || '_' || p[2])), ' ') as bigrams from b""",
        "link_scores": f"with b as (select job_id, {link} as l, {title} as t from jobs), s as (select job_id, 35 * {_any('l', scoring.RELEVANT)} + 45 * {_any('t', scoring.RELEVANT)} + 20 * cast(ends_with(lower(l), '.pdf') or contains(lower(l), '.pdf?') as int) + 15 * {_any('l', scoring.PATH_HINTS)} - 40 * {bad} as extraction, greatest(0, 40 * {_any('l', PATTERNS)} + 30 * {_any('t', PATTERNS)} + 20 * {_any('t', scoring.BONUS)} - 20 * {worse}) as discovery from b) select *, case when discovery >= 50 then 'strong' when discovery >= 30 then 'weak' else 'none' end as strength from s",
        "keyword_hits": f"select job_id, {_kw('title', v.core)} as core, {_kw('title', v.other)} as other, {_kw('title', v.generic)} as generic, {_kw('title', v.exclude)} as exclude from jobs",
        "segment_vocabulary": f"with {_VOCABULARY} select family, segment, n, total from vocab",
        "learned_link_scores": f"""with {_VOCABULARY}, b as (select job_id, {link} as l, {title} as t, {_family(_host(link))} as family from jobs),
  p as (select *, 3.0 * {_any('t', scoring.CAREER_TERMS)} + cast(ends_with(lower(l), '.pdf') as int) - ({minus}) as plain from b), s as (select job_id, family, unnest({_segments('l')}) as seg from b),
  tot as (select distinct family, total from vocab), x as (select s.job_id, sum(5 * {_segment_score('v.n', 'tot.total', 'lower(s.seg)')}) as part from s left join vocab v on v.family = s.family and v.segment = lower(s.seg) left join tot on tot.family = s.family group by 1)
  select p.job_id, round(greatest(0.0, plain + coalesce(part, 0)), 6) as score from p left join x using (job_id)""",
        "candidate_urls": f"""with {_VOCABULARY}, h as (select org_key, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) as root, {_family(_host('url'))} as family from org_registry), tot as (select distinct family, total from vocab),
  sg as (select family, segment from vocab union select distinct family, unnest({_SEEDS}) from h), sc as (select sg.family, sg.segment, {_segment_score('v.n', 'tot.total', 'sg.segment')} as s from sg left join vocab v using (family, segment) left join tot using (family)),
  top as (select * from sc qualify row_number() over (partition by family order by s desc, segment) <= 24), c as (select org_key, root || '/' || segment as url, s as score from h join top using (family) union all select org_key, root || '/' || segment || '/', s * 0.99 from h join top using (family)
   union all select org_key, root || '/category/recruitment', 1.5 from h union all select org_key, root || '/category/recruitments', 1.4 from h union all select org_key, root || unnest(['/notice_category/recruitment', '/notice_category/recruitment/']), 2.0 from h where family = 'nic.in'),
  m as (select org_key, url, max(score) as score from c group by 1, 2) select org_key, url, round(score, 6) as score, cast(row_number() over (partition by org_key order by score desc, url) as int) as rank from m qualify rank <= 12""",
        "page_scores": _page_sql(),
        "posting_classes": _classify_sql(),
        "overlap_similarities": f"with b as (select job_id, {_tokens(title, 'a-z')} as w from jobs) select job_id, round({_overlap('w', v.wanted_profile)}, 6) as wanted, round({_overlap('w', v.unwanted_profile)}, 6) as unwanted from b",
        "bayes_weights": f"with {_EXAMPLES} select feature, round(lp_pos, 6) as lp_pos, round(lp_neg, 6) as lp_neg from wt",
        "bayes_margins": f"with {_EXAMPLES}, one as (select job_id, unnest(features) as feature from ex), s as (select job_id, sum(lp_pos - lp_neg) as s from one join wt using (feature) group by 1), p as (select ln(count_if(y) + 1) - ln(count_if(not y) + 1) as prior from ex) select job_id, round(prior + coalesce(s, 0), 4) as margin from ex left join s using (job_id), p",
        "label_centroids": "with f as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) select label, cast(dim as int) as dim, round(avg(x::double), 6) as mean from f group by 1, 2",
        "nearest_vectors": "with p as (select a.vec_id as query, b.vec_id as key, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by query order by round(c, 12) desc, key) as rank from p) select query, cast(rank as int) as rank, key, round(c, 5) as cosine from r where rank <= 5",
        "label_similarity": "with f as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as dim from embeddings), m as (select label, dim, avg(x::double) as mean from f group by 1, 2), c as (select label, list(mean order by dim) as centroid from m group by 1) select vec_id, round(list_cosine_similarity(embedding::double[], centroid), 5) as cosine from embeddings join c using (label)",
        "title_word_pairs": f"with b as (select {_tokens(title, 'a-z')} as w from jobs), f as (select w, unnest(w) as word, generate_subscripts(w, 1) as i from b), p as (select word, unnest(w[greatest(i - 2, 1):i + 2]) as context from f) select word, context, count(*) as n from p where word <> context group by 1, 2 having count(*) >= 2",
    }
