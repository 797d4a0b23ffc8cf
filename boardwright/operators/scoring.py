"""Scores of links and pages as arithmetic over regular expressions: no UDF, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import domain_family, host

#: What raises and what lowers a link's score in extraction; unanchored, so 'rti' also hits 'advertisement'.
RELEVANT = ("recruit", "vacanc", "career", "job", "opening", "advertisement", "advt", "notification", "scientist", "programmer", "developer", "engineer", "project.?associate", "consultant", "officer", "technical.?assistant", "intern", "fellow", "jrf", "srf", "bharti", "naukri")
EXCLUDED = ("tender", "grievance", "rti", "contact", "about", "privacy", "disclaimer", "facebook", "twitter", "linkedin", "print", "feedback", "sitemap", "home", "gallery", "tenders", "faq", "help", "login", "register", "sign.?in", "sign.?up")
PATH_HINTS = ("/career", "/recruit", "/job", "/vacancy", "/openings")
#: Bonus and penalty words of discovery.
BONUS = ("apply", "openings", "positions", "current", "notification", "advertisement", "advt", "engagement", "hiring", "naukri", "bharti", "recruitment", "vacancy", "vacancies")
PENALTY = ("tender", "grievance", "rti", "contact us", "feedback", "sitemap")
#: Career and navigation words of the learned score, and the paths every family starts with.
CAREER_TERMS = ("recruitment", "career", "vacancy", "vacancies", "jobs", "openings", "opportunities", "advertisement", "notice", "apply", "join us", "join", "work with", "hiring")
NAVIGATION = ("about", "contact", "login", "faq", "gallery", "media", "tenders", "tender", "procurement", "bid", "circulars", "awards", "events", "news", "press")
SEED_PATHS = ("recruitment", "recruitments", "career", "careers", "jobs", "notice", "notices", "notice_category", "advertisement", "advertisements", "vacancies", "vacancy", "openings", "current-openings", "job-openings", "opportunities", "joinus", "join-us", "work-with-us", "notification", "notifications")
NOISE_SEGMENTS = ("index.html", "index.php", "index.asp", "index.aspx", "default.aspx", "en", "hi", "home", "page", "pages", "web", "static", "common", "content", "more", "category", "or", "and", "the", "in", "of")


def hit(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False)).cast("int")


def keyword_predicate(text: Column, words: list[str]) -> Column:
    """Whether text holds one of the words or phrases, white space flexible, edges at word ends, any case."""
    import re

    parts = [r"\s+".join(re.escape(w) for w in phrase.split()) for phrase in words]
    edge = r"[\p{L}\p{N}_]"
    return F.coalesce(text.rlike(rf"(?i)(?<!{edge})(?:{'|'.join(parts)})(?!{edge})"), F.lit(False))


def extraction_score(url: Column, text: Column, archived: Column | None = None) -> Column:
    """35 + 45 + 20 + 15 - 40 (and -50 in an archive): a link is kept from 35 on."""
    return extraction_sum(url, hit(text, RELEVANT), hit(text, EXCLUDED), archived)


def extraction_sum(url: Column, wanted: Column, noise: Column, archived: Column | None = None, hit: Callable = hit) -> Column:
    """extraction_score, with what the text gives (1 or 0) worked out already. hit: what looks for the words."""
    low = F.lower(url)
    pdf = (low.endswith(".pdf") | low.contains(".pdf?")).cast("int")
    bad = F.greatest(hit(url, EXCLUDED), noise)
    score = 35 * hit(url, RELEVANT) + 45 * wanted + 20 * F.coalesce(pdf, F.lit(0)) + 15 * hit(url, PATH_HINTS) - 40 * bad
    return score if archived is None else score - 50 * F.coalesce(archived, F.lit(False)).cast("int")


def discovery_score(url: Column, text: Column, patterns: tuple[str, ...]) -> Column:
    """40 for a pattern in the URL, 30 in the text, 20 for a bonus word, -20 for a penalty; not below 0."""
    bad = F.greatest(hit(url, PENALTY), hit(text, PENALTY))
    return F.greatest(F.lit(0), 40 * hit(url, patterns) + 30 * hit(text, patterns) + 20 * hit(text, BONUS) - 20 * bad)


def strength(score: Column) -> Column:
    return F.when(score >= 50, "strong").when(score >= 30, "weak").otherwise("none")


def path_segments(url: Column) -> Column:
    """Segments of a URL's path, empty ones dropped."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def learn_segments(links: DataFrame, home: str, target: str) -> DataFrame:
    """(family, segment, n, total): path segments of target URLs by family of the home's host.

    Noise is dropped before lower-casing, as written. Partial counts per task; one row per segment.
    """
    seg = links.select(domain_family(host(F.col(home))).alias("family"), F.explode(path_segments(F.col(target))).alias("s"))
    counts = seg.filter(~F.col("s").isin(*NOISE_SEGMENTS)).groupBy("family", F.lower("s").alias("segment")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("family").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "family")  # six families at most


def segment_score(n: Column, total: Column, segment: Column) -> Column:
    seed = segment.isin(*SEED_PATHS).cast("double") * 0.2
    return F.log1p(F.coalesce(n, F.lit(0)).cast("double")) / F.log1p(F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)).cast("double")) + seed


def learned_score(links: DataFrame, vocabulary: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(key, score) of links: career word 3, segments 5 times their score, '.pdf' 1, navigation words -2 each, floor 0.

    Each segment of a path counts, also where it repeats. Links without a path keep the rest of their score.
    """
    fam = domain_family(host(F.col(url)))
    base = links.select(F.col(key), F.col(url).alias("u"), F.col(text).alias("t"), fam.alias("family"))
    both = F.concat_ws("\n", F.lower("u"), F.lower("t"))
    minus = sum([F.when(both.contains(w), 2.0).otherwise(0.0) for w in NAVIGATION], F.lit(0.0))
    plain = 3.0 * hit(F.col("t"), CAREER_TERMS) + F.when(F.lower("u").endswith(".pdf"), 1.0).otherwise(0.0) - minus
    seg = base.select(key, "family", F.explode_outer(F.transform(path_segments(F.col("u")), F.lower)).alias("segment"), plain.alias("plain"))
    totals = vocabulary.select("family", "total").distinct()
    found = seg.join(vocabulary.select("family", "segment", "n"), ["family", "segment"], "left").join(F.broadcast(totals), "family", "left")
    part = F.when(F.col("segment").isNull(), 0.0).otherwise(5.0 * segment_score(F.col("n"), F.col("total"), F.col("segment")))
    return found.groupBy(key).agg(F.greatest(F.lit(0.0), F.max("plain") + F.sum(part)).alias("score"))


def candidate_urls(homes: DataFrame, vocabulary: DataFrame, key: str, url: str, n: int = 12) -> DataFrame:
    """(key, rank, url, score): the n best guesses at a site's career page, by segments learned for its family.

    Fixed patterns score 2.0 (nic.in), 1.5 and 1.4; a trailing slash takes a hundredth. Ties go by URL.
    """
    from pyspark.sql import Window as W

    families = homes.select(key, F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1).alias("root"), domain_family(host(F.col(url))).alias("family"))
    totals = vocabulary.select("family", "total").distinct()
    known = vocabulary.select("family", "segment", "n")
    seeds = families.select("family").distinct().select("family", F.explode(F.array(*[F.lit(s) for s in SEED_PATHS])).alias("segment"))
    segments = known.select("family", "segment").union(seeds).distinct().join(known, ["family", "segment"], "left").join(F.broadcast(totals), "family", "left")
    scored = segments.select("family", "segment", segment_score(F.col("n"), F.col("total"), F.col("segment")).alias("s"))
    top = scored.withColumn("r", F.row_number().over(W.partitionBy("family").orderBy(F.desc("s"), "segment"))).filter(F.col("r") <= 2 * n)
    learned = families.join(F.broadcast(top), "family")  # 2 n rows for each of six families
    pair = lambda path, score: F.struct(F.concat("root", path).alias("url"), score.alias("score"))
    slash = F.concat(F.lit("/"), "segment")
    a = learned.select(key, F.explode(F.array(pair(slash, F.col("s")), pair(F.concat(slash, F.lit("/")), F.col("s") * 0.99))).alias("c"))
    fixed = [pair(F.lit("/category/recruitment"), F.lit(1.5)), pair(F.lit("/category/recruitments"), F.lit(1.4))]
    nic = [pair(F.lit("/notice_category/recruitment"), F.lit(2.0)), pair(F.lit("/notice_category/recruitment/"), F.lit(2.0))]
    b = families.select(key, F.explode(F.when(F.col("family") == "nic.in", F.array(*fixed, *nic)).otherwise(F.array(*fixed))).alias("c"))
    best = a.union(b).groupBy(key, F.col("c.url").alias("url")).agg(F.max("c.score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "url")))
    return ranked.filter(F.col("rank") <= n)


#: Weight and greatest value of each page feature, and the bias.
PAGE_WEIGHTS = {"date_density": (2.5, 5.0), "job_kw_density": (3.0, 6.0), "anti_kw_count": (-1.5, 8.0), "table_rows": (0.05, 30.0), "list_items": (0.02, 50.0), "pdf_links": (1.2, 10.0), "link_density": (-0.03, 20.0), "structured_ratio": (0.8, 3.0)}
PAGE_BIAS = -2.0
#: What the page features count.
PAGE_DATES = r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4})|\b(?:\d{4}-\d{2}-\d{2})\b|\b(?:\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{4})\b"
PAGE_JOBS = r"(?i)\b(?:recruitment|vacancy|vacancies|application|apply|post|posts|appointment|engage|opening|career|careers|last\s+date|closing\s+date|walk.?in|notification|advt|advertisement|eligible|eligibility)\b"
PAGE_ANTI = r"(?i)\b(?:tender|e-tender|etender|bid|auction|quotation|rfp|eoi|procurement|press\s+release|annual\s+report|budget|policy|login|sign\s+in|captcha)\b"
LONGEST_PAGE = 100_000


def page_features(html: Column) -> Column:
    """The eight features of a page's first 100,000 characters; densities are per 1000 characters without tags."""
    page = F.substring(html, 1, LONGEST_PAGE)
    text = F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), r"\s+", " ")
    kilo = F.greatest(F.length(text), F.lit(1)) / 1000.0
    n = lambda of, rx: F.regexp_count(of, F.lit(rx))
    rows, items, links = n(page, r"(?i)<tr[\s>]"), n(page, r"(?i)<li[\s>]"), n(page, r"(?i)<a[\s>]")
    return F.struct(
        (n(text, PAGE_DATES) / kilo).alias("date_density"), (n(text, PAGE_JOBS) / kilo).alias("job_kw_density"), n(text, PAGE_ANTI).cast("double").alias("anti_kw_count"),
        rows.cast("double").alias("table_rows"), items.cast("double").alias("list_items"), n(page, r"(?i)href=[\"'][^\"']*\.pdf[\"']").cast("double").alias("pdf_links"),
        (links / kilo).alias("link_density"), ((rows + items) / F.greatest(links, F.lit(1))).alias("structured_ratio"),
    )


def page_score(html: Column, features: Column) -> Column:
    """Logistic score of clipped features; 0 for null pages and pages under 200 characters."""
    logit = sum([F.lit(w) * F.least(features[k], F.lit(top)) for k, (w, top) in PAGE_WEIGHTS.items()], F.lit(PAGE_BIAS))
    return F.when(F.length(html) >= 200, 1 / (1 + F.exp(-logit))).otherwise(F.lit(0.0))
