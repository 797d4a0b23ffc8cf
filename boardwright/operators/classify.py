"""Layered classification of postings into relevant, uncertain and excluded.

The layers are fixed, what they look for isn't: word lists, profiles, org sets, overrides and thresholds come in a
Vocabulary. All cheap layers are one CASE over native expressions; models that need joins run only on rows that the layers before them leave open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.bind import let
from boardwright.functions.dates import normalize_date, year_of
from boardwright.functions.text import alpha_tokens, may_be_document
from boardwright.operators.models import profile_similarity
from boardwright.operators.scoring import keyword_predicate
from boardwright.session import materialize


@dataclass(frozen=True)
class Vocabulary:
    core: tuple[str, ...]
    other: tuple[str, ...]
    generic: tuple[str, ...]
    exclude: tuple[str, ...]
    wanted_urls: tuple[str, ...] = ()
    unwanted_urls: tuple[str, ...] = ()
    wanted_profile: tuple[str, ...] = ()
    unwanted_profile: tuple[str, ...] = ()
    first_orgs: tuple[str, ...] = ()
    guarded_prefix: str = "bank_"
    guarded_orgs: tuple[str, ...] = ("",)
    names: tuple[str, ...] = ()  # patterns of names that are cut out of a title before its words are looked at
    menu: tuple[str, ...] = ("faq", "home", "contact", "sitemap", "login")
    noise: str = r"(?i)^(?:about us|online payment|privacy policy|terms of use)$"
    overlap: float = 0.25
    overrides: tuple[tuple[str, str, str], ...] = field(default=())  # org_key, substring, class; in order


def overlap_similarity(tokens: Column, profile: tuple[str, ...]) -> Column:
    """Number of tokens of the profile over the norm of the term counts (no IDF, so it may exceed 1); 0 without tokens."""

    def of(t: Column) -> Column:
        count = lambda x: F.size(F.filter(t, lambda y: y == x)).cast("double")
        squares = F.aggregate(F.array_distinct(t), F.lit(0.0), lambda acc, x: acc + count(x) * count(x))
        hits = F.size(F.filter(t, lambda x: x.isin(*profile)))
        return F.when(hits > 0, hits.cast("double") / F.sqrt(squares)).otherwise(F.lit(0.0))

    return let(tokens, of) if profile else F.lit(0.0)


@dataclass(frozen=True)
class Evidence:
    """Columns of what models say of a row; null where they say nothing."""

    margin: Column | None = None  # log-odds of the positive class
    wanted: Column | None = None  # cosine to the centroid of the wanted profile
    unwanted: Column | None = None
    document: Column | None = None  # relevance of the document behind the link


#: Log-odds from which Bayes decides, cosine from which word vectors do, and by how much it must exceed the other.
BAYES_MARGIN, NEAR, AHEAD = 2.0, 0.55, 0.12


def _keywords(title: Column, words: tuple[str, ...]) -> Column:
    return keyword_predicate(title, list(words)) if words else F.lit(False)


def _url_hits(link: Column, words: tuple[str, ...]) -> Column:
    url = F.lower(F.coalesce(link, F.lit("")))
    return sum([F.when(url.contains(w), 1).otherwise(0) for w in words], F.lit(0))


def _stripped(title: Column, v: Vocabulary) -> Column:
    """C1: the title without the names that hold a keyword but aren't about one."""
    for pattern in v.names:
        title = F.regexp_replace(title, pattern, "")
    return title


def early(title: Column, link: Column, org: Column, v: Vocabulary) -> Column:
    """'relevance|layer' by C0 to C6, null for rows that are open after them. Null title and link count as ''."""
    title = F.coalesce(title, F.lit(""))
    named = _stripped(title, v)

    def layers(p: Column) -> Column:
        low = F.lower(p)
        noise = (F.length(p) < 4) | low.isin(*v.menu) | p.rlike(v.noise) | low.rlike(r"\d+(?:\.\d+)?\s*(?:kb|mb)\b")
        out = F.when(noise, "excluded|C0")
        for key, part, relevance in v.overrides:
            out = out.when((org == key) & F.concat(F.lit(" "), low, F.lit(" ")).contains(part), f"{relevance}|C2")
        out = out.when(_keywords(named, v.exclude), "excluded|C3").when(_keywords(named, v.core), "relevant|C4").when(_keywords(named, v.other), "relevant|C5")
        return out.when(_url_hits(link, v.unwanted_urls) > 0, "excluded|C6")

    return let(F.trim(F.regexp_replace(title, r"\s+", " ")), layers)


def late(title: Column, link: Column, org: Column, v: Vocabulary, models: Evidence = Evidence()) -> Column:
    """'relevance|layer' by C7 to C14 of rows that the early layers leave open; C7, C10 and C13 only with their evidence."""
    named = _stripped(F.coalesce(title, F.lit("")), v)
    guarded = F.coalesce(org.startswith(v.guarded_prefix) | org.isin(*v.guarded_orgs), F.lit(False))
    first = F.coalesce(org.isin(*v.first_orgs), F.lit(False)) if v.first_orgs else F.lit(False)
    none = F.lit(None).cast("double")
    margin, near, far = (none if c is None else c for c in (models.margin, models.wanted, models.unwanted))
    alike = lambda a, b: F.coalesce((a >= NEAR) & (a > b + AHEAD), F.lit(False))

    def layers(s: Column) -> Column:
        yes, no, generic = s["yes"], s["no"], s["generic"]
        out = F.when((margin > BAYES_MARGIN) & ((yes > 0) | alike(near, far) | generic), "relevant|C7").when((margin < -BAYES_MARGIN) & ~guarded, "excluded|C7")
        out = out.when((yes >= v.overlap) & (yes > no), "relevant|C8").when((no >= v.overlap) & (no > yes) & ~guarded, "excluded|C8")
        out = out.when(first & generic, "relevant|C9").when(alike(near, far), "relevant|C10").when(alike(far, near) & ~generic & ~guarded, "excluded|C10")
        out = out.when(first, "relevant|C11").when(_url_hits(link, v.wanted_urls) >= 2, "relevant|C12")
        if models.document is not None:
            out = out.when(models.document.isNotNull() & may_be_document(link), F.concat(models.document, F.lit("|C13")))
        return out.when(generic, "relevant|C14").otherwise("uncertain|C14")

    plain = F.trim(F.regexp_replace(named, r"\s+", " "))
    sides = lambda t: F.struct(overlap_similarity(t, v.wanted_profile).alias("yes"), overlap_similarity(t, v.unwanted_profile).alias("no"), _keywords(named, v.generic).alias("generic"))
    return let(let(alpha_tokens(plain), sides), layers)


def decide(title: Column, link: Column, org: Column, v: Vocabulary) -> Column:
    """'relevance|layer' by the first layer that fits, without models."""
    return F.coalesce(early(title, link, org, v), late(title, link, org, v))


def _outdated(cutoff_year: int) -> Column:
    return F.when(F.coalesce(year_of(F.col("date")) <= cutoff_year, F.lit(False)), "excluded|F3")


def _told(rows: DataFrame) -> DataFrame:
    return rows.withColumn("relevance", F.substring_index("_c", "|", 1)).withColumn("decided_by", F.substring_index("_c", "|", -1)).drop("_c")


def annotate(postings: DataFrame, v: Vocabulary, cutoff_year: int = 2025, as_null: bool = False) -> DataFrame:
    """postings with date_iso, relevance and decided_by. Dated up to cutoff_year: excluded before any other layer ('F3')."""
    c = F.coalesce(_outdated(cutoff_year), decide(F.col("title"), F.col("link"), F.col("org_key"), v))
    iso = normalize_date(F.col("date"))
    return _told(postings.withColumn("_c", c).withColumn("date_iso", F.nullif(iso, F.lit("")) if as_null else iso))


def annotate_with_models(
    postings: DataFrame, v: Vocabulary, key: str, margins: Callable[[DataFrame], DataFrame], vectors: DataFrame, texts: DataFrame, anchors: tuple[str, ...], cutoff_year: int = 2025
) -> DataFrame:
    """As annotate, with the layers C7, C10 and C13. Only rows that C6 leaves open are asked of the models.

    margins: gives (key, margin) of the open rows; vectors: (word, vec); texts: (link, text) of the documents behind
    links, the least text of a link where there are several; anchors: words of qualification that proximity is measured by.
    """
    iso = normalize_date(F.col("date"))
    first = F.coalesce(_outdated(cutoff_year), early(F.col("title"), F.col("link"), F.col("org_key"), v))
    rows = postings.withColumn("date_iso", iso).select("*", F.explode(F.array(first)).alias("_c"))  # a generator: worked out once
    rows = materialize(rows, "early-layers")
    open_rows = rows.filter("_c is null").drop("_c")
    tokens = open_rows.select(key, alpha_tokens(_stripped(F.coalesce("title", F.lit("")), v)).alias("w"))
    near = profile_similarity(tokens, key, "w", vectors, v.wanted_profile, v.unwanted_profile)
    asked = open_rows.filter(may_be_document(F.col("link"))).select("link").distinct()
    found = texts.join(asked, "link", "left_semi").groupBy("link").agg(F.min("text").alias("text"))
    said = found.select("link", proximity(F.col("text"), v.core + v.other, v.exclude, anchors).alias("_d")).filter("_d is not null")
    both = open_rows.join(margins(open_rows).select(key, F.col("margin").alias("_m")), key, "left").join(near.toDF(key, "_y", "_n"), key, "left").join(said, "link", "left")
    evidence = Evidence(F.col("_m"), F.coalesce("_y", F.lit(0.0)), F.coalesce("_n", F.lit(0.0)), F.col("_d"))
    decided = both.withColumn("_c", late(F.col("title"), F.col("link"), F.col("org_key"), v, evidence)).select(*rows.columns)
    return _told(rows.filter("_c is not null").unionByName(decided))


#: Characters around a qualification word that count as its context.
CONTEXT = 250


def proximity(text: Column, wanted: tuple[str, ...], unwanted: tuple[str, ...], anchors: tuple[str, ...]) -> Column:
    """relevance of a long text by words near anchors: a word counts 1, near an anchor 3; null under 50 characters.

    Contexts are the windows of CONTEXT characters around each anchor, overlapping ones too: a word lies in one iff
    the stretch between them is short enough, which look-ahead and look-behind free patterns state both ways.
    """
    edge = r"[\p{L}\p{N}_]"
    word = lambda w: rf"(?<!{edge}){w}(?!{edge})"
    near = rf"(?:{'|'.join(word(a) for a in anchors)})"

    def score(words: tuple[str, ...]) -> Column:
        parts = []
        for w in words:
            there = text.rlike(f"(?i){word(w)}")
            room = max(0, CONTEXT - len(w))
            close = text.rlike(f"(?is){near}.{{0,{room}}}{word(w)}|{word(w)}.{{0,{room}}}{near}")
            parts.append(F.when(there, F.when(close, 3).otherwise(1)).otherwise(0))
        return sum(parts, F.lit(0))

    yes, no = score(wanted), score(unwanted)
    return F.when(F.length(text) < 50, None).when(text.isNull(), None).when((yes > 0) & (yes > no), "relevant").otherwise("excluded")
