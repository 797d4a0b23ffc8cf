"""The org registry: union of generated families, aliases by URL, batches, merging of seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardwright.functions.text import seed_url_key


def last_write_wins(families: list[DataFrame], key: str = "org_key") -> DataFrame:
    """Union of families in order; of equal keys the row of the last family holds, in it the last ``pos``."""
    tagged = [f.withColumn("_ord", F.lit(i)) for i, f in enumerate(families)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = [c for c in rows.columns if c not in (key, "_ord")]
    order = F.struct("_ord", "pos") if "pos" in rows.columns else F.col("_ord")
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def mark_aliases(orgs: DataFrame, order: str) -> DataFrame:
    """orgs with duplicate_of: the first key (by order) with the same URL, null for the first itself and without URL."""
    keyed = orgs.withColumn("_u", seed_url_key(F.col("url")))
    first = keyed.filter("_u != ''").groupBy("_u").agg(F.min_by("org_key", order).alias("_first"))
    both = keyed.join(first, "_u", "left")
    return both.withColumn("duplicate_of", F.when(F.col("_first") != F.col("org_key"), F.col("_first"))).drop("_u", "_first")


def add_seeds(configured: DataFrame, seeds: DataFrame) -> DataFrame:
    """configured and the seeds whose key it lacks."""
    return configured.unionByName(seeds.join(configured.select("org_key"), "org_key", "left_anti"), allowMissingColumns=True)


def without_aliases(orgs: DataFrame) -> DataFrame:
    return orgs.filter("duplicate_of is null or duplicate_of = ''")


def batch(orgs: DataFrame, offset: int, limit: int) -> DataFrame:
    """A batch of targets: keys in order, aliases left out."""
    return without_aliases(orgs).orderBy("org_key").offset(offset).limit(limit)


def portal_grid(states: DataFrame, departments: DataFrame, hosts: DataFrame | None = None, suffix: str = "gov.example") -> DataFrame:
    """(org_key, url) for each state and department: the department's subdomain if hosts has it, else the state's domain.

    Both sides are generator dimensions of some dozens of rows.
    """
    names = F.array(*[F.lit(r.department.lower()) for r in departments.select("department").distinct().collect()])
    grid = states.select(F.lower("state").alias("s"), F.explode(names).alias("d")).select(F.concat_ws("_", "d", "s").alias("org_key"), F.concat(F.concat_ws(".", "d", "s"), F.lit("." + suffix)).alias("sub"), F.concat("s", F.lit("." + suffix)).alias("base"))
    if hosts is None:
        return grid.select("org_key", F.concat(F.lit("https://"), "sub").alias("url"))
    known = hosts.select(F.col("host").alias("sub")).distinct().withColumn("there", F.lit(True))
    both = grid.join(known, "sub", "left")
    return both.select("org_key", F.concat(F.lit("https://"), F.when(F.col("there"), F.col("sub")).otherwise(F.col("base"))).alias("url"))


def resolve_career(homes: DataFrame, cache: DataFrame, links: DataFrame, guesses: DataFrame, pages: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(org_key, career_url, via): cached URL, else the best-scored link, else the best guess whose landed page scores
    enough, else the home page. links: (org_key, url, score, pos), PDF links at 0.8 of their score; first of equals wins."""
    from boardwright.functions.text import is_pdf_link

    weight = F.col("score") * F.when(is_pdf_link(F.col("url")), 0.8).otherwise(1.0)
    best = links.filter(F.col("score") > 0).groupBy("org_key").agg(F.min_by("url", F.struct(-weight, F.col("pos"))).alias("link"))
    good = guesses.join(pages.filter(F.col("page_score") >= threshold).select("url"), "url", "left_semi")
    guess = good.groupBy("org_key").agg(F.min_by("url", F.struct(-F.col("score"), F.col("url"))).alias("guess"))
    kept = cache.groupBy("home").agg(F.min("career_url").alias("cached"))
    out = homes.join(kept, homes.url == kept.home, "left").join(best, "org_key", "left").join(guess, "org_key", "left")
    via = F.when(F.col("cached").isNotNull(), "cache").when(F.col("link").isNotNull(), "link").when(F.col("guess").isNotNull(), "guess").otherwise("home")
    return out.select("org_key", F.coalesce("cached", "link", "guess", "url").alias("career_url"), via.alias("via"))


def subpage_links(links: DataFrame, n: int = 3) -> DataFrame:
    """(page_id, url, score): the n best distinct links of a page with a score above 0; links: (page_id, url, score, pos)."""
    once = links.filter(F.col("score") > 0).groupBy("page_id", "url").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= n)


def open_hosts(attempts: DataFrame) -> DataFrame:
    """(host): hosts whose first attempt didn't time out; the rest of a host's URLs is not tried. attempts: (host, attempt, status)."""
    first = attempts.groupBy("host").agg(F.min_by("status", "attempt").alias("s"))
    return first.filter("s != 'timeout'").select("host")


def without_broken_hosts(urls: DataFrame, attempts: DataFrame) -> DataFrame:
    """URLs (host, url) but those of hosts that a first attempt found down."""
    down = attempts.groupBy("host").agg(F.min_by("status", "attempt").alias("s")).filter("s = 'timeout'").select("host")
    return urls.join(down, "host", "left_anti")


def one_task_per_domain(urls: DataFrame, url: str) -> DataFrame:
    """URLs placed so that all of a registered domain are in one partition, in order of URL: a fetcher that walks a
    partition row by row never meets a domain from two sides. The partition streams; it isn't gathered."""
    from boardwright.functions.text import host, registered_domain

    placed = urls.withColumn("domain", registered_domain(host(F.col(url))))
    return placed.repartition("domain").sortWithinPartitions("domain", url)
