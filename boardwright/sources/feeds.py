"""Postings out of landed JSON and RSS documents, as expressions over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys under which APIs wrap their list, and hold title, link and date.
WRAPPERS = ("data", "results", "items", "jobs", "records", "content", "list", "posts")
TITLES = ("title", "name", "post_title", "heading", "subject")
LINKS = ("link", "url", "href", "pdf", "file", "guid")
DATES = ("date", "last_date", "closing_date", "published", "created_at", "end_date", "updated_at")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def _records(body: Column) -> Column:
    """The JSON texts of the first list: the document itself, or under a wrapper key."""
    lists = [F.when(F.trim(body).startswith("["), body), *[F.get_json_object(body, f"$.{w}") for w in WRAPPERS], F.get_json_object(body, "$.data.content")]
    as_list = [F.when(x.startswith("["), x) for x in lists]
    return F.from_json(F.coalesce(*as_list), "array<string>")


def flexible_records(feeds: DataFrame, key: str, body: str, base: Column) -> DataFrame:
    """(key, pos, title, link, date) of any JSON list: the first title over 3 and link over 5 characters among the known
    keys, nested ``rendered`` and ``value`` too; the date is cut to 10 characters; an id makes up for a missing link.

    Documents that aren't JSON, or hold no list, give no rows; neither do records without a title.
    """
    rows = feeds.select(key, base.alias("_base"), F.posexplode(_records(F.col(body))).alias("pos", "r"))
    get = lambda *keys: [F.get_json_object("r", f"$.{k}") for k in keys]
    titles = [_plain(F.coalesce(a, b, c)) for t in TITLES for a, b, c in [get(f"{t}.rendered", f"{t}.value", t)]]
    title = F.coalesce(*[F.when(F.length(t) > 3, t) for t in titles])
    link = F.coalesce(*[F.when(F.length(x) > 5, x) for x in get(*LINKS)], F.concat("_base", F.lit("/"), F.get_json_object("r", "$.id")), F.col("_base"))
    date = F.coalesce(*[F.when(x != "", F.substring(x, 1, 10)) for x in get(*DATES)], F.lit(""))
    return rows.select(key, "pos", title.alias("title"), link.alias("link"), date.alias("date")).filter("title is not null")


def paged_records(feeds: DataFrame, key: str, body: str, org: Column, link: Column) -> DataFrame:
    """(key, id, title, link) of pages of ``data.content``: 'org - title (up to three places)', the first of each id of a feed."""
    schema = "struct<data: struct<content: array<struct<id: string, title: string, locations: array<string>>>>>"
    rows = feeds.select(key, org.alias("org"), link.alias("link"), F.posexplode(F.from_json(F.col(body), schema)["data"]["content"]).alias("pos", "r"))
    places = F.concat_ws(", ", F.slice(F.coalesce("r.locations", F.array().cast("array<string>")), 1, 3))
    title = F.concat(F.col("org"), F.lit(" — "), F.col("r.title"), F.when(places != "", F.concat(F.lit(" ("), places, F.lit(")"))).otherwise(""))
    ready = rows.select(key, "pos", F.col("r.id").alias("id"), title.alias("title"), "link").filter("id is not null")
    return ready.groupBy(key, "id").agg(F.min_by(F.struct("title", "link"), "pos").alias("b")).select(key, "id", "b.*")


def centre_records(feeds: DataFrame, key: str, body: str, centre: str) -> DataFrame:
    """(key, title, link, date, centre): records of a centre's list, which may be a list of lists; titles may be HTML or a slug;
    the date is the expiry, else the event's; the first of each title and link of a feed."""
    one = "array<struct<title: string, slug: string, link: string, event_date: string, expiry_date: string>>"
    flat = F.coalesce(F.flatten(F.from_json(F.col(body), f"array<{one}>")), F.from_json(F.col(body), one))
    rows = feeds.select(key, centre, F.posexplode(flat).alias("pos", "r"))
    title = F.coalesce(F.nullif(_plain(F.col("r.title")), F.lit("")), F.trim(F.replace(F.col("r.slug"), F.lit("-"), F.lit(" "))))
    date = F.coalesce(F.nullif("r.expiry_date", F.lit("")), F.nullif("r.event_date", F.lit("")), F.lit(""))
    ready = rows.select(key, centre, "pos", title.alias("title"), F.coalesce("r.link", F.lit("")).alias("link"), date.alias("date")).filter("title is not null")
    return ready.groupBy(key, "title", "link").agg(F.min_by(F.struct("date", centre), F.struct(centre, "pos")).alias("b")).select(key, "title", "link", "b.*")


def department_records(feeds: DataFrame, key: str, body: str, base: Column) -> DataFrame:
    """(key, pos, title, link, date): '(department) title [type]', link by slug, else id, else the base."""
    one = "array<struct<id: string, title: string, slug: string, job_type: string, start_date: string, end_date: string, departments: array<struct<name: string>>>>"
    rows = feeds.select(key, base.alias("base"), F.posexplode(F.from_json(F.col(body), one)).alias("pos", "r"))
    dept = F.get(F.col("r.departments"), F.lit(0))["name"]
    wrap = lambda x, a, b: F.when(x.isNotNull() & (x != ""), F.concat(F.lit(a), x, F.lit(b)))
    title = F.concat_ws(" ", "r.title", wrap(dept, "(", ")"), wrap(F.col("r.job_type"), "[", "]"))
    link = F.coalesce(*[F.concat("base", F.lit("/"), F.nullif(F.col(f"r.{c}"), F.lit(""))) for c in ("slug", "id")], F.col("base"))
    date = F.substring(F.coalesce(F.nullif("r.end_date", F.lit("")), F.nullif("r.start_date", F.lit("")), F.lit("")), 1, 10)
    return rows.filter("r.title is not null").select(key, "pos", title.alias("title"), link.alias("link"), date.alias("date"))


def rss_items(feeds: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, title, link, date) of RSS items whose category names vacancies, results or recruitment; a leading
    'Recruitment :' or 'Results:' is dropped. Documents without '<rss' or '<?xml' give no rows."""
    sniffed = F.lower(F.substring(F.col(body), 1, 500)).rlike(r"<\?xml|<rss")
    items = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    rows = feeds.filter(sniffed).select(key, F.posexplode(items).alias("pos", "x"))
    tag = lambda t: _plain(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    wanted = F.lower(tag("category")).rlike("vacanc|result|recruitment")
    title = F.regexp_replace(tag("title"), r"(?i)^\s*(?:recruitment|results)\s*:\s*", "")
    return rows.filter(wanted).select(key, "pos", title.alias("title"), tag("link").alias("link"), tag("pubDate").alias("date"))
