"""SQL that must give the rows of the pN_found queries, by plain definitions over whole tables."""

_FORM = r"array_to_string(list_sort(list_filter(list_transform(string_split(lower(title), '|'), lambda p: regexp_replace(p, '[^\pL\pM\pN]+', '', 'g')), lambda p: p <> '')), '|')"
_LOW = r"lower(regexp_replace(link, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'))"
_QUERY = "substr(low, length(split_part(low, '?', 1)) + 2)"
_LINK = f"regexp_replace(split_part(low, '?', 1), '/$', '') || case when {_QUERY} = '' then '' else '?' || array_to_string(list_sort(string_split({_QUERY}, '&')), '&') end"
_WORDS = r"list_distinct(regexp_extract_all(lower(title), '[\pL\pM\pN]+'))"


def _forms(table: str, key: str, extra: str = "") -> str:
    return f"(select {key}, {extra} title, coalesce({_FORM}, '') as t, coalesce({_LINK}, '') as l from (select *, {_LOW} as low from {table}))"


_ALIKE = f"""w as (select id, t, {_WORDS} as ws from n where title is not null), k as (select id, t, len(ws) as a, unnest(ws) as x from w where len(ws) >= 6),
 alike as (select p.id as a, q.id as b, any_value(p.t) as ta, any_value(q.t) as tb from k p join k q on p.x = q.x and p.id < q.id group by 1, 2 having 17 * count(*) >= 7 * (any_value(p.a) + any_value(q.a)))"""
_BEST = "coalesce(arg_max(job_id, row({order}, job_id)) filter (where {valid}), 0)"
_RANK = "coalesce(trust, -2147483648), scraped_at"
_FIELDS = ("title", "apply_link", "pdf_link", "date", "date_iso", "tier")
_ROW = ", ".join(f"coalesce(j.{f}, '')" for f in _FIELDS)


def oracle_sql() -> dict[str, str]:
    http = lambda c: _BEST.format(order=_RANK, valid=f"starts_with({c}, 'http')")
    return {
        "p1_found": f"with n as (select job_id as id, * from {_forms('jobs', 'job_id')}), {_ALIKE} select a as job_a, b as job_b from alike where ta <> tb",
        "p2_found": f"with f as {_forms('jobs', 'job_id')}, g as (select t, l, min(job_id) as first_id from f where t <> '' and l <> '' group by 1, 2) select first_id, job_id from f join g using (t, l) where job_id > first_id",
        "p4_found": rf"""with s as (select source, max(trust) as trust from source_trust group by 1), f as (select f.*, length(regexp_replace(f.title, '[^\pL\pM\pN]+', '', 'g')) as n, j.apply_link, j.pdf_link, j.date, j.scraped_at, s.trust from {_forms('jobs', 'job_id')} f join jobs j using (job_id) left join s using (source))
  select min(job_id) as group_id, {_BEST.format(order='n, ' + _RANK, valid="t <> ''")} as title_id, {http('apply_link')} as apply_id, {http('pdf_link')} as pdf_id, {_BEST.format(order='scraped_at', valid=r"regexp_matches(date, '\p{Nd}')")} as date_id from f where l <> '' group by l having count(*) > 1""",
        "p5_found": f"""with u as (select 0 as b, job_id as i, title, link from jobs union all select batch_id, incoming_id, title, link from incoming), o as (select row_number() over (order by b, i) as id, * from u),
  n as (select f.* from {_forms('o', 'id')} f), {_ALIKE}, fst as (select t, l, min(id) as first from n where t <> '' and l <> '' group by 1, 2), cp as (select id from n join fst using (t, l) where id > first)
  select i as incoming_id, case when o.id in (select id from cp) then 'copy' else 'near' end as kind from o where b > 0 and (o.id in (select id from cp) or o.id in (select b from alike))""",
        "p10_found": "with s as (select doc_id, text, unnest(range(0, greatest(length(text) - 199, 0))) as p from documents), w as (select doc_id, p, hash(substr(text, p + 1, 200)) as h, hash(substr(text, p + 1, 200) || '#') as h2 from s), g as (select h, h2 from w group by 1, 2 having min(doc_id) < max(doc_id)), c as (select doc_id, least(200, coalesce(lead(p) over (partition by doc_id order by p) - p, 200)) as n from w join g using (h, h2)) select doc_id, cast(sum(n) as bigint) as shared_chars from c group by 1",
    }
