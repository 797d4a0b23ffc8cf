"""Queries of the general problems: snapshot differences and mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boardwright.operators.snapshots import snapshot_changes
from boardwright.operators.timestamps import normalise_dates
from boardwright.session import read_table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(read_table(spark, d, "orgs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_dates(read_table(spark, d, "jobs"), read_table(spark, d, "org_zones"))


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p7_found)}


_ROW = ", ".join(f"coalesce(j.{f}, '')" for f in ("title", "apply_link", "pdf_link", "date", "date_iso", "tier"))


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"""with recursive v as (select snapshot_id, org_key, status, jobs from (select *, row_number() over (partition by snapshot_id, org_key order by received_at desc) as r from orgs) where r = 1),
 src as (select snapshot_id, org_key, status, case when status = 'ok' then snapshot_id end as src from v where status = 'ok' or not exists (select 1 from v p where p.org_key = v.org_key and p.snapshot_id = v.snapshot_id - 1)
  union all select v.snapshot_id, v.org_key, v.status, src.src from v join src on src.org_key = v.org_key and src.snapshot_id = v.snapshot_id - 1 where v.status <> 'ok'),
 post as (select s.snapshot_id, s.org_key, coalesce(j.link, '') as link, list_sort(list(distinct hash({_ROW}))) as h from (select s.snapshot_id, s.org_key, unnest(v.jobs) as j from src s join v on v.org_key = s.org_key and v.snapshot_id = s.src) s group by 1, 2, 3),
 later as (select distinct snapshot_id from orgs where snapshot_id > (select min(snapshot_id) from orgs)),
 d as (select coalesce(n.snapshot_id, o.snapshot_id + 1) as snapshot_id, coalesce(n.org_key, o.org_key) as org_key, coalesce(n.link, o.link) as link, case when o.h is null then 'added' when n.h is null then 'removed' when n.h <> o.h then 'changed' end as change from post n full join post o on n.org_key = o.org_key and n.link = o.link and n.snapshot_id = o.snapshot_id + 1),
 e as (select coalesce(n.snapshot_id, o.snapshot_id + 1) as snapshot_id, coalesce(n.org_key, o.org_key) as org_key, '' as link, case when o.org_key is null then 'org_added' when n.org_key is null then 'org_removed' when n.status <> o.status then 'status' end as change from v n full join v o on n.org_key = o.org_key and n.snapshot_id = o.snapshot_id + 1)
 select * from (select * from d union all select * from e) where change is not null and snapshot_id in (select snapshot_id from later)""",
    }
