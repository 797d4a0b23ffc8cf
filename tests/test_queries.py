"""Every core query against its SQL on the smallest driver tables."""

import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "jobs", "incoming", "orgs", "org_registry", "org_zones", "source_trust", "source_targets", "pack_capacity")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
CORE = [k for m in entry.CORE for k in importlib.import_module(m).queries()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    res = duck.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


def test_documents_of_all_runs(spark, duck):
    """Chat messages, mail sections and documents are made of every run's postings."""
    q, one = entry.queries(), lambda sql: duck.execute(sql).fetchall()
    chat = q["chat_chunks"](spark, DATA).collect()
    assert {(int(r.channel),) for r in chat} == set(one("select distinct run_id from jobs where relevance = 'relevant'"))
    assert sum(line.startswith("- ") for r in chat for line in r.text.splitlines()) == one("select count(*) from jobs where relevance = 'relevant'")[0][0]
    mail = [tuple(r) for r in q["mail_sections"](spark, DATA).select("run_id", "org_key").collect()]
    assert sorted(mail) == sorted(one("select distinct run_id, org_key from jobs where relevance <> 'excluded'"))
    docs = [tuple(r) for r in q["export_run_documents"](spark, DATA).select("run_id", "org_key", "title").collect()]
    assert sorted(docs) == sorted(one("select run_id, org_key, coalesce(title, '') from jobs"))


def test_core_stands_alone():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "boardwright"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "boardwright.llm" not in f.read_text(), f


def test_sql_functions(spark):
    from boardwright.catalog import register

    register(spark, DATA)
    r = spark.sql("select bw_title_key('A-b') a, bw_url_key(' HTTP://x/?q ') b, bw_quality_label(50D) c, bw_percent(1, 16) d, bw_identity(' a', 'b ') = sha2('ab', 256) e, count(*) n from jobs").first()
    assert tuple(r)[:5] == ("a b", "http://x", "MEDIUM", 6.2, True) and r.n > 0
