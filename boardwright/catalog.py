"""The engine's names in SQL: tables as views, and scalar functions that stay in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from boardwright.session import read_table

TABLES = ("jobs", "incoming", "orgs", "org_registry", "org_zones", "documents", "source_trust", "source_targets", "pack_capacity", "events", "embeddings")
#: SQL functions, as the optimiser sees them: their bodies are inlined, so filters on them push like any expression.
FUNCTIONS = {
    "bw_strip": ("s STRING", "STRING", r"regexp_replace(s, '^\\s+|\\s+$', '')"),
    "bw_title_key": ("s STRING", "STRING", "coalesce(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ')), '')"),
    "bw_url_key": ("s STRING", "STRING", r"CASE WHEN s IS NULL OR regexp_replace(s, '^\\s+|\\s+$', '') IN ('', '#', 'javascript:void(0);') THEN '' ELSE lower(regexp_replace(substring_index(substring_index(regexp_replace(s, '^\\s+|\\s+$', ''), '?', 1), '#', 1), '/$', '')) END"),
    "bw_identity": ("t STRING, l STRING", "STRING", r"sha2(concat(coalesce(regexp_replace(t, '^\\s+|\\s+$', ''), ''), coalesce(regexp_replace(l, '^\\s+|\\s+$', ''), '')), 256)"),
    "bw_quality_label": ("p DOUBLE", "STRING", "CASE WHEN p >= 80 THEN 'HIGH' WHEN p >= 50 THEN 'MEDIUM' WHEN p >= 20 THEN 'LOW' ELSE 'NOISE' END"),
    "bw_percent": ("part BIGINT, whole BIGINT", "DOUBLE", "CASE WHEN whole = 0 THEN 0D ELSE bround(100D * part / whole, 1) END"),
}


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    """Views of the tables in sf_dir and the functions, for this session."""
    for t in tables:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
