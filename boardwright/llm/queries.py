"""The queries of the problems tagged llm: name -> callable of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boardwright.llm import copies, linkage, mixing, neardups, packing, residue, spans, survivors
from boardwright.llm.oracles import oracle_sql as oracle_sql
from boardwright.session import materialize, read_table, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardups.near_pairs(read_table(spark, d, "jobs"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardups.all_classes(read_table(spark, d, "jobs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_found(read_table(spark, d, "jobs"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(read_table(spark, d, "jobs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(read_table(spark, d, "jobs"), "job_id", "title").select("job_id")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(read_table(spark, d, "jobs"), "job_id", "title").groupBy("kind").count()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(read_table(spark, d, "jobs"), read_table(spark, d, "source_trust"))


def p4_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivors.discover_truth(read_table(spark, d, "jobs"))


def _probe(spark: SparkSession, d: str, links: bool = False) -> linkage.Probe:
    """An index of jobs, made once, and all batches of incoming in their order against it."""
    index = linkage.LinkageIndex.create(read_table(spark, d, "jobs"), scratch_path(spark, "linkage"), links=links)
    return linkage.Probe(index, read_table(spark, d, "incoming"), "incoming_id", "batch_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _probe(spark, d).known()


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    probe = _probe(spark, d, links=True)
    return probe.links().join(probe.clusters(), "incoming_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _probe(spark, d, links=True).clusters()


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"), read_table(spark, d, "pack_capacity"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(materialize(p8_pack(spark, d), "packed"), read_table(spark, d, "pack_capacity"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), read_table(spark, d, "source_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_collapsed, p3_found, p3_kinds, p4_found, p4_truth, p5_found, p5_links, p5_clusters, p8_pack, p8_fill, p9_mix, p9_shares, p10_found)}
