"""The operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, jaccard_rtree, license_digest, lsa_decontam, mixing, pii_bootstrap, rp_forest, suffix_dedup, toxicity_fm, warc_index
from .common import table


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_lsa_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan(table(spark, sf_dir, "documents"))


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.report(pii_bootstrap.extract(table(spark, sf_dir, "documents")))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ctw, op2_lsa_decontam, op3_rp_forest, op4_license_digest, op5_pii_bootstrap, op6_toxicity_fm, op7_mix_sources, op8_jaccard_rtree, op9_suffix_dedup, op10_warc_index, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_digest": license_digest.oracle(), "op7_mix_sources": mixing.ORACLE, "op10_warc_index": warc_index.ORACLE}
