"""The subpackage's queries for the driver: one query opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, decontam, fixity, line_dedup, near_dup, orc_tokens, packing, pii, quality_rules, secrets
from .common import read_table, spread, tune


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spread(read_table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf_dir))


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(_documents(spark, sf_dir)))


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.encode_corpus(_documents(spark, sf_dir))


def op5_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.drill(spread(read_table(spark, sf_dir, "pages")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_documents(spark, sf_dir))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_corpus(_documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(quality_rules.sample_labelled(docs, read_table(spark, sf_dir, "labels"))))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_mixture_packing, op3_pii_spans, op4_orc_tokens, op5_fixity_audit, op6_line_dedup, op7_lm_scores, op8_quality_rules, op9_near_duplicates, op10_benchmark_decontamination, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_fixity_audit": fixity.ORACLE_SQL, "op6_line_dedup": line_dedup.ORACLE_SQL, "op10_benchmark_decontamination": decontam.ORACLE_SQL}
