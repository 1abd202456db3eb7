"""The training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last
with the columns of documents. run() writes each stage's result in the shared scratch folder and reads it back for
the next.

Defined cases, in all stages: rows stand for themselves, so a doc_id may be null or repeat; columns besides those of
documents, whatever their names, stay to the last stage but one; an empty table gives no rows. A null or empty text
fails the quality rules. An empty table of labels leaves the line field to generated samples, and one of benchmark items
removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrollmine.llm import decontam, line_dedup, near_dup, packing, quality_rules
from scrollmine.llm.common import materialize, read_table, spread, tune


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go; so do null and empty texts. Repeated rows share a verdict."""
    tune(spark)
    docs = spread(docs)
    field = quality_rules.fit(quality_rules.sample_labelled(docs, read_table(spark, sf_dir, "labels")))
    return quality_rules.keep_good(docs, field)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines are deleted; a document that consists of them goes. Rows with one doc_id and text keep
    the same lines; null doc_ids come last."""
    tune(spark)
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays, that of the lowest doc_id (nulls last); of repeated rows one."""
    tune(spark)
    return near_dup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, every row of them; null and empty items are in none."""
    tune(spark)
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences; a null source is a source of its own, apart from an empty one."""
    tune(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_good_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: A trained field decides in the first stage, so no SQL gives the same rows; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
