"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, OVERFETCH = 60, 3


def rrf(lists: list[DataFrame], limit: int, k: int = RRF_K, places: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) from lists (query_id, chunk_id, rank): scores 1 / (k + rank) added up, ties by chunk_id.

    With `places`, scores equal to so many places are ties: sums of other ranks may be equal but for their last bit.
    """
    union = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "chunk_id", "rank"))
    scored = union.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if places is None else F.round("score", places).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
