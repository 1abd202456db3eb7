"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollmine.functions.vectors import l2_distance

#: Queries up to this many are broadcast to the vectors; more are answered in batches of this size.
QUERIES = 2_000


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(chunk_id, distance, rank) of the k vectors nearest to one query, ties by id: a projection and a bounded top k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = vectors.filter(F.size(vector_col) == len(query)).select(F.col(id_col).alias("chunk_id"), l2_distance(vector_col, q).alias("distance"))
    best = near.orderBy("distance", "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "chunk_id")))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, distance, rank) for queries (query_id, embedding), exactly.

    Queries go to the vectors in blocks of QUERIES, counted first; each Arrow batch of vectors makes one matrix
    product a block and keeps its best k of each query, so only k rows a query and batch travel.
    """
    asked = [(r["query_id"], r["embedding"]) for r in queries.select("query_id", "embedding").filter("embedding is not null").orderBy("query_id").toLocalIterator()]
    spark = vectors.sparkSession
    id_type, schema = vectors.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    parts = []
    for a in range(0, len(asked), QUERIES):
        block = asked[a : a + QUERIES]
        held = spark.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block], np.float64)))

        def nearest(it, held=held):
            names, q = held.value
            for pdf in it:
                pdf = pdf[pdf["v"].map(lambda v: v is not None and len(v) == q.shape[1])]
                if not len(pdf):
                    continue
                ids, x = pdf["chunk_id"].to_numpy(), np.stack(pdf["v"].to_list()).astype(np.float64)
                rough = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
                for i, name in enumerate(names):
                    # the product's rounding may swap near ties: all within it are measured exactly
                    kth = np.partition(rough[i], min(k, len(x)) - 1)[min(k, len(x)) - 1]
                    near = np.flatnonzero(rough[i] <= kth + 1e-9 * max(1.0, abs(kth)))
                    exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    order = np.lexsort((ids[near], exact))[:k]
                    yield pd.DataFrame({"query_id": [name] * len(order), "chunk_id": ids[near][order], "distance": exact[order]})

        rows = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v"))
        parts.append(rows.mapInPandas(nearest, f"query_id {schema}, chunk_id {id_type}, distance double"))
    if not parts:
        return spark.createDataFrame([], f"query_id {schema}, chunk_id {id_type}, distance double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
