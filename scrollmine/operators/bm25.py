"""BM25 search over postings.

One query reads its terms' postings once (the filter on term reaches the scan), gathers them by chunk in one shuffle,
and evaluates phrases, NEAR, the boolean tree and the score as expressions over that row. A batch of plain queries
joins the terms of all queries with the postings instead.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollmine.functions.text import tokens

from . import match
from .postings import corpus_stats

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def best_first() -> list[Column]:
    """Best first, ties by chunk_id. Sums differ in their last bits with the order of rows: equal to nine places is a tie."""
    return [F.round("score", 9).desc(), F.col("chunk_id")]


def idf(n_docs: Column, df: Column) -> Column:
    value = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(LEAST_IDF)


def weight(tf: Column, length: Column, average: Column, inverse: Column) -> Column:
    return inverse * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def match_scores(query: str, postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chunk_id, score) of all chunks that match a query of the match language; higher is better."""
    tree = match.parse(query)
    if tree is None:
        return postings.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    whole, prefixes = match.terms_of(tree)
    wanted = reduce(lambda a, b: a | b, [*([F.col("term").isin(sorted(whole))] if whole else []), *(F.col("term").startswith(p) for p in sorted(prefixes))])
    none = F.array().cast("array<int>")
    names: dict[tuple[str, str], str] = {}
    gathered = []
    for k, (kind, t) in enumerate([*(("term", t) for t in sorted(whole)), *(("prefix", p) for p in sorted(prefixes))]):
        names[kind, t] = f"p{k}"
        test = F.col("term") == t if kind == "term" else F.col("term").startswith(t)
        gathered.append(F.sort_array(F.flatten(F.collect_list(F.when(test, F.col("positions"))))).alias(f"p{k}"))
    rows = postings.filter(wanted).groupBy("chunk_id").agg(*gathered)
    pick = lambda kind: {t: F.coalesce(F.col(n), none) for (k, t), n in names.items() if k == kind}
    by_term, by_prefix = pick("term"), pick("prefix")

    found = list(match.phrases_of(tree))
    counts: dict[int, Column] = {}
    free = []  # columns of unrestricted phrase counts, for document frequencies
    for k, (p, _, _) in enumerate(found):
        rows = rows.withColumn(f"s{k}", match.starts(p, by_term, by_prefix))
        free.append(F.size(f"s{k}"))
    for near in {id(n): n for _, n, _ in found if n is not None}.values():
        own = [k for k, (_, n, _) in enumerate(found) if n is near]
        limited = match.near_counts([F.col(f"s{k}") for k in own], [len(found[k][0].terms) for k in own], near.distance)
        for k, c in zip(own, limited, strict=True):
            rows = rows.withColumn(f"n{k}", c)
    for k, (p, n, _) in enumerate(found):
        counts[id(p)] = F.col(f"n{k}") if n is not None else F.size(f"s{k}")

    stats = corpus_stats(lengths).crossJoin(rows.agg(*(F.sum((c > 0).cast("long")).alias(f"df{k}") for k, c in enumerate(free))))
    scored = rows.filter(match.condition(tree, counts)).join(lengths, "chunk_id").crossJoin(F.broadcast(stats))  # stats: one row
    parts = [weight(counts[id(p)], F.col("length"), F.col("avg_length"), idf(F.col("n_docs"), F.col(f"df{k}"))) for k, (p, _, wanted_side) in enumerate(found) if wanted_side]
    return scored.select("chunk_id", reduce(add, parts).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best k rows, ties by chunk_id, with their rank from 1."""
    best = scored.orderBy(*best_first()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*best_first())))


def top_and(scored: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(chunk_id, rank) of the best k rows, and of those in `wanted` (chunk_id; few), however far down they stand.

    A wanted row's rank is the number of rows up to it in top()'s order, counted where they are: no task sorts them all.
    """
    place = lambda score, key: F.struct(-F.round(score, 9), F.col(key).alias("id"))
    own = scored.join(F.broadcast(wanted.select("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("__id"), F.col("score").alias("__score"))
    upto = scored.crossJoin(F.broadcast(own)).filter(place("score", "chunk_id") <= place("__score", "__id"))
    below = upto.groupBy(F.col("__id").alias("chunk_id")).agg(F.count("*").cast("int").alias("rank"))
    return top(scored, k).select("chunk_id", "rank").unionByName(below).groupBy("chunk_id").agg(F.min("rank").alias("rank"))


def match_top(query: str, postings: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(chunk_id, score, rank) of the best k chunks."""
    return top(match_scores(query, postings, lengths), k)


def batch_scores(queries: DataFrame, postings: DataFrame, lengths: DataFrame, require_all: bool = True) -> DataFrame:
    """(query_id, chunk_id, score) for queries (query_id, text): all words must occur (require_all), or any; a repeated word counts again.

    Query terms are few against postings; Spark broadcasts them if they are small and shuffles by term if not. A
    row's weight needs its term's df alone, which comes from the postings that the queries touch.
    """
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    touched = postings.join(asked.select("term").distinct(), "term", "left_semi").select("term", "chunk_id", F.size("positions").alias("tf"))
    df = touched.groupBy("term").agg(F.count("*").alias("df"))
    sized = asked.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id"))).join(df, "term")
    stats = F.broadcast(corpus_stats(lengths))  # one row
    hits = touched.join(sized, "term").join(lengths, "chunk_id").crossJoin(stats)
    value = F.col("times") * weight(F.col("tf"), F.col("length"), F.col("avg_length"), idf(F.col("n_docs"), F.col("df")))
    scored = hits.withColumn("w", value).groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"), F.count("*").alias("found"), F.max("n_terms").alias("n_terms"))
    return (scored.filter("found = n_terms") if require_all else scored).select("query_id", "chunk_id", "score")


def batch_top(queries: DataFrame, postings: DataFrame, lengths: DataFrame, k: int, require_all: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best k of each query, ties by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(*best_first())
    return batch_scores(queries, postings, lengths, require_all).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
