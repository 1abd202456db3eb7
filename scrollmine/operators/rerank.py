"""Reranking of candidates by scores that a model gives, as columns for batches and on the driver for one query."""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

PROMPT_CHARS, CANDIDATES, TOP_K, LOW, HIGH = 500, 20, 5, 0.0, 10.0


def prompt_head(query: str, count: int) -> str:
    """The request that stands before the documents."""
    return f"Score how relevant each document is to the query, from 0 to 10. Answer with exactly {count} scores, separated by commas, and nothing else.\n\nQuery: {query}\n\n"


def batch_prompt(query: str, contents: list[str]) -> str:
    """One prompt for all candidates, numbered from 1, of each its first PROMPT_CHARS characters."""
    return prompt_head(query, len(contents)) + "\n\n".join(f"Document {i}: {c[:PROMPT_CHARS]}" for i, c in enumerate(contents, 1))


def single_prompt(query: str, content: str) -> str:
    """A prompt for one candidate."""
    return f"Score how relevant the document is to the query, from 0 to 10. Answer with the number alone.\n\nQuery: {query}\n\nDocument: {content[:PROMPT_CHARS]}"


def batch_prompts(candidates: DataFrame) -> DataFrame:
    """(query_id, prompt, n) of candidates (query_id, query, rank, content): batch_prompt() as an aggregation, at most CANDIDATES rows a query."""
    entry = F.struct("rank", F.substring("content", 1, PROMPT_CHARS).alias("text"))
    grouped = candidates.filter(F.col("rank") <= CANDIDATES).groupBy("query_id", "query").agg(F.sort_array(F.collect_list(entry)).alias("docs"))
    listed = F.array_join(F.transform("docs", lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), d["text"])), "\n\n")
    before, after = prompt_head("\x00", 0).split("\x00")
    head = F.concat(F.regexp_replace(F.lit(before), "exactly 0 scores", F.concat(F.lit("exactly "), F.size("docs").cast("string"), F.lit(" scores"))), F.col("query"), F.lit(after))
    return grouped.select("query_id", F.concat(head, listed).alias("prompt"), F.size("docs").alias("n"))


def parse_scores(response: str, expected: int) -> list[float]:
    """The scores in an answer, held to [0, 10]; ValueError if it is empty, has another number of them, or one isn't a number."""
    text = response.strip()
    if not text:
        raise ValueError("the answer is empty")
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != expected:
        raise ValueError(f"Expected {expected} scores separated by commas, found {len(parts)}: {text!r}")
    out = []
    for p in parts:
        try:
            if "_" in p:
                raise ValueError
            value = float(p)
        except ValueError:
            raise ValueError(f"not a score: {p!r} in {text!r}") from None
        out.append(value if math.isnan(value) else min(max(value, LOW), HIGH))
    return out


def parse_scores_column(response: Column | str, expected: Column | str) -> Column:
    """struct<scores, error> of answers: parse_scores() as an expression; one of the two is null."""
    text = F.regexp_replace(F.col(response) if isinstance(response, str) else response, "(?U)^\\s+|\\s+$", "")
    expected = F.col(expected) if isinstance(expected, str) else expected
    parts = F.transform(F.split(text, ",", -1), lambda p: F.regexp_replace(p, "(?U)^\\s+|\\s+$", ""))
    values = F.transform(parts, lambda p: F.least(F.greatest(p.try_cast("double"), F.lit(LOW)), F.lit(HIGH)))
    bad = F.element_at(F.filter(parts, lambda p: p.try_cast("double").isNull()), 1)
    error = (
        F.when(text.isNull() | (text == ""), F.lit("the answer is empty"))
        .when(F.size(parts) != expected, F.concat(F.lit("Expected "), expected.cast("string"), F.lit(" scores separated by commas, found "), F.size(parts).cast("string")))
        .when(F.exists(parts, lambda p: p.try_cast("double").isNull()), F.concat(F.lit("not a score: "), bad))
    )
    return F.struct(F.when(error.isNull(), values).alias("scores"), error.alias("error"))


def apply_scores(candidates: DataFrame, scores: DataFrame, top_k: int, taken: int = CANDIDATES) -> DataFrame:
    """Candidates (query_id, rank, score, ...) in the order of scores (query_id, scores array, in the order of rank).

    The first `taken` candidates of each query are reordered, ties in their old order, and the best top_k stay with
    the new score. Queries without scores, with another number of them, or with none at or above zero keep the old
    order and scores.
    """
    mine = candidates.filter(F.col("rank") <= taken)
    sized = mine.withColumn("__n", F.count("*").over(Window.partitionBy("query_id")))
    joined = sized.join(scores.select("query_id", "scores"), "query_id", "left")
    usable = (F.size("scores") == F.col("__n")) & F.exists("scores", lambda s: (s >= 0) & ~F.isnan(s))
    new = F.when(F.coalesce(usable, F.lit(False)), F.get("scores", F.col("rank") - 1))
    ordered = joined.withColumn("__new", new).withColumn("__place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("__new"), "rank")))
    kept = ordered.filter(F.col("__place") <= top_k)
    columns = [F.col("__place").alias(c) if c == "rank" else F.coalesce("__new", "score").alias(c) if c == "score" else F.col(c) for c in candidates.columns]
    return kept.select(*columns)


def rerank(query: str, candidates: list[dict], provider, top_k: int = TOP_K, taken: int = CANDIDATES) -> list[dict]:
    """The candidates of one query (best first) reordered by a provider's scores; any failure keeps the old order, and says why in the log."""
    if not candidates:
        return candidates
    mine = candidates[:taken]
    fallback = mine[: min(top_k, len(candidates))]
    if provider is None:
        log.warning("unknown rerank provider: order unchanged")
        return fallback
    try:
        scores = provider.scores(query, [c["content"] for c in mine])
    except Exception as e:  # noqa: BLE001  a provider may fail in any way
        log.warning("rerank failed, order unchanged: %s", e)
        return fallback
    if len(scores) != len(mine):
        log.warning("%d scores for %d candidates: order unchanged", len(scores), len(mine))
        return fallback
    if not any(s >= 0 for s in scores):
        log.warning("no valid score: order unchanged")
        return fallback
    order = sorted(range(len(mine)), key=lambda i: -scores[i] if scores[i] == scores[i] else math.inf)
    return [{**mine[i], "score": scores[i]} for i in order[: len(fallback)]]
