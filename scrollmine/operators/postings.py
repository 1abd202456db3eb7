"""The inverted index as tables: postings (term, chunk_id, positions) and lengths (chunk_id, length)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmine.functions.text import tokens

#: Postings in one Arrow batch, and texts whose words are sorted together: some 400,000 words of chunks, as workers share an executor's memory.
_ROWS, _TEXTS = 20_000, 2_000


def build_postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(term, chunk_id, positions) of a table of texts.

    A text's tokens leave its own row, so the partial aggregation gathers each (term, text) before the shuffle.
    """
    found = chunks.select(F.col(id_col).alias("chunk_id"), F.posexplode(tokens(text_col)).alias("position", "term"))
    return found.groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """build_postings() with the chunks' `bucket`, for chunks whose chunk_id is unique; narrow.

    The words of _TEXTS texts are numbered and sorted together, so rows leave in runs in the order of bucket and term,
    and the sort before a write merges a few of them.
    """

    def gather(it):
        for whole in it:
            for start in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(start, _TEXTS)
                words, n = batch.column(2), batch.num_rows
                terms = words.flatten().dictionary_encode()
                if not len(terms):
                    continue
                sizes = np.diff(words.offsets.to_numpy())
                row = np.repeat(np.arange(n), sizes)
                position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                order = pc.sort_indices(terms.dictionary).to_numpy()  # by bytes, as Spark sorts
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                key = (batch.column(1).to_numpy()[row] * len(order) + rank[terms.indices.to_numpy()]) * n + row
                by = np.argsort(key, kind="stable")  # a word's positions stay in order
                key = key[by]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                positions = pa.array(position[by], pa.int32())
                for at in range(0, len(first), _ROWS):
                    own = first[at : at + _ROWS]
                    end = first[at + _ROWS] if at + _ROWS < len(first) else len(key)
                    listed = pa.ListArray.from_arrays(pa.array(np.append(own, end) - own[0], pa.int32()), positions.slice(own[0], end - own[0]))
                    chosen = by[own]
                    yield pa.RecordBatch.from_arrays([terms.take(pa.array(chosen)).dictionary_decode(), batch.column(0).take(pa.array(row[chosen])), listed, batch.column(1).take(pa.array(row[chosen]))], names=["term", "chunk_id", "positions", "bucket"])

    return chunks.select("chunk_id", "bucket", tokens("content").alias("words")).mapInArrow(gather, "term string, chunk_id long, positions array<int>, bucket int")


def doc_lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(chunk_id, length) in tokens; narrow."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.size(tokens(text_col)), F.lit(0)).cast("long").alias("length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avg_length, n_tokens."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df, cf): in how many texts, and how often, each term stands."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).cast("long").alias("cf"))
