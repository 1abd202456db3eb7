"""Benchmark decontamination: size-partitioned MinHash containment search, of DataFrame functions only.

Items are short, documents may be long, so the similarity of their sets is tiny although an item lies in a document
whole. The search therefore partitions documents by size: one with n shingles has its hashes dealt into 2**b bins by
their leading bits, b from the size class of n, and keeps the smallest hash of each bin (one-permutation MinHash).
Bins are so many for a class that a shared shingle is its bin's minimum with the probability that the smallest item
needs (MISS below); a longer document has a longer sketch, and the search misses as little in every partition.
The sketches are joined with the items' shingle hashes; the matches of a pair estimate its containment, and pairs
with enough of them are verified on their exact shingles (words, not hashes): a document is contaminated by an item
if it has at least 75 percent of the item's distinct shingles.

Shingles are five words in lower case; the words of a shorter text are one shingle.

Defined cases: documents and items without words (or null) match nothing; rows of documents with the same doc_id and
text, and items with the same item_id and text, are one; a null id is carried as null; empty tables give no rows;
other columns pass through `drop_contaminated`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base_columns, fresh, materialize

WIDTH, PERCENT = 5, 75
#: Chance, at most, that the sketch keeps none of the shingles that an item at the threshold shares.
MISS = 1e-6
#: Tables of items or candidates up to this many rows are broadcast, larger ones joined by shuffle.
BROADCAST_ROWS = 300_000


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def _each(w: str, make, short) -> Column:
    """make(five words) of every window of the array column w; short(w) alone if it has fewer."""
    n = F.size(w)
    five = lambda i: [F.get(w, i + k) for k in range(WIDTH)]
    return F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: make(*five(i)))).when(n > 0, F.array(short(F.col(w))))


def hashes(w: str) -> Column:
    return _each(w, F.xxhash64, lambda a: F.xxhash64(F.array_join(a, " ")))


def shingles(w: str) -> Column:
    return F.array_distinct(_each(w, lambda *five: F.concat_ws(" ", *five), lambda a: F.array_join(a, " ")))


def extra_bits(smallest: int) -> int:
    """How many more bins than shingles, as a power of two, for the smallest item's number of shingles.

    With a load of x shingles a bin, a given shingle isn't its bin's minimum with probability x / 2 at most.
    """
    shared = max(1, math.ceil(smallest * PERCENT / 100))
    return max(1, math.ceil(-math.log2(2 * MISS ** (1 / shared))))


def sketches(docs: DataFrame, extra: int) -> DataFrame:
    """(doc_id, text_hash, h): the minima of the bins of each document."""
    keyed = base_columns(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    df = keyed.withColumn("w", words("text")).drop("text").withColumn("h", F.sort_array(hashes("w"))).drop("w")
    shift = F.greatest(F.lit(0), 64 - F.ceil(F.log2(F.size("h"))).cast("int") - extra)
    df = df.withColumn("shift", shift)
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, F.col("shift"))
    minima = F.filter("h", lambda x, i: (i == 0) | ((x != F.get("h", i - 1)) & ((F.col("shift") == 0) | (bin_of(x) != bin_of(F.get("h", i - 1))))))
    # the outer form, whose rows aren't filtered below it by computing the whole array once more
    return df.withColumn("minima", minima).select("doc_id", "text_hash", F.explode_outer("minima").alias("h")).filter("h is not null")


def item_shingles(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(item, shingles, n): the items that have words."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), "text").distinct().withColumn("w", words("text"))
    return rows.withColumn("shingles", shingles("w")).filter("shingles is not null").select(F.xxhash64("item", "text").alias("item_key"), "item", "w", "shingles", F.size("shingles").alias("n"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(doc_id, text_hash, item_id, item_shingles, shared): the pairs of a document and an item that it contains."""
    own = materialize(item_shingles(items, item_id), "decontam-items")
    smallest = own.agg(F.min("n")).first()[0] or 1
    wanted = _small(materialize(own.select("item_key", "n", F.explode(F.array_distinct(hashes("w"))).alias("h")), "decontam-hashes"))
    hits = sketches(docs, extra_bits(smallest)).join(wanted, "h").groupBy("doc_id", "text_hash", "item_key", "n").agg(F.count("*").alias("matches"))
    # a quarter of the item less two: far below what three quarters leave in the sketch
    likely = materialize(hits.filter(F.col("matches") >= F.greatest(F.lit(1), F.floor(F.col("n") / 4) - 2)).select("doc_id", "text_hash", "item_key"), "decontam-candidates")
    texts = base_columns(docs, "doc_id", "text").withColumn("own_hash", F.xxhash64("text"))
    pairs = _small(likely.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("item_key").alias("keys")))
    found = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))).dropDuplicates(["id", "hash"])
    cut = found.withColumn("w", words("text")).select("doc_id", F.col("hash").alias("text_hash"), shingles("w").alias("own"), F.explode("keys").alias("item_key"))
    exact = cut.join(_small(own.drop("w")), "item_key").withColumn("shared", F.size(F.array_intersect("own", "shingles")))
    return exact.filter(100 * F.col("shared") >= PERCENT * F.col("n")).select("doc_id", "text_hash", F.col("item").alias("item_id"), F.col("n").cast("long").alias("item_shingles"), F.col("shared").cast("long").alias("shared"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each pair: doc_id, item_id, item_shingles, shared."""
    return contaminated(docs, items).drop("text_hash")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    own, hashed = fresh(docs, "found_id", "found_hash")
    gone = _small(materialize(contaminated(docs, items).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct(), "decontam-gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(hashed)), "left_anti")


#: The same pairs in DuckDB SQL, by joining all shingles.
ORACLE_SQL = f"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') FROM benchmark),
cut AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM texts),
sizes AS (SELECT id, count(*) AS n FROM cut WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(z.n) AS BIGINT) AS item_shingles, CAST(count(*) AS BIGINT) AS shared
FROM cut i JOIN cut d ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= {PERCENT} * any_value(z.n)
"""
