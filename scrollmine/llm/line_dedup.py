"""Line deduplication by winnowing over line hashes, of DataFrame functions only.

A window begins at each line with words and takes the following such lines until it has WINDOW_LINES of them or
WINDOW_WORDS words, whichever comes first, so equal text makes equal windows. Of each window the smallest line hash
is selected; a passage that repeats and is as long as a window thus always shares a fingerprint with its copy.
Fingerprints that stand at one position only are dropped by a count, before anything else moves. Windows at the
positions that are left are compared by content (two 64-bit hashes over all their lines), each group keeping its
first place in the order of (doc_id, line); windows after the first are repeats. A repeat is extended
line by line while the lines next to it repeat together with it; overlapping and adjacent repeats of a document merge
into runs. So what goes are the lines of every run of lines that holds a window and stands, as a whole, somewhere
earlier, and blank lines between them.

Extension takes two lines forward and none backward. Of a run that holds a window beginning at line k, the window that
begins at k - 1 ends where that one does or before it, so it lies in the run and repeats, too; and each window that
begins three or more lines before the run's end lies in it. What no window reaches are at most the last two lines.

A line goes only if an equal line stands earlier, so the first of equal lines always stays.

Defined cases: lines are cut at U+000A and compared without outer white space; blank lines never count. A null text
stays null and an empty one empty. Rows with the same doc_id and text are one document, with one result on each row.
A null doc_id comes last in the order. An empty table gives no rows. Other columns pass through `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base_columns, fresh, materialize

WINDOW_LINES, WINDOW_WORDS = 3, 50
_TRIM = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"
_GAP = "[\\x20\\x09-\\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    return base_columns(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))


def windows(docs: DataFrame) -> DataFrame:
    """A row for each window, without text: (doc_id, text_hash, first, last, fingerprint, place, w1, w2), and the hashes
    a1, a2 and numbers e1, e2 of the two lines after it (0 and null where there are none)."""
    trimmed = lambda line: F.regexp_replace(line, _TRIM, "")
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), trimmed(line).alias("t")))
    df = _keyed(docs).withColumn("lines", F.filter(lines, lambda x: x["t"] != "")).drop("text")
    df = df.withColumn("l", F.transform("lines", lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"), F.size(F.split(x["t"], _GAP, -1)).alias("n")))).drop("lines")
    at = lambda k, field: F.get("l", k)[field]

    def window(x: Column, k: Column) -> Column:
        # the window's lines: this one, and the next ones while it is short of lines and words
        more = F.when(x["n"] >= WINDOW_WORDS, 0).when((x["n"] + F.coalesce(at(k + 1, "n"), F.lit(0)) >= WINDOW_WORDS) | F.lit(WINDOW_LINES == 2), 1).otherwise(2)
        two, three = more >= 1, more >= 2
        fits = k + more < F.size("l")
        h1, h2 = F.when(two, at(k + 1, "h")), F.when(three, at(k + 2, "h"))
        low = F.least(x["h"], h1, h2)  # null arguments are skipped
        return F.struct(
            fits.alias("fits"), x["i"].alias("first"), at(k + more, "i").alias("last"), low.alias("fingerprint"),
            F.when(three & (h2 == low), k + 2).when(two & (h1 == low), k + 1).otherwise(k).alias("place"),
            F.xxhash64(x["h"], h1, h2, more).alias("w1"), F.xxhash64(x["g"], F.when(two, at(k + 1, "g")), F.when(three, at(k + 2, "g"))).alias("w2"),
            *(f.alias(n) for d in (1, 2) for f, n in ((F.coalesce(at(k + more + d, "h"), F.lit(0)), f"a{d}"), (at(k + more + d, "i"), f"e{d}"))),
        )

    df = df.withColumn("w", F.filter(F.transform("l", window), lambda w: w["fits"])).drop("l")
    # the outer form, whose rows aren't filtered below it by computing the whole array once more
    return df.select("doc_id", "text_hash", F.inline_outer("w")).filter("fits").drop("fits").distinct()


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, runs): the merged runs of repeated windows, as arrays of (first, last) line numbers from 0."""
    found = materialize(windows(docs), "line-windows")
    # positions of the selected minima; a fingerprint at a single position has no copy
    shared = found.select("fingerprint", "doc_id", "text_hash", "place").distinct().groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    joined = found.join(shared, "fingerprint", "left_semi")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "first")
    content = ["fingerprint", "w1", "w2"]
    plain = joined.groupBy(*content).agg(F.min(order).alias("o0"), F.count("*").alias("n")).filter("n > 1").drop("n")
    matched = materialize(joined.join(plain, content), "line-matched")  # windows that repeat, their first places with them
    # the first places with one and two more lines
    both = matched.groupBy(*content, "a1", "a2").agg(F.min(order).alias("o2"))
    firsts = both.join(both.groupBy(*content, "a1").agg(F.min("o2").alias("o1")), [*content, "a1"])
    later = matched.join(firsts, [*content, "a1", "a2"]).filter(order != F.col("o0"))
    end = F.when(F.col("e2").isNotNull() & (order != F.col("o2")), F.col("e2")).when(F.col("e1").isNotNull() & (order != F.col("o1")), F.col("e1")).otherwise(F.col("last"))
    spans = later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", end.alias("last")))).alias("spans"))
    last = lambda runs: F.element_at(runs, -1)
    grown = lambda runs, s: F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last(runs)["first"].alias("first"), F.greatest(last(runs)["last"], s["last"]).alias("last"))))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda runs, s: F.when((F.size(runs) > 0) & (s["first"] <= F.coalesce(F.try_element_at(runs, F.lit(-1))["last"], F.lit(-2)) + 1), grown(runs, s)).otherwise(F.concat(runs, F.array(s))),
    )
    return spans.select("doc_id", "text_hash", merged.alias("runs"))


def _cleaned(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(docs with two more columns, the runs and the lines, which the other two name); texts travel once."""
    own_id, own_hash, hashed, runs, lines = fresh(docs, "run_id", "run_hash", "text_hash", "runs", "lines")
    found = repeated_runs(docs).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("runs").alias(runs))
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(hashed) == F.col(own_hash)), "left")
    return joined.withColumn(lines, F.split("text", "\n", -1)).drop(own_id, own_hash, hashed), F.col(runs), F.col(lines)


def _kept_text(runs: Column, lines: Column) -> Column:
    kept = F.filter(lines, lambda line, i: ~F.exists(runs, lambda r: i.between(r["first"], r["last"])))
    return F.when(runs.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def _removed(runs: Column) -> Column:
    return F.coalesce(F.aggregate(runs, F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0)).cast("long")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated runs deleted from their texts; documents of which nothing with words is left are dropped."""
    names = docs.columns
    df, runs, lines = _cleaned(docs)
    df = df.withColumn("text", _kept_text(runs, lines))
    return df.filter(runs.isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*(F.col(f"`{n}`") for n in names))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (first-last line numbers, comma-joined), clean_sha256."""
    df, runs, lines = _cleaned(base_columns(docs, "doc_id", "text"))
    ranges = F.array_join(F.transform(runs, lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return df.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"), _removed(runs).alias("n_removed"), F.coalesce(ranges, F.lit("")).alias("removed"), F.sha2(F.coalesce(_kept_text(runs, lines), F.lit("")), 256).alias("clean_sha256"))


#: The same rows in DuckDB SQL: windows, alone and with one and two more lines, by their trimmed lines; repeats by a
#: window function.
ORACLE_SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
cut AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs),
worded AS (
  SELECT doc_id, text, i, regexp_replace(line, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS t,
         len(regexp_extract_all(line, '[^ \\t\\n\\v\\f\\r]+')) AS n
  FROM cut WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]')),
nexts AS (
  SELECT *, lead(n, 1) OVER w AS n1, row_number() OVER w AS k
  FROM worded WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
sized AS (SELECT doc_id, text, i, k, CASE WHEN n >= {WINDOW_WORDS} THEN 0 WHEN n + coalesce(n1, 0) >= {WINDOW_WORDS} THEN 1 ELSE 2 END AS more FROM nexts),
spans AS (
  SELECT s.doc_id, s.text, s.i AS first, max(w.i) AS last, string_agg(w.t, chr(10) ORDER BY w.k) AS content
  FROM sized s CROSS JOIN (VALUES (0), (1), (2)) x (extra) JOIN nexts w ON w.doc_id IS NOT DISTINCT FROM s.doc_id AND w.text = s.text AND w.k BETWEEN s.k AND s.k + s.more + x.extra
  GROUP BY s.doc_id, s.text, s.i, s.more, x.extra HAVING count(*) = s.more + x.extra + 1),
later AS (
  SELECT doc_id, text, first, last FROM (
    SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, hash(text), first) AS k FROM spans WHERE last IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT c.doc_id, c.text, c.i FROM cut c JOIN later s ON c.doc_id = s.doc_id AND c.text = s.text AND c.i BETWEEN s.first AND s.last),
islands AS (SELECT doc_id, text, i, i - row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS g FROM gone),
runs AS (SELECT doc_id, text, g, min(i) AS a, max(i) AS b FROM islands GROUP BY doc_id, text, g),
listed AS (SELECT doc_id, text, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, CAST(sum(b - a + 1) AS BIGINT) AS n FROM runs GROUP BY doc_id, text),
clean AS (
  SELECT c.doc_id, c.text, string_agg(c.line, chr(10) ORDER BY c.i) AS kept
  FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.text = g.text AND c.i = g.i WHERE g.i IS NULL GROUP BY c.doc_id, c.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(string_split(d.text, chr(10))) AS BIGINT) END AS n_lines,
       coalesce(l.n, 0) AS n_removed, coalesce(l.removed, '') AS removed,
       sha256(CASE WHEN l.n IS NULL THEN coalesce(d.text, '') ELSE coalesce(c.kept, '') END) AS clean_sha256
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id AND d.text = l.text LEFT JOIN clean c ON d.doc_id = c.doc_id AND d.text = c.text
"""
