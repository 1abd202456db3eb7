"""The chunker: overlapping, section-aware ranges of lines, as one fold over line numbers.

A chunk is cut before each `## ` header, and before a line that would take it past MAX_BYTES; then the next chunk
begins at the latest line from which the cut chunk still has OVERLAP_BYTES (each line counts one more byte), or
where the cut one began if it has fewer. Sizes are UTF-8 bytes; a line is never split; blank chunks are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollmine.functions.paths import file_date, memory_type
from scrollmine.functions.text import is_blank, lines, strip

MAX_BYTES, OVERLAP_BYTES, HEADER = 1600, 240, "## "


def _ranges(n: Column, prefix: str, header: str, limit: int, overlap: int) -> Column:
    """array<struct<s,e>> of line ranges, e exclusive: a state machine whose state is the start of the open chunk.

    `prefix` names the array of bytes before each line (and after the last); the overlap's start is the last
    line s of [start, i) with prefix[i] - prefix[s] >= overlap, found from the sizes alone.
    """
    at = lambda i: F.get(prefix, i)
    zero = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def back(start: Column, i: Column) -> Column:
        # how many lines from start still leave the overlap: prefix grows, so they are the first ones
        count = F.size(F.filter(F.slice(prefix, start + 1, i - start), lambda p: at(i) - p >= overlap))
        return F.when(count > 0, start + count - 1).otherwise(start)

    def step(acc: Column, i: Column) -> Column:
        start, out = acc["start"], acc["out"]
        cut = F.array_append(out, F.struct(start.alias("s"), i.alias("e")))
        on_header = F.get(header, i)
        too_long = at(i + 1) - at(start) - 1 > limit
        return (
            F.when(on_header, F.struct(i.alias("start"), F.when(i > start, cut).otherwise(out).alias("out")))
            .when(too_long & (i > start), F.struct(back(start, i).alias("start"), cut.alias("out")))
            .otherwise(F.struct(start.alias("start"), out.alias("out")))
        )

    last = lambda acc: F.array_append(acc["out"], F.struct(acc["start"].alias("s"), n.alias("e")))
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, last)


def chunk_documents(docs: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """docs (file_path, content, ...) as one row per chunk: docs' other columns, chunk_index, start_line, end_line, date, section, project, content, memory_type.

    Narrow: no shuffle; each text is cut in its own row.
    """
    others = [c for c in docs.columns if c not in ("content", "file_path")]
    df = docs.filter(F.col("content").isNotNull()).withColumn("__lines", lines("content")).drop("content")
    df = df.withColumn("__sizes", F.transform("__lines", lambda x: F.octet_length(x) + 1)).withColumn("__header", F.transform("__lines", lambda x: x.startswith(HEADER)))
    # an array grows by one element a line; every line's bytes are counted once
    df = df.withColumn("__prefix", F.aggregate("__sizes", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)))
    df = df.withColumn("__ranges", _ranges(F.size("__lines"), "__prefix", "__header", max_bytes, overlap))
    text = lambda r: F.array_join(F.slice("__lines", r["s"] + 1, r["e"] - r["s"]), "\n")
    df = df.withColumn("__texts", F.filter(F.transform("__ranges", lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), text(r).alias("content"))), lambda r: ~is_blank(r["content"])))
    # the outer generator keeps the optimizer from computing the arrays once more in a filter below it
    cut = df.select(*others, "file_path", "__lines", "__header", F.posexplode_outer("__texts").alias("chunk_index", "__c")).filter("__c is not null")
    # ranges never cross a header: a chunk's section is that of the last header at or before its first line
    own_header = F.array_max(F.transform(F.filter(F.transform("__header", lambda h, i: F.when(h, i)), lambda i: i.isNotNull() & (i <= F.col("__c.s"))), lambda i: i))
    section = F.when(own_header.isNotNull(), strip(F.substr(F.get("__lines", own_header), F.lit(len(HEADER) + 1))))
    return cut.select(
        *others, "file_path", "chunk_index", (F.col("__c.s") + 1).alias("start_line"), F.col("__c.e").alias("end_line"), file_date("file_path").alias("date"),
        section.alias("section"), F.lit(None).cast("string").alias("project"), F.col("__c.content").alias("content"), memory_type("file_path").alias("memory_type"),
    )
