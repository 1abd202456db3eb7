"""Mixture-controlled packing by deficit round-robin over source queues.

Every source has a queue of its documents (in the order of a hash of doc_id). A round gives each source a quantum
of `window * share` tokens, and documents are cut where a quantum ends: a source serves its quantum in every round,
and only the part of a token that is left is carried on, through every partition of the data. The token after `c`
tokens of a queue is therefore served in round `c // quantum`, which makes the schedule a function of prefix sums, so
no task has to walk the rounds. Rounds follow each other, sources take turns within a round, and the stream that
results is cut every SEQUENCE tokens. A round has a window's tokens but for less than one a source, so every window
holds the target proportions but for a few tokens a source, and only the last sequence is shorter.

With given shares, sources that run dry leave the remaining ones to share the rounds in their proportions.

Defined cases: a null or empty text has one token, END_ID; a null source is a source of its own; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import base_columns, batches, codec, materialize, scratch_path, texts_of

END_ID = 2
SEQUENCE = 4096
#: Documents for each group of a prefix sum, and the most groups: the sums of the groups are one small table.
GROUP_ROWS, MAX_GROUPS = 20_000, 8192
#: Plans of the queues are broadcast up to this many sources, and joined by shuffle beyond.
MAX_QUEUES = 1024


def _encode(it):
    encode, end = codec().encode, struct.pack("<I", END_ID)
    for whole in batches(it):
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            packed = [np.frombuffer(encode(t) + end, "<u4").astype("<u2").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [column("doc_id"), column("queue"), column("row"), pa.array([len(x) // 2 for x in packed], pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "queue", "row", "n", "ids"],
            )


def tokenize(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, queue, row, n, ids), written once: ids as little-endian 16-bit integers (the vocabulary has 49,408)."""
    rows = base_columns(docs, "doc_id", "text", source).select(
        "doc_id", "text", F.coalesce(F.concat(F.lit("s:"), F.col(f"`{source}`").cast("string")), F.lit("")).alias("queue"), F.monotonically_increasing_id().alias("row")
    )
    return materialize(rows.mapInArrow(_encode, "doc_id long, queue string, row long, n long, ids binary"), "packing-ids")


def phases(totals: dict[str, int], shares: dict[str, float] | None) -> list[tuple[Fraction, dict[str, tuple[Fraction, Fraction]]]]:
    """Stretches of the schedule between exhausted sources: (tokens in all queues served before, {queue: (tokens of it served before, its share)}).

    Without shares, every source has its share of all tokens, and all end together.
    """
    left = {q: Fraction(n) for q, n in totals.items() if n}
    wanted = {q: Fraction(shares.get(q, 0)).limit_denominator(10**6) if shares else n for q, n in left.items()}
    served, before, out = dict.fromkeys(left, Fraction(0)), Fraction(0), []
    while left:
        live = {q: wanted[q] for q in left if wanted[q] > 0} or {q: left[q] for q in left}
        total = sum(live.values())
        out.append((before, {q: (served[q], w / total) for q, w in live.items()}))
        lasts = min(left[q] * total / w for q, w in live.items())
        for q, w in live.items():
            took = lasts * w / total
            served[q] += took
            left[q] -= took
            if not left[q]:
                del left[q]
        before += lasts
    return out


def _prefix(rows: DataFrame, group: str, order: list[str], value: str, name: str, within: list[str] | None = None) -> DataFrame:
    """rows with `name`: the sum of value over all rows before, in the order of (group, *order).

    Sums by group come first (a partial sum in each task, one row a group), are summed up in one small table, and
    each group adds its own running sum; with `within`, the sums start anew for each value of those columns.
    """
    within = within or []
    sums = rows.groupBy(*within, group).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*within) if within else Window
    base = sums.select(*within, group, F.coalesce(F.sum("__sum").over(over.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*within, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(base, [*within, group]).withColumn(name, F.col("__base") + F.col("__own")).drop("__base", "__own")


def _served(v: Column) -> Column:
    """The whole tokens of a queue before virtual time v, from its steps; never falls from step to step."""
    step = F.try_element_at(F.filter("steps", lambda s: s["before"] <= v), F.lit(-1))
    tokens = F.ceil(F.least(step["served"] + (v - step["before"]) * step["share"], step["until"]))
    return F.coalesce(F.greatest(tokens, F.ceil(step["served"])), F.lit(0)).cast("long")


def _round(c: Column, window: int) -> Column:
    """The round of the token after c tokens of a queue: virtual time counts the tokens of all queues before it."""
    step = F.try_element_at(F.filter("steps", lambda s: s["served"] <= c), F.lit(-1))
    return F.floor((step["before"] + (c - step["served"]) / step["share"]) / F.lit(window)).cast("long")


def _cut(timed: DataFrame, window: int) -> DataFrame:
    """timed (row, queue, n, c, steps) with a row for each part of a document in a round: start, length, round."""
    end = F.col("c") + F.col("n")
    df = timed.withColumn("r0", _round(F.col("c"), window)).withColumn("r1", _round(end - 1, window))
    # one round more on either side, as quotients are rounded; parts without tokens go
    low, high = F.greatest(F.col("r0") - 1, F.lit(0)), F.col("r1") + 1
    by_round = F.transform(
        F.sequence(low, high),
        lambda r: F.struct(
            r.alias("round"),
            F.when(r == low, F.col("c")).otherwise(F.greatest(F.col("c"), F.least(end, _served(r * F.lit(window))))).alias("from"),
            F.when(r == high, end).otherwise(F.greatest(F.col("c"), F.least(end, _served((r + 1) * F.lit(window))))).alias("to"),
        ),
    )
    # a queue with less than a token a round has fewer tokens than rounds
    by_token = F.transform(F.sequence(F.col("c"), end - 1), lambda t: F.struct(_round(t, window).alias("round"), t.alias("from"), (t + 1).alias("to")))
    parts = F.filter(F.when(F.col("r1") - F.col("r0") > F.col("n"), by_token).otherwise(by_round), lambda x: x["to"] > x["from"])
    # the outer form, whose rows aren't filtered below it by computing the parts once more
    cut = df.withColumn("parts", parts).select("row", "queue", "c", F.explode_outer("parts").alias("p"))
    return cut.select("row", "queue", F.col("p.from").alias("at"), (F.col("p.from") - F.col("c")).alias("start"), (F.col("p.to") - F.col("p.from")).alias("length"), "p.round")


def schedule(sizes: DataFrame, shares: dict[str, float] | None = None, window: int = SEQUENCE) -> DataFrame:
    """(row, start, length, round, position) of each part of the documents of sizes (doc_id, queue, row, n): its round and its place in the stream."""
    sums = sizes.groupBy("queue").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    named = {f"s:{k}": v for k, v in shares.items()} if shares else {}
    # the plan needs the sums of the named queues and of all others together
    of = F.when(F.col("queue").isin(list(named)), F.col("queue"))
    stats = sums.groupBy(of.alias("queue")).agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"), F.count("*").alias("queues")).collect()
    totals = {r["queue"]: r["total"] for r in stats}
    groups = max(1, min(MAX_GROUPS, sum(r["rows"] for r in stats) // GROUP_ROWS))
    plan = phases(totals, named or None)
    spark = sizes.sparkSession
    steps = [(q, float(served), float(share), float(before), float(served + share * (plan[i + 1][0] - before)) if i + 1 < len(plan) else float(totals[q])) for i, (before, live) in enumerate(plan) for q, (served, share) in live.items()]
    step_rows = spark.createDataFrame(steps, "of string, served double, share double, before double, until double")
    # a queue's phases as one array: the last phase that begins at or before c holds
    array = F.sort_array(F.collect_list(F.struct("before", "served", "share", "until"))).alias("steps")
    plans = step_rows.groupBy("of").agg(array)
    # queues that no share names are served together, each in proportion to its tokens
    part = F.when(of.isNull(), F.col("total") / F.lit(float(totals.get(None, 1)))).otherwise(F.lit(1.0))
    own = F.transform("steps", lambda x: F.struct(x["before"].alias("before"), (x["served"] * part).alias("served"), (x["share"] * part).alias("share"), (x["until"] * part).alias("until")))
    steps_by_queue = sums.join(F.broadcast(plans), of.eqNullSafe(F.col("of"))).select("queue", own.alias("steps"))
    placed = sizes.withColumn("hash", F.xxhash64("doc_id")).withColumn("bucket", F.pmod(F.shiftright("hash", 40), F.lit(groups)))
    queued = _prefix(placed, "bucket", ["hash", "doc_id", "row"], "n", "c", within=["queue"])
    if sum(r["queues"] for r in stats) <= MAX_QUEUES:
        timed = queued.join(F.broadcast(steps_by_queue), "queue")
    else:  # by queue and bucket, as the prefix sums are dealt, so that a large queue isn't one task
        timed = queued.join(placed.select("queue", "bucket").distinct().join(steps_by_queue, "queue"), ["queue", "bucket"])
    cut = _cut(timed, window)
    width = max(1, -(-(sum(totals.values()) // window + 1) // groups))
    rounds = cut.withColumn("stretch", F.floor(F.col("round") / F.lit(width)).cast("long"))
    return _prefix(rounds, "stretch", ["round", "queue", "at"], "length", "position").select("row", "start", "length", "round", "position")


def _pieces(it):
    for batch in batches(it):
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "ids"}
        out: list[tuple] = []
        for k, ids in enumerate(batch.column(batch.schema.get_field_index("ids"))):
            own = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
            for part in columns["parts"][k]:
                start, end, at = part["start"], part["start"] + part["length"], part["position"]
                while start < end:
                    sequence, offset = divmod(at, SEQUENCE)
                    length = min(end - start, SEQUENCE - offset)
                    out.append((columns["doc_id"][k], start, length, zlib.crc32(own[start : start + length]), len(own), sequence, offset, columns["queue"][k][2:] if columns["queue"][k] else None, part["round"]))
                    start, at = start + length, at + length
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 7 + [pa.string(), pa.int64()], strict=True)], names=PIECE_NAMES)


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "round"]
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, round long"


def pack(docs: DataFrame, shares: dict[str, float] | None = None, source: str = "source") -> DataFrame:
    """One row for each piece of a document in a sequence of at most SEQUENCE tokens.

    The ids are written once and only they travel again, to their places; the schedule moves a few numbers for each
    part of a document.
    """
    ids = tokenize(docs, source)
    places = materialize(schedule(ids.select("doc_id", "queue", "row", "n"), shares), "packing-places")
    parts = places.groupBy("row").agg(F.collect_list(F.struct("start", "length", "round", "position")).alias("parts"))  # so that ids aren't repeated
    return ids.drop("n").join(parts, "row").mapInArrow(_pieces, PIECE_SCHEMA)


def write_sequences(docs: DataFrame, path: str | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    """The pieces written as Parquet ordered by sequence and offset; returns them as read back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "sequences")
    pack(docs, shares).repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "offset").write.parquet(path)
    return spark.read.schema(PIECE_SCHEMA).parquet(path)
