"""WARC fixity audit with Merkle trees: compare replicas' roots and descend only where they differ.

`write_warc` stores pages as WARC 1.1 files, one archive a file, of about ARCHIVE_BYTES each; `read_warc` parses such
files by Content-Length into records with offsets and hashes, and goes on at the next record's mark after damage.
`merkle_levels` hashes FANOUT records that follow each other into a node over their offset range, FANOUT such nodes
into the next, up to a root for each archive; every level is one grouped aggregation with groups of FANOUT rows. A
node's hash covers the extents of its children's ranges in their order, not their beginnings, so a record that grew
changes the nodes above it and none beside them. A lost record renumbers those after it in its archive.
`audit` joins two replicas' roots, then from level to level only the children of nodes that differ, and at last the
records below them, so an intact archive costs one comparison.

Defined cases: null html is an empty payload, a null url an empty URI (line breaks in it become spaces), a null
page_id the record id `none`; rows equal in all columns stand in the same archive and are told apart by their order;
an archive that one replica lacks is missing with all its records; empty tables give no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialize, scratch_path

ARCHIVE_BYTES, FANOUT = 8 << 20, 16
#: Archives that a task writes, on average: tasks follow the data, whatever the session's number of partitions.
TASK_ARCHIVES = 4
_MARK = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:([^>\r\n]*)>\r\n")


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page as a WARC record without the two line breaks that end it."""
    html = F.coalesce("html", F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    ]
    return pages.select("page_id", F.xxhash64("page_id", "url", "html").alias("hash"), F.concat(*head, html).alias("record"))


def archives_for(pages: DataFrame) -> int:
    """How many archives of about ARCHIVE_BYTES hold the pages."""
    total = pages.agg(F.sum(F.octet_length("html") + 256)).first()[0] or 0
    return max(1, -(-total // ARCHIVE_BYTES))


def write_warc(pages: DataFrame, path: str, archives: int, key: str = "hash") -> None:
    """Write pages to `path`, archives numbered by a hash and ordered by page_id, as gzip-compressed WARC files.

    `key` is the column of warc_records that deals records to archives: replicas of a table need the same.
    """
    rows = pages if "record" in pages.columns else warc_records(pages)
    dealt = rows.withColumn("archive", F.pmod(F.xxhash64(key), F.lit(archives)))
    ordered = dealt.repartition(-(-archives // TASK_ARCHIVES), "archive").sortWithinPartitions("archive", F.col("page_id").asc_nulls_first(), "hash")
    ordered.select("archive", "record").write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _parse(content: bytes):
    """(offset, length, record id, its turn among equal ids, sha256) of each record; damage up to the next mark is a record `damaged`."""
    data, at, turns = zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content, 0, {}
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(_MARK, at) else -1
        head = data[at : end + 2] if end >= 0 else b""
        length, name = _LENGTH.search(head), _ID.search(head)
        stop = end + 4 + int(length[1]) if length and name else -1
        if stop < 0 or data[stop : stop + 4] != b"\r\n\r\n":
            following = data.find(b"\r\n\r\n" + _MARK, at)
            stop, key = following if following >= 0 else len(data), "damaged"
        else:
            key = name[1].decode("utf-8", "replace")
        turns[key] = turns.get(key, 0) + 1
        yield at, stop - at, key, turns[key], hashlib.sha256(data[at:stop]).hexdigest()
        at = stop + 4


_RECORDS = "archive long, ordinal long, offset long, length long, record_id string, turn long, hash string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below path. Files are a few megabytes, and an Arrow batch holds few of them."""

    def parse(it):
        for batch in batches(it):
            names, contents = batch.column(0).to_pylist(), batch.column(1)
            for name, content in zip(names, contents, strict=True):
                archive = int(re.search(r"archive=(\d+)/", name)[1])
                rows = [(archive, i, *r) for i, r in enumerate(_parse(content.as_py()))]
                if rows:
                    types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _RECORDS.split(", ")])

    bytes_key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bytes_key)
    spark.conf.set(bytes_key, str(4 * ARCHIVE_BYTES))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = materialize(files.select("path", "content").mapInArrow(parse, _RECORDS), "warc-records")
    spark.conf.set(bytes_key, before)
    return out


def merkle_levels(records: DataFrame) -> list[DataFrame]:
    """[records, nodes of FANOUT records, ..., roots]: (archive, node, start, end, hash), each level written once."""
    level = records.select("archive", F.col("ordinal").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "hash")
    levels = [level]
    while True:
        level = levels[-1]
        grouped = level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("node", (F.col("end") - F.col("start")).alias("length"), "hash"))).alias("children")
        )
        parent = grouped.select("archive", "node", "start", "end", F.sha2(F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["length"].cast("string"), c["hash"])), ","), 256).alias("hash"))
        levels.append(materialize(parent, "merkle"))
        if not (levels[-1].agg(F.max("node")).first()[0] or 0):
            return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records that differ between two replicas (as read_warc gives them): archive, record_id, turn, both places, status.

    status: changed, missing (not in the second) or extra (not in the first).
    """
    one, two = merkle_levels(first), merkle_levels(second)
    depth = max(len(one), len(two))
    # a shorter tree's root stands for itself on the levels above
    one, two = one + [one[-1]] * (depth - len(one)), two + [two[-1]] * (depth - len(two))
    wanted = None
    for a, b in zip(one[:0:-1], two[:0:-1], strict=True):
        if wanted is not None:
            a, b = (x.join(wanted, (x["archive"] == wanted["of"]) & (F.floor(x["node"] / FANOUT) == wanted["parent"]), "left_semi") for x in (a, b))
        both = a.select("archive", "node", F.col("hash").alias("h1")).join(b.select("archive", "node", F.col("hash").alias("h2")), ["archive", "node"], "full_outer")
        wanted = materialize(both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select(F.col("archive").alias("of"), F.col("node").alias("parent")), "merkle-differing")
    below = lambda x: x.join(wanted, (x["archive"] == wanted["of"]) & (F.floor(x["ordinal"] / FANOUT) == wanted["parent"]), "left_semi")
    left = below(first).select("archive", "record_id", "turn", F.col("offset").alias("offset_1"), F.col("length").alias("length_1"), F.col("hash").alias("h1"))
    right = below(second).select("archive", "record_id", "turn", F.col("offset").alias("offset_2"), F.col("length").alias("length_2"), F.col("hash").alias("h2"))
    both = left.join(right, ["archive", "record_id", "turn"], "full_outer").filter(~F.col("h1").eqNullSafe(F.col("h2")))
    status = F.when(F.col("h2").isNull(), "missing").when(F.col("h1").isNull(), "extra").otherwise("changed")
    return both.select("archive", "record_id", "turn", "offset_1", "length_1", "offset_2", "length_2", status.alias("status"))


def damaged_copy(records: DataFrame) -> DataFrame:
    """A replica with planted faults, for a drill: of page_ids that leave 13 by 97 the record's last character changes, of those that leave 14 the record is lost."""
    rest = F.pmod("page_id", F.lit(97))
    flipped = F.concat(F.expr("left(record, length(record) - 1)"), F.lit("~"))
    return records.filter(~F.coalesce(rest == 14, F.lit(False))).withColumn("record", F.when((rest == 13) & ~F.col("record").endswith("\n") & ~F.col("record").rlike("[^\\x00-\\x7F]$"), flipped).otherwise(F.col("record")))


def drill(pages: DataFrame) -> DataFrame:
    """Write all pages as two replicas, the second with planted faults, read both back and audit them.

    Returns page_id, length (of the record in the first replica) and status of each record that differs.
    """
    spark = pages.sparkSession
    archives, records = archives_for(pages), warc_records(pages)
    replicas = []
    for rows in (records, damaged_copy(records)):
        path = scratch_path(spark, "warc")
        write_warc(rows, path, archives)
        replicas.append(read_warc(spark, path))
    return audit(*replicas).select(F.col("record_id").cast("long").alias("page_id"), F.col("length_1").alias("length"), "status")


#: The drill's rows in DuckDB SQL, from the table alone.
ORACLE_SQL = """
WITH r AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, ''))) AS length
  FROM pages)
SELECT page_id, CAST(length AS BIGINT) AS length, CASE WHEN page_id % 97 = 14 THEN 'missing' ELSE 'changed' END AS status
FROM r WHERE page_id % 97 = 14 OR (page_id % 97 = 13 AND NOT regexp_matches(html, '[^\\x00-\\x7F]$') AND NOT ends_with(html, chr(10)) AND NOT ends_with(html, '~'))
"""
