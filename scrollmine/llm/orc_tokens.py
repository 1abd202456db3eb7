"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

File format: a folder of ORC files `part-NNNNN-*`, in ascending doc_id order within and across files, with columns
`doc_id` (null first), `n_tokens`, `token_start` (ids before the document within its file) and `tokens`
(array<int>, each document's ids then END_ID). ORC's writer stores the ids in run-length encoded stripes that are
read in parallel; stripe and row-group statistics and the Bloom filter on doc_id let a lookup skip the rest.

Defined cases: a null or empty text gives one id, END_ID; repeated doc_ids and rows are kept, in any order among
themselves; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import base_columns, batches, codec, scratch_path, texts_of

END_ID = 1
ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """An array of int lists over byte strings of little-endian ids, without a copy per id."""
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _encode(it):
    encode, end, before = codec().encode, struct.pack("<I", END_ID), 0
    for whole in batches(it):
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            packed = [encode(t) + end for t in texts_of(batch)]
            n = np.array([len(x) // 4 for x in packed], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n), pa.array(starts), id_lists(packed)],
                names=["doc_id", "n_tokens", "token_start", "tokens"],
            )


def write_tokens(docs: DataFrame, path: str) -> None:
    """Encode whole texts and write them in ascending doc_id order.

    The texts are dealt by ranges of doc_id before they are encoded (texts are smaller than their ids); the row
    number as a second key splits even a run of one repeated id.
    """
    rows = base_columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    encoded = ordered.drop("row").mapInArrow(_encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, token_start long, tokens array<int>")
    (
        encoded.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with `part`, the file's place in the order."""
    rows = spark.read.schema("doc_id long, n_tokens long, token_start long, tokens array<int>").orc(path)
    return rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document; the filter reaches the stripes' statistics and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id") == doc_id)


def _digest(it):
    for batch in batches(it):
        lists = batch.column(batch.schema.get_field_index("tokens"))
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        yield pa.RecordBatch.from_arrays(
            [column("doc_id"), column("part"), column("token_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "token_start", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    The files' totals come from the n_tokens column alone; their running sum is over one row for each file.
    """
    rows = read_tokens(spark, path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = rows.select("doc_id", "part", "token_start", "tokens").mapInArrow(_digest, "doc_id long, part long, token_start long, n_tokens long, ids_crc32 long")
    return own.join(base, "part").select("doc_id", (F.col("base") + F.col("token_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame) -> DataFrame:
    """Write the documents' ids to the shared folder and return the digests read back from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "orc-tokens")
    write_tokens(docs, path)
    return digests(spark, path)
