"""Helpers shared by the training-data operators: shared scratch tables, row shaping, token codec."""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"

#: Word separators of the row contracts: space and U+0009 to U+000D.
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and everything runs in one
    process (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scrollmine-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in frames:
        drop_path(df.sparkSession, df.scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path early, through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows and 32 MB at most, as documents may be long; settings of the caller's own stay.

    Python workers do matrix products in their own thread: a task has one core, and more threads wait for each other.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def spread(df: DataFrame, rows_per_task: int = 4096) -> DataFrame:
    """Deal a table held in few splits over more tasks; a table with enough splits is left as it is.

    Works on the number of input splits (metadata only) and moves rows round-robin, so no key can be hot.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column of a batch with null as the empty text."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


#: Fixed values of the public tokenizer file: its pre-tokenizer pattern on lower-cased text, written out for
#: texts of ASCII and Latin-1 letters only.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_UNSAFE = re.compile("[^\\x09-\\x0D\\x20-\\x7EÀ-ÖØ-öø-ÿ]|<\\|")


def plain(text: str) -> bool:
    """Whether the ids of a text are those of its words, one after the other."""
    return not _UNSAFE.search(text)


class TokenCodec:
    """Token ids of whole texts by the tokenizers library, with a bounded per-process cache.

    A text of ASCII and Latin-1 letters is cut at white space and by the file's own pattern, and each piece is
    encoded by the library's BPE model; any other text goes through the library's whole pipeline. Both give the
    same ids (see tests). Ids travel as bytes: little-endian unsigned 32-bit integers. The cache holds at most
    max_cached words and pieces; what it has no room for is encoded again each time.
    """

    def __init__(self, name: str = TOKENIZER, max_cached: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenize, byte_chars, pack = self.tokenizer.model.tokenize, _byte_chars(), [struct.Struct(f"<{n}I").pack for n in range(64)]
        pieces_of = _PIECES.findall

        class Cache(dict):
            def __missing__(cache, word):
                pieces = pieces_of(word)
                if len(pieces) != 1:
                    known = len(cache)
                    packed = b"".join([cache[x] for x in pieces])
                    if known != len(cache) or known >= max_cached:
                        return packed  # a piece was new: the word is likely rare, so only its pieces are kept
                else:
                    ids = [t.id for t in tokenize(word if word.isascii() else "".join([byte_chars[b] for b in word.encode()]))]
                    packed = pack[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)
                    if len(cache) >= max_cached:
                        return packed
                cache[word] = packed
                return packed

        self.words = Cache()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not plain(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE files: printable bytes stay, others move past U+00FF."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, moved = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + moved)
            moved += 1
    return [table[b] for b in range(256)]


_codec: TokenCodec | None = None


def codec() -> TokenCodec:
    """One codec per Python worker, kept between tasks."""
    global _codec
    if _codec is None:
        _codec = TokenCodec()
    return _codec


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            yield batch


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores at its end as make it clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def base_columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so extra columns (whatever their names) can't clash with an operator's own."""
    return docs.select(*(F.col(f"`{n}`") for n in names))
