"""File trees as tables: listing, change detection, and reading the files that changed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmine.functions.paths import excluded

LISTING = "file_path string, mtime long, size long"
CONTENT = "file_path string, mtime long, content string, error string"
#: Up to this many changed files are read by path; for more, the roots are read and joined with the list.
BY_PATH = 5_000
HIDDEN = "/[._][^/]*(/|$)"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def plain_path(path: str) -> str:
    """A path without the local scheme; other schemes stay."""
    return re.sub("^file:/+", "/", path)


def _walk(spark: SparkSession, root: str) -> Iterator[tuple[str, int, int]]:
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        raise FileNotFoundError(root)
    files = fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        yield plain_path(f.getPath().toString()), f.getModificationTime() // 1000, f.getLen()


def list_tree(spark: SparkSession, roots: list[str], exclude: list[str] = (), suffix: str = ".md") -> DataFrame:
    """(file_path, mtime, size) of all files below the roots that end in `suffix` and match no exclude glob.

    Through Spark's file systems, with names that begin with a dot or an underscore (Spark's readers hide those).
    Only metadata is listed; a file under two roots counts once.
    """
    parts = [spark.createDataFrame([r for r in _walk(spark, root) if r[0].endswith(suffix)], LISTING) for root in dict.fromkeys(roots)]
    if not parts:
        return spark.createDataFrame([], LISTING)
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["file_path"]).filter(~excluded("file_path", list(exclude)))


def changed_files(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of listing whose path isn't stored, or is with an earlier mtime (whole seconds)."""
    known = stored.select("file_path", F.col("mtime").alias("__stored"))
    return listing.join(known, "file_path", "left").filter(F.col("__stored").isNull() | (F.col("__stored") < F.col("mtime"))).drop("__stored")


def gone_files(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path) of stored files that are no longer listed."""
    return stored.select("file_path").join(listing.select("file_path"), "file_path", "left_anti")


def read_files(spark: SparkSession, roots: list[str], wanted: DataFrame) -> DataFrame:
    """(file_path, mtime, content, error) of the wanted files (file_path, mtime); text that isn't UTF-8 is an error, not content."""
    hidden_rows = wanted.filter(F.col("file_path").rlike(HIDDEN))
    shown = wanted.filter(~F.col("file_path").rlike(HIDDEN))
    count = shown.count()
    parts = []
    if count:
        if count <= BY_PATH:
            escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["file_path"]) for r in shown.select("file_path").collect()]
            read = spark.read.format("binaryFile").load(escaped)
        else:
            read = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(r) for r in dict.fromkeys(roots)])
        read = read.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), "content").dropDuplicates(["file_path"]) if count > BY_PATH else read.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), "content")
        parts.append(shown.select("file_path", "mtime").join(read, "file_path", "left"))
    raw = [(r["file_path"], r["mtime"], _read_one(spark, r["file_path"])) for r in hidden_rows.select("file_path", "mtime").toLocalIterator()]  # few: names that Spark hides
    if raw or not parts:
        parts.append(spark.createDataFrame(raw, "file_path string, mtime long, content binary"))
    rows = reduce(DataFrame.unionByName, parts)
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    error = F.when(F.col("content").isNull(), "the file can't be read").when(~good, "the file isn't UTF-8")
    return rows.select("file_path", "mtime", F.when(good, text).alias("content"), error.alias("error"))


def _read_one(spark: SparkSession, path: str) -> bytes | None:
    fs, hadoop_path = _file_system(spark, path)
    try:
        stream = fs.open(hadoop_path)
    except Exception:  # noqa: BLE001  reported as that file's error
        return None
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """The listing row of a single file, whatever its name; FileNotFoundError if it is missing."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        raise FileNotFoundError(path)
    status = fs.getFileStatus(hadoop_path)
    return spark.createDataFrame([(plain_path(status.getPath().toString()), status.getModificationTime() // 1000, status.getLen())], LISTING)
