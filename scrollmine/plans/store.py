"""The index: Parquet tables in buckets of files, with a manifest that names each bucket's current generation.

An update writes a new generation of the buckets it touches, in every table, and then the manifest, in one rename: a
reader sees the state before or after, never between, and a failed update leaves the old one. Postings, lengths and
vectors lie in their file's bucket, so an update rewrites them with their chunks and nothing else. Ids are hashes of
path and chunk number; vectors carry a hash of the text they were made of, so a vector of an older text is no vector.

Texts and postings are never shuffled to be written: each task writes its own file of each bucket, sorted, and postings
are made batch by batch of the chunks as written. Only paths, ids and counts move. The first vectors of a bucket are
written the same way; later ones are joined by chunk.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmine import schema
from scrollmine.functions.vectors import decoded
from scrollmine.operators import bm25
from scrollmine.operators.chunking import chunk_documents
from scrollmine.operators.filters import SearchOptions
from scrollmine.operators.fusion import OVERFETCH, RRF_K, rrf
from scrollmine.operators.postings import chunk_postings
from scrollmine.operators.vector import knn
from scrollmine.sources import files as sources
from scrollmine.sources.providers import EmbeddingProvider, embed_chunks

TABLES = {"files": schema.FILES, "chunks": schema.CHUNKS, "postings": schema.POSTINGS, "lengths": schema.DOC_STATS, "embeddings": schema.EMBEDDINGS}
#: Order of rows within a bucket's file: what searches filter by, or what lies near the same text.
ORDER = {"files": ["file_id"], "chunks": ["file_id", "chunk_index"], "postings": ["term"], "lengths": ["chunk_id"], "embeddings": ["chunk_id"]}
#: A postings file holds few distinct chunks and its terms in order, so that dictionaries make both small.
PARQUET = {"compression": "zstd", "parquet.dictionary.page.size": str(4 << 20)}
#: Up to so many keys (8 bytes or a short path each) are sent to all tasks; more are joined by a shuffle.
FEW = 1_000_000
EXCLUDE = ["**/Templates/**", "**/.obsidian/**", "**/attachments/**", "**/*.sync-conflict-*"]


def hinted(keys: DataFrame) -> DataFrame:
    """Keys for a join, sent to all tasks if there are few (they are counted), so that the rows on the other side stay where they are."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def _result() -> list[F.Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.RESULT.fields]


@dataclass
class Stats:
    file_count: int
    chunk_count: int
    last_indexed: str | None


class Store:
    def __init__(self, spark: SparkSession, root: str, dimensions: int = 768, buckets: int = 16):
        self.spark, self.root, self.dimensions = spark, root.rstrip("/"), dimensions
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.create(buckets)

    # --- manifest ---------------------------------------------------------------------------------------------------

    def create(self, buckets: int) -> None:
        """Make an empty store where there is none."""
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        if not self._versions():
            self._commit({"version": 0, "buckets": buckets, "dimensions": self.dimensions, "tables": {t: {} for t in TABLES}})
        kept = self.manifest()
        self.buckets, self.dimensions = kept["buckets"], kept["dimensions"]

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{self._versions()[-1]}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        part, whole = (self._path(f"{self.root}/manifests/{manifest['version']}.{x}") for x in ("part", "json"))
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(whole) or not self._fs.rename(part, whole):
            raise RuntimeError(f"another update has written version {manifest['version']}")

    def vacuum(self) -> int:
        """Delete the generations and manifests that the current one doesn't name; returns how many folders went."""
        now, gone = self.manifest(), 0
        for table in TABLES:
            base = self._path(f"{self.root}/{table}")
            if not self._fs.exists(base):
                continue
            live = set(now["tables"][table].values())
            for generation in self._fs.listStatus(base):
                number = int(generation.getPath().getName().partition("=")[2])
                for bucket in self._fs.listStatus(generation.getPath()):
                    name = bucket.getPath().getName()
                    if name.startswith("bucket=") and (number not in live or now["tables"][table].get(name[7:]) != number):
                        self._fs.delete(bucket.getPath(), True)
                        gone += 1
        for v in self._versions()[:-1]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)
        return gone

    # --- tables -----------------------------------------------------------------------------------------------------

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's current rows with their bucket; only the wanted buckets' files are opened."""
        live = self.manifest()["tables"][table]
        wide = schema.T.StructType([*TABLES[table].fields, schema.T.StructField("bucket", schema.T.IntegerType())])
        chosen = {b: g for b, g in live.items() if buckets is None or int(b) in buckets}
        parts = []
        for g in sorted(set(chosen.values())):
            paths = [f"{self.root}/{table}/gen={g}/bucket={b}" for b, own in chosen.items() if own == g]
            parts.append(self.spark.read.schema(wide).option("basePath", f"{self.root}/{table}/gen={g}").parquet(*paths))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], wide)

    def files(self) -> DataFrame:
        return self._read("files").drop("bucket")

    def chunks(self) -> DataFrame:
        return self._read("chunks").drop("bucket")

    def postings(self) -> DataFrame:
        return self._read("postings").drop("bucket")

    def lengths(self) -> DataFrame:
        return self._read("lengths").drop("bucket")

    def embeddings(self) -> DataFrame:
        """Vectors of the chunks' present texts."""
        own = self.chunks().select("chunk_id", F.xxhash64("content").alias("content_hash"))
        return self._read("embeddings").drop("bucket").join(own, ["chunk_id", "content_hash"], "left_semi")

    def _bucket(self, path: str = "file_path"):
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, path: str) -> None:
        """Write rows of a table; each task writes its rows of each bucket."""
        columns = [f.name for f in TABLES[table].fields]
        rows.select(*columns, "bucket").sortWithinPartitions("bucket", *ORDER[table]).write.options(**PARQUET).partitionBy("bucket").parquet(path)

    def _put(self, table: str, rows: DataFrame, version: int) -> None:
        """Write a generation of a table."""
        self._write(table, rows, f"{self.root}/{table}/gen={version}")

    def _name(self, now: dict, version: int, tables: list[str], buckets: list[int]) -> None:
        """Commit what _put() wrote of the buckets; those without rows are empty from now on."""
        for table in tables:
            base = self._path(f"{self.root}/{table}/gen={version}")
            written = {s.getPath().getName()[7:] for s in self._fs.listStatus(base) if s.getPath().getName().startswith("bucket=")}
            live = now["tables"][table]
            for b in map(str, buckets):
                if b in written:
                    live[b] = version
                else:
                    live.pop(b, None)
        self._commit(now | {"version": version})

    # --- indexing ---------------------------------------------------------------------------------------------------

    def replace_files(self, contents: DataFrame, gone: DataFrame | None = None, indexed_at: int | None = None, everything: bool = False) -> DataFrame:
        """Put files (file_path, mtime, content, error) in place of what is stored of their paths, and drop the paths in `gone`.

        Files with an error stay as they are stored; returns (file_path, error) of those. `contents` is computed more
        than once and must give the same rows each time; a path that occurs again counts with its latest mtime.
        """
        indexed_at = int(time.time()) if indexed_at is None else indexed_at
        if "error" not in contents.columns:
            contents = contents.withColumn("error", F.lit(None).cast("string"))
        good = self._distinct(contents.filter("error is null and content is not null")).withColumn("file_id", F.xxhash64("file_path"))
        changed = good.select("file_path")
        if gone is not None:
            changed = changed.union(gone.select("file_path"))
        buckets = list(range(self.buckets)) if everything else sorted(r[0] for r in changed.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets` rows
        if buckets:
            self._replace(good, changed.select(F.xxhash64("file_path").alias("file_id")).distinct(), buckets, indexed_at, everything)
        return self.spark.createDataFrame(contents.filter("error is not null").select("file_path", "error").collect(), "file_path string, error string")  # a row a failed file

    def _distinct(self, files: DataFrame) -> DataFrame:
        """One row a path, of the latest mtime; only paths move, and the rows of paths that occur again."""
        again = files.groupBy("file_path").count().filter("count > 1").select("file_path")
        if again.isEmpty():
            return files
        again = hinted(again)
        latest = Window.partitionBy("file_path").orderBy(F.desc("mtime"), "content")
        one = files.join(again, "file_path", "left_semi").withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")
        return files.join(again, "file_path", "left_anti").unionByName(one)

    def _replace(self, good: DataFrame, changed: DataFrame, buckets: list[int], indexed_at: int, everything: bool) -> None:
        """A generation of the buckets: what is stored of files other than the changed ones (file_id), and the good files."""
        now = self.manifest()
        version = now["version"] + 1
        old = {t: None if everything or not any(str(b) in now["tables"][t] for b in buckets) else self._read(t, buckets) for t in TABLES}
        plus = lambda t, kept, new: new if kept is None else kept.unionByName(new.select(kept.columns))
        kept = dict(old)
        if old["files"] is not None:
            changed = hinted(changed)
            kept |= {t: old[t].join(changed, "file_id", "left_anti") for t in ("files", "chunks") if old[t] is not None}
        if old["chunks"] is not None:
            lost = hinted(old["chunks"].join(changed, "file_id", "left_semi").select("chunk_id"))
            kept |= {t: old[t].join(lost, "chunk_id", "left_anti") for t in ("postings", "lengths", "embeddings") if old[t] is not None}
        cut = chunk_documents(good.select("file_id", "file_path", "content")).withColumn("chunk_id", F.xxhash64("file_path", "chunk_index")).withColumn("bucket", self._bucket())
        self._put("chunks", plus("chunks", kept["chunks"], cut), version)
        schema_of = schema.T.StructType([*TABLES["chunks"].fields, schema.T.StructField("bucket", schema.T.IntegerType())])
        new = self.spark.read.schema(schema_of).parquet(f"{self.root}/chunks/gen={version}")
        if kept["chunks"] is not None:
            new = new.join(changed, "file_id", "left_semi")
        counts = new.groupBy("file_id").agg(F.count("*").alias("chunk_count"))
        files = good.select("file_id", "file_path", "mtime").join(counts, "file_id", "left").select("*", F.lit(indexed_at).cast("long").alias("indexed_at"), self._bucket().alias("bucket"))
        self._put("files", plus("files", kept["files"], files.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))), version)
        self._put("postings", plus("postings", kept["postings"], chunk_postings(new)), version)
        posted = self.spark.read.schema(TABLES["postings"]).parquet(f"{self.root}/postings/gen={version}").groupBy("chunk_id").agg(F.sum(F.size("positions")).alias("length"))
        lengths = new.select("chunk_id", "bucket").join(posted, "chunk_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))  # cheaper than cutting the texts again
        self._put("lengths", plus("lengths", kept["lengths"], lengths), version)
        self._put("embeddings", self._read("embeddings").limit(0) if kept["embeddings"] is None else kept["embeddings"], version)
        self._name(now, version, list(TABLES), buckets)

    def replace_read(self, roots: list[str], wanted: DataFrame, gone: DataFrame | None = None, everything: bool = False) -> DataFrame:
        """replace_files() of files to be read; they are read once, as they may change meanwhile."""
        contents = sources.read_files(self.spark, roots, wanted).persist()
        try:
            return self.replace_files(contents, gone, everything=everything)
        finally:
            contents.unpersist()

    def index_full(self, roots: list[str], exclude: list[str] = EXCLUDE) -> DataFrame:
        """Index all files below all roots and forget everything else."""
        listing = sources.list_tree(self.spark, roots, exclude)
        return self.replace_read(roots, listing, everything=True)

    def index_incremental(self, roots: list[str], exclude: list[str] = EXCLUDE, prune: bool = False) -> DataFrame:
        """Index new and newer files; with prune, forget files that are gone."""
        listing = sources.list_tree(self.spark, roots, exclude)
        stored = self.files()
        changed = sources.changed_files(listing, stored)
        return self.replace_read(roots, changed, sources.gone_files(listing, stored) if prune else None)

    def index_file(self, path: str) -> DataFrame:
        """Index one file, whatever its name and time."""
        row = sources.one_file(self.spark, path)
        return self.replace_read([path], row)

    # --- vectors ----------------------------------------------------------------------------------------------------

    def store_embeddings(self, vectors: DataFrame) -> None:
        """Put vectors (chunk_id, embedding[, content_hash]) in place of the chunks' own; chunks that don't exist are skipped."""
        wrong = vectors.filter(F.size("embedding") != self.dimensions)
        if not wrong.isEmpty():
            raise ValueError(f"vectors need {self.dimensions} dimensions")
        own = self._read("chunks").select("chunk_id", F.xxhash64("content").alias("__hash"), "bucket")
        joined = vectors.join(own, "chunk_id")
        if "content_hash" in vectors.columns:
            joined = joined.filter(F.col("content_hash") == F.col("__hash"))
        new = joined.select("chunk_id", F.col("__hash").alias("content_hash"), F.col("embedding").cast("array<float>").alias("embedding"), "bucket").dropDuplicates(["chunk_id"]).persist()
        buckets = sorted(r[0] for r in new.select("bucket").distinct().collect())
        if buckets:
            old = self._read("embeddings", buckets).join(new.select("chunk_id"), "chunk_id", "left_anti")
            now = self.manifest()
            self._put("embeddings", old.unionByName(new.select(old.columns)), now["version"] + 1)
            self._name(now, now["version"] + 1, ["embeddings"], buckets)
        new.unpersist()

    def missing_embeddings(self) -> DataFrame:
        """(chunk_id, content) of chunks without a vector of their present text."""
        return self._missing().select("chunk_id", "content")

    def _missing(self) -> DataFrame:
        """missing_embeddings() with all columns of chunks and their bucket."""
        chunks, stored = self._read("chunks"), self._read("embeddings").count()  # from the files' footers; as many vectors at most
        if not stored:
            return chunks
        keys = self.embeddings().select("chunk_id")
        return chunks.join(F.broadcast(keys) if stored <= FEW else keys, "chunk_id", "left_anti")

    def embed(self, provider: EmbeddingProvider, limit: int | None = None, everything: bool = False, tasks: int = 8) -> tuple[int, int]:
        """Embed chunks without a vector (the first `limit` by id), or all; returns (succeeded, failed).

        Vectors keep their chunk's bucket, so each task writes its own and none are cached or shuffled; where buckets
        have no vectors yet, what was written becomes their generation.
        """
        provider.ensure_ready()
        begun = self.manifest()
        todo = (self._read("chunks") if everything else self._missing()).select("chunk_id", "content", "bucket")
        if limit is not None:
            todo = todo.orderBy("chunk_id").limit(limit)
        total = todo.count()
        if total and provider.dimensions != self.dimensions:
            raise ValueError(f"vectors need {self.dimensions} dimensions")
        # texts are shuffled only where they are too few for so many tasks
        todo = todo.coalesce(tasks) if limit is None and todo.rdd.getNumPartitions() >= tasks else todo.repartition(tasks)
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        try:
            self._write("embeddings", embed_chunks(todo, provider).filter("error is null"), staged)
            wide = schema.T.StructType([*TABLES["embeddings"].fields, schema.T.StructField("bucket", schema.T.IntegerType())])
            vectors = self.spark.read.schema(wide).parquet(staged)
            succeeded = vectors.count()
            if succeeded:
                self._take(vectors, staged, begun)
        finally:
            self._fs.delete(self._path(staged), True)
        return succeeded, total - succeeded

    def _take(self, vectors: DataFrame, staged: str, begun: dict) -> None:
        """Make written vectors part of the store: as they are if their buckets have none and no chunk has changed since `begun`, else by store_embeddings()."""
        now = self.manifest()
        version, live = now["version"] + 1, now["tables"]["embeddings"]
        buckets = sorted(int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path(staged)) if s.getPath().getName().startswith("bucket="))
        target = self._path(f"{self.root}/embeddings/gen={version}")
        if now["tables"]["chunks"] != begun["tables"]["chunks"] or any(str(b) in live for b in buckets) or self._fs.exists(target):
            self.store_embeddings(vectors.drop("bucket"))
            return
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(staged), target):
            raise RuntimeError(f"another update is writing version {version}")
        self._name(now, version, ["embeddings"], buckets)

    def migrate_blobs(self, legacy: DataFrame) -> None:
        """Take over vectors (chunk_id, embedding binary): little-endian floats; those of unknown chunks or another length are skipped."""
        rows = legacy.select("chunk_id", decoded("embedding", self.dimensions).alias("embedding")).filter("embedding is not null")
        self.store_embeddings(rows)

    # --- numbers ----------------------------------------------------------------------------------------------------

    def stats(self) -> Stats:
        f = self.files().agg(F.count("*").alias("n"), F.date_format(F.timestamp_seconds(F.max("indexed_at")), "yyyy-MM-dd HH:mm:ss").alias("last")).first()
        return Stats(f["n"], self._read("chunks").count(), f["last"])

    def embedding_stats(self) -> tuple[int, int]:
        """(chunks with a vector, chunks)."""
        return self.embeddings().count(), self._read("chunks").count()

    # --- search -----------------------------------------------------------------------------------------------------

    def results(self, ranked: DataFrame) -> DataFrame:
        """The result rows of ranked chunks (chunk_id, score, rank), in order; unknown ids are dropped."""
        return self._rows(F.broadcast(ranked)).orderBy("rank").select(*_result())  # ranked: a query's few rows

    def _rows(self, found: DataFrame) -> DataFrame:
        """found (chunk_id, ...) with the columns of results. Paths are joined by ids, so that texts stay where they are."""
        placed = found.join(self.chunks().select("chunk_id", "file_id"), "chunk_id").join(self.files().select("file_id", "file_path"), "file_id").drop("file_id")
        return hinted(placed).join(self.chunks(), "chunk_id")

    def search_keyword(self, query: str, limit: int | None, options: SearchOptions | None = None) -> DataFrame:
        """The best chunks by BM25, or without a limit all that match, in the same order; filters drop rows and leave the corpus's statistics alone."""
        scored = bm25.match_scores(query, self.postings(), self.lengths())
        if options is not None:
            scored = scored.join(self._fitting(options), "chunk_id", "left_semi")
        if limit is None:
            return self._rows(scored).orderBy(*bm25.best_first()).select(*_result())
        return self.results(bm25.top(scored, limit))

    def _fitting(self, options: SearchOptions, *more: Column) -> DataFrame:
        """(chunk_id, more) of the chunks that pass the filters."""
        return self.chunks().join(self.files().select("file_id", "file_path"), "file_id").filter(options.condition()).select("chunk_id", *more)

    def _placed(self, rows: DataFrame, options: SearchOptions | None, ties: list[Column | str] | None) -> DataFrame:
        """Rows (chunk_id, ...) that pass the filters; with `ties`, chunk_id is a struct of these and the id, in whose order equals stand."""
        if ties:
            keys = self._fitting(options or SearchOptions(), F.struct(*ties, "chunk_id").alias("__key"))
            return rows.join(keys, "chunk_id").withColumn("chunk_id", F.col("__key")).drop("__key")
        return rows if options is None else rows.join(self._fitting(options), "chunk_id", "left_semi")

    def search_vector(self, vector: list[float], limit: int, options: SearchOptions | None = None) -> DataFrame:
        """(chunk_id, distance, rank)."""
        return knn(self._placed(self.embeddings(), options, None), vector, limit)

    def search_hybrid(self, query: str, vector: list[float], limit: int, k: int = RRF_K, options: SearchOptions | None = None, whole: bool = False, ties: list[Column | str] | None = None) -> DataFrame:
        """Keyword and vector lists of OVERFETCH * limit each, fused; options apply only if given (they don't by default), to both lists.

        With `whole`, the keyword list is all that match. `ties` (columns of chunks and file_path) order equals, in the
        lists and the result, before the chunk's id. The near list and the result are few rows and go by the driver.
        """
        scored = self._placed(bm25.match_scores(query, self.postings(), self.lengths()), options, ties)
        near = self._held(knn(self._placed(self.embeddings(), options, ties), vector, limit * OVERFETCH).select("chunk_id", "rank"))
        # results are near ones or among the best `limit` others, which the near ones push down by their number at most
        words = bm25.top_and(scored, limit * (OVERFETCH + 1), near) if whole else bm25.top(scored, limit * OVERFETCH)
        fused = rrf([x.withColumn("query_id", F.lit(0)) for x in (words, near)], limit, k, places=10)
        return self.results(self._held(fused.withColumn("chunk_id", F.col("chunk_id.chunk_id")) if ties else fused))

    def _held(self, few: DataFrame) -> DataFrame:
        """A few rows, computed once."""
        return self.spark.createDataFrame(few.collect(), few.schema)
