"""Queries that go through the store: documents and benchmark passages indexed, changed, embedded, watched and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmine.api import Engine
from scrollmine.config import Config
from scrollmine.operators.filters import SearchOptions
from scrollmine.plans import formats
from scrollmine.plans.store import hinted
from scrollmine.queries import _DISTANCE, _WEIGHT, TOP, _as_files, _chunk_sql, _put, _store, _table, query
from scrollmine.sources.providers import EmbeddingProvider, HashingEmbedder, RerankProvider
from scrollmine.streaming.watch import index_changes

#: Results in one JSON text.
PAGE = 1_000
_CHUNKS = f"c AS ({_chunk_sql('text', 'content')})"
#: BM25 over chunks: the words of each, their lengths, and the score of the chunks that hold all of the words in q.
_SCORED = f"""{_CHUNKS}, words AS (SELECT doc_id, chunk_index, regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS w FROM c),
  len AS (SELECT doc_id, chunk_index, len(w) AS dl FROM words), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
  tf AS (SELECT doc_id, chunk_index, q.t AS term, len(list_filter(w, lambda x: x = q.t)) AS tf FROM words CROSS JOIN q), dfs AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1),
  scored AS (SELECT doc_id, chunk_index, sum({_WEIGHT}) AS score FROM tf JOIN dfs USING (term) JOIN len USING (doc_id, chunk_index) CROSS JOIN st WHERE tf > 0 GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM q))"""


def _id(path: str = "file_path"):
    """The document's number in a path."""
    return F.regexp_extract(path, "([0-9]+)[.]md$", 1).cast("long").alias("doc_id")


def _indexed(spark, d, label: str):
    store = _store(spark, label)
    store.replace_files(_files(_table(spark, d, "documents")), indexed_at=0, everything=True)
    return store


def _files(docs: DataFrame, text="text") -> DataFrame:
    return _as_files(docs, text).select("file_path", F.lit(1).cast("long").alias("mtime"), "content")


@query(f"WITH q AS (SELECT unnest(['the', 'of']) AS t), {_SCORED} SELECT doc_id, start_line, end_line, md5(content) AS content_md5, round(score, 6) AS score FROM scored JOIN c USING (doc_id, chunk_index) WHERE doc_id::VARCHAR LIKE '%1%'")
def store_search_keyword(spark, d):
    """All chunks that match, of files whose path fits a pattern; the corpus's statistics are those of all chunks."""
    found = _indexed(spark, d, "keyword").search_keyword("the of", None, SearchOptions(file_pattern="*1*.md"))
    return found.select(_id(), "start_line", "end_line", F.md5("content").alias("content_md5"), F.round("score", 6).alias("score"))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with one of the labels."""
    return docs.join(hinted(labels.select("doc_id")), "doc_id", "left_semi")


def _first_chunks(store) -> DataFrame:
    """(chunk_id, doc_id, content) of each file's first chunk."""
    return store.files().join(store.chunks().filter("chunk_index = 0"), "file_id").select("chunk_id", _id(), "content")


def _with_vectors(spark, d, label: str):
    """The documents, and the vectors of their numbers for their first chunks."""
    store = _indexed(spark, d, label)
    vectors = _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    store.store_embeddings(_first_chunks(store).join(vectors, "doc_id").select("chunk_id", "embedding"))
    return store


_NEAR = f"near AS (SELECT doc_id, {_DISTANCE.format(a='embedding', b='v')} AS x FROM (SELECT DISTINCT doc_id FROM c) JOIN embeddings ON vec_id = doc_id CROSS JOIN (SELECT embedding AS v FROM embeddings WHERE vec_id = 0))"


@query(f"WITH {_CHUNKS}, {_NEAR} SELECT doc_id, round(x, 6) AS distance, CAST(row_number() OVER (ORDER BY x, doc_id) AS INTEGER) AS rank FROM near QUALIFY rank <= {TOP}")
def store_search_vector(spark, d):
    store = _with_vectors(spark, d, "vector")
    asked = _table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]
    return store.search_vector(list(asked), TOP).join(_first_chunks(store), "chunk_id").select("doc_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    f"""WITH q AS (SELECT unnest(['rights', 'nicht']) AS t), {_SCORED}, {_NEAR},
  lists AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE doc_id::VARCHAR LIKE '%1%'
    UNION ALL SELECT doc_id, 0, row_number() OVER (ORDER BY x, doc_id) AS rank FROM near WHERE doc_id::VARCHAR LIKE '%1%' QUALIFY rank <= {3 * TOP})
  SELECT doc_id, round(sum(1.0 / (60 + CAST(rank AS DOUBLE))), 10) AS score FROM lists GROUP BY doc_id, chunk_index ORDER BY score DESC, doc_id LIMIT {TOP}"""
)
def store_search_hybrid(spark, d):
    """Both lists, each of files whose path fits a pattern alone, fused: all chunks with the words, and the nearest 3 * TOP; ties by document."""
    asked = _table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]
    store = _with_vectors(spark, d, "hybrid")
    found = store.search_hybrid("rights nicht", list(asked), TOP, options=SearchOptions(file_pattern="*1*.md"), whole=True, ties=[_id(), "chunk_index"])
    return found.select(_id(), F.round("score", 10).alias("score"))


@query("""WITH known AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S'))
  SELECT k.doc_id, e.embedding[1]::DOUBLE * CASE WHEN e.label % 2 = 1 THEN -1 ELSE 1 END AS first_value FROM known k JOIN embeddings e ON e.vec_id = k.doc_id LEFT JOIN labels l ON l.doc_id = k.doc_id
  WHERE NOT coalesce(l.quality = 0, false) AND NOT coalesce(l.toxic = 1, false)""")
def store_vectors(spark, d):
    """Vectors stored, some replaced, some for chunks that don't exist; then files that change or go lose theirs."""
    store = _with_vectors(spark, d, "vectors")
    vectors = _table(spark, d, "embeddings").filter("label % 2 = 1").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    newer = _first_chunks(store).join(vectors, "doc_id").select("chunk_id", "embedding")
    store.store_embeddings(newer.union(vectors.select(-F.col("doc_id") - 1, "embedding")))
    labels = _table(spark, d, "labels")
    docs = _table(spark, d, "documents").filter("text is not null")
    changed = _labelled(docs, labels.filter("toxic = 1 and quality <> 0 or toxic = 1 and quality is null")).withColumn("text", F.concat(F.lit("new "), "text"))
    gone = _labelled(docs, labels.filter("quality = 0"))
    store.replace_files(_files(changed), _files(gone).select("file_path"), indexed_at=1)
    return store.embeddings().join(_first_chunks(store), "chunk_id").select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


class _Picky(EmbeddingProvider):
    """The offline provider, which fails on texts with a word."""

    def __init__(self, word: str):
        self.inner, self.word = HashingEmbedder(64), word
        self.dimensions = self.inner.dimensions

    def embed(self, text: str) -> list[float]:
        if self.word in text:
            raise ValueError(f"can't embed {self.word}")
        return self.inner.embed(text)


@query(f"WITH {_CHUNKS} SELECT count(*) FILTER (NOT contains(content, 'rights')) AS succeeded, count(*) FILTER (contains(content, 'rights')) AS failed, count(*) FILTER (NOT contains(content, 'rights')) AS embedded, count(*) AS total, count(*) FILTER (contains(content, 'rights')) AS missing FROM c")
def store_embed(spark, d):
    """All chunks embedded by a provider that fails on some, which keep no other from its vector."""
    store = _indexed(spark, d, "embed")
    succeeded, failed = store.embed(_Picky("rights"))
    embedded, total = store.embedding_stats()
    numbers = store.missing_embeddings().agg(F.count("*").alias("missing"))
    return numbers.select(*(F.lit(n).cast("long").alias(k) for k, n in (("succeeded", succeeded), ("failed", failed), ("embedded", embedded), ("total", total))), "missing")


@query(_chunk_sql("CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'new ' || text ELSE text END", "md5(content) AS content_md5"))
def upsert_texts(spark, d):
    """All texts as files, then those of toxic documents replaced: the chunks of the store."""
    store = _indexed(spark, d, "texts")
    docs = _labelled(_table(spark, d, "documents").filter("text is not null"), _table(spark, d, "labels").filter("toxic = 1"))
    store.replace_files(_files(docs.withColumn("text", F.concat(F.lit("new "), "text"))), indexed_at=1)
    chunks = store.chunks().select("file_id", "chunk_index", "start_line", "end_line", F.md5("content").alias("content_md5"))  # texts don't move
    return store.files().join(chunks, "file_id").select(_id(), "chunk_index", "start_line", "end_line", "content_md5")


def _write_items(spark, d, folder: str) -> list[tuple[int, str]]:
    """The benchmark passages (a bounded table) as files, and files that no index takes."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    for i, text in items:
        _put(spark, f"{folder}/{'sub/' if i % 2 else ''}{i}.md", text, 1_000_000 + i)
    for name in ("Templates/1.md", "2.txt", "x.sync-conflict-3.md"):
        _put(spark, f"{folder}/{name}", "not indexed", 1_000_000)
    return items


_ITEM_CHUNKS = "SELECT item_id AS doc_id, 1000000 + item_id + {more} AS mtime, md5({text}) AS content_md5 FROM benchmark"


@query(_ITEM_CHUNKS.format(more="0", text="text"))
def index_tree(spark, d):
    """A tree of files listed, read and indexed, templates, conflicts and other names left out."""
    store = _store(spark, "tree")
    folder = f"{store.root}-files"
    _write_items(spark, d, folder)
    store.index_full([folder]).collect()
    return store.files().join(store.chunks(), "file_id").select(_id(), "mtime", F.md5("content").alias("content_md5"))


@query("SELECT item_id AS doc_id, 1000000 + item_id + CASE WHEN item_id % 3 = 0 THEN 5000 ELSE 0 END AS mtime, md5(CASE WHEN item_id % 3 = 0 THEN 'new ' || text ELSE text END) AS content_md5, true AS embedded FROM benchmark")
def watch_files(spark, d):
    """The watcher's step, twice, with embedding: every third file is rewritten in place between the two."""
    store = _store(spark, "watched")
    folder = f"{store.root}-files"
    items = _write_items(spark, d, folder)
    skip = ["Templates/", ".sync-conflict"]
    index_changes(store, [folder], skip, HashingEmbedder(64))
    for i, text in items:
        if i % 3 == 0:
            _put(spark, f"{folder}/{'sub/' if i % 2 else ''}{i}.md", f"new {text}", 1_005_000 + i)
    index_changes(store, [folder], skip, HashingEmbedder(64))
    rows = store.files().join(store.chunks(), "file_id").join(store.embeddings().select("chunk_id", F.lit(True).alias("embedded")), "chunk_id", "left")
    return rows.select(_id(), "mtime", F.md5("content").alias("content_md5"), F.coalesce("embedded", F.lit(False)).alias("embedded"))


class _Scores(RerankProvider):
    """Answers in a fixed way, or fails."""

    def __init__(self, answer):
        self.answer = answer

    def scores(self, query: str, contents: list[str]) -> list[float]:
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer(contents)


@query(f"""WITH q AS (SELECT 'the' AS t), {_SCORED}, n AS (SELECT least(count(*), 20) AS n FROM scored)
  SELECT v.mode, CAST(least(n, 5) AS INTEGER) AS n, v.same FROM n CROSS JOIN (VALUES ('failing', true), ('too few', true), ('none valid', true), ('reversed', false), ('hybrid without vectors', true)) v (mode, same)""")
def rerank_fallbacks(spark, d):
    """Searches with reranking over 20 candidates: whatever the provider does wrong, the old order stays (one row a case)."""
    from scrollmine.operators.rerank import rerank

    store = _indexed(spark, d, "rerank")
    engine = Engine(Config(), spark, store.root, HashingEmbedder(64))
    plain = engine.search("the", 20, rerank_results=False)
    wrong = {"failing": ValueError("no answer"), "too few": lambda c: [1.0] * (len(c) - 1), "none valid": lambda c: [-1.0] * len(c), "reversed": lambda c: [float(i) for i in range(len(c))]}
    where = lambda rows: [(r["file_path"], r["start_line"]) for r in rows]
    out = []
    for mode, answer in wrong.items():
        got = rerank("the", plain, _Scores(answer), 5, 20)
        out.append((mode, len(got), where(got) == where(plain[:5])))
    got = engine.search("the", 5, hybrid=True, rerank_results=False)
    out.append(("hybrid without vectors", len(got), where(got) == where(plain[:5])))
    return spark.createDataFrame(out, "mode string, n int, same boolean")


@query(f"""WITH q AS (SELECT unnest(['the', 'of']) AS t), {_SCORED} SELECT doc_id, start_line, end_line, '"score":' AS key, octet_length(encode(content)) AS n_bytes FROM scored JOIN c USING (doc_id, chunk_index)""")
def search_json(spark, d):
    """All results of a keyword search as the JSON of the command line, read back; in pages, as a text has its bounds."""
    found = _indexed(spark, d, "json").search_keyword("the of", None)
    ranked = found.withColumn("rank", F.monotonically_increasing_id()).withColumn("query_id", F.floor(F.col("rank") / PAGE))
    parsed = F.from_json("json", "results array<struct<file:string,lines:string,score:double,snippet:string>>")["results"]
    rows = formats.json_rows(ranked).select(F.explode(parsed).alias("r"))
    lines = F.split("r.lines", "-")
    return rows.select(_id("r.file"), F.get(lines, F.lit(0)).cast("int").alias("start_line"), F.get(lines, F.lit(1)).cast("int").alias("end_line"), F.lit('"score":').alias("key"), F.octet_length("r.snippet").cast("long").alias("n_bytes"))
