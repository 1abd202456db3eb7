"""The engine's operators as queries over the driver's tables, with the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollmine.functions.paths import excluded, file_date, like_of_glob, memory_type
from scrollmine.functions.text import tokens
from scrollmine.functions.vectors import decoded, l2_distance
from scrollmine.operators import bm25
from scrollmine.operators.chunking import MAX_BYTES, OVERLAP_BYTES, chunk_documents
from scrollmine.operators.filters import SearchOptions
from scrollmine.operators.fusion import OVERFETCH, RRF_K, rrf
from scrollmine.operators.postings import build_postings, corpus_stats, doc_lengths, term_stats
from scrollmine.operators.rerank import apply_scores, batch_prompts, parse_scores_column
from scrollmine.operators.vector import knn, knn_batch
from scrollmine.plans.formats import compact_rows, json_rows
from scrollmine.sources.files import changed_files, gone_files
from scrollmine.sources.providers import hashed_vectors
from scrollmine.streaming.watch import debounce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOP = 10


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, dealt over the session's tasks where its file is a single split (round-robin: no key, no skew)."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, d, "documents")
    return build_postings(docs, "doc_id", "text"), doc_lengths(docs, "doc_id", "text")


# --- text index ----------------------------------------------------------------------------------------------------

_TOKENS = "tok AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+')) AS term, generate_subscripts(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+'), 1) - 1 AS pos FROM documents)"
_LENGTHS = "len AS (SELECT d.doc_id, len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+')) AS dl FROM documents d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len)"
_WEIGHT = "greatest(1e-6, ln((st.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"


@query(f"WITH {_TOKENS}, per AS (SELECT term, doc_id, count(*) AS n FROM tok GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM per GROUP BY term")
def tokenize_terms(spark, d):
    return term_stats(_index(spark, d)[0])


@query(f"WITH {_LENGTHS} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_length, CAST(sum(dl) AS BIGINT) AS n_tokens FROM len")
def corpus_statistics(spark, d):
    return corpus_stats(doc_lengths(_table(spark, d, "documents"), "doc_id", "text")).withColumn("avg_length", F.round("avg_length", 6))


def _match_sql(tf: str, condition: str, count: int, limit: int | None = TOP, restricted: str | None = None) -> str:
    """SQL for a match query: tf gives (doc_id, phrase, tf) with phrases 0 to count - 1, condition is over columns f0, f1, ...; restricted replaces tf for the score."""
    columns = ", ".join(f"max(CASE WHEN phrase = {k} THEN tf ELSE 0 END) AS f{k}" for k in range(count))
    return f"""WITH {_TOKENS}, {_LENGTHS}, tf AS ({tf}), dfs AS (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase),
      own AS ({restricted or 'SELECT * FROM tf'}), wide AS (SELECT doc_id, {columns} FROM own GROUP BY doc_id),
      kept AS (SELECT doc_id FROM wide WHERE {condition}),
      scored AS (SELECT own.doc_id, sum({_WEIGHT}) AS score FROM own JOIN kept USING (doc_id) JOIN dfs USING (phrase) JOIN len ON len.doc_id = own.doc_id CROSS JOIN st GROUP BY own.doc_id)
      SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM scored
      QUALIFY rank <= {limit or 10**9}"""


def _matched(spark, d, text, k=TOP):
    postings, lengths = _index(spark, d)
    top = bm25.match_top(text, postings, lengths, k)
    return top.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _term_tf(*terms: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {k} AS phrase, count(*) AS tf FROM tok WHERE {t} GROUP BY doc_id" for k, t in enumerate(terms))


@query(_match_sql(_term_tf("term = 'onlyhe'"), "f0 > 0", 1))
def bm25_topk(spark, d):
    return _matched(spark, d, "onlyhe")


@query(_match_sql(_term_tf("term = 'the'", "term = 'the'", "term = 'nicht'"), "f0 > 0 AND f2 > 0", 3))
def bm25_repeated_and_common_terms(spark, d):
    return _matched(spark, d, "the The nicht")


@query(_match_sql(_term_tf("term = 'rights'", "term = 'nicht'"), "f0 > 0 OR f1 > 0", 2))
def match_or(spark, d):
    return _matched(spark, d, "rights OR nicht")


@query(_match_sql(_term_tf("term = 'the'"), "f0 > 0 AND doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'rights')", 1))
def match_not(spark, d):
    return _matched(spark, d, "the NOT rights")


@query(_match_sql(_term_tf("term = 'the'", "term = 'of'", "term = 'rights'"), "f0 > 0 AND (f1 > 0 OR f2 > 0)", 3))
def match_group(spark, d):
    return _matched(spark, d, "the AND (of OR rights)")


_PHRASE = "SELECT a.doc_id, {k} AS phrase, count(*) AS tf FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = '{a}' AND b.term = '{b}' GROUP BY a.doc_id"


@query(_match_sql(_PHRASE.format(k=0, a="all", b="rights"), "f0 > 0", 1))
def match_phrase(spark, d):
    return _matched(spark, d, '"All rights"')


@query(_match_sql(_term_tf("starts_with(term, 'right')"), "f0 > 0", 1))
def match_prefix(spark, d):
    return _matched(spark, d, "right*")


@query(_match_sql(_term_tf("term = 'the' AND pos = 0"), "f0 > 0", 1))
def match_initial(spark, d):
    return _matched(spark, d, "^the")


@query(
    _match_sql(
        _term_tf("term = 'rights'", "term = 'reserved'"),
        "f0 > 0 AND f1 > 0",
        2,
        restricted="""SELECT a.doc_id, 0 AS phrase, count(DISTINCT a.pos) AS tf FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) - 1 <= 3 WHERE a.term = 'rights' AND b.term = 'reserved' GROUP BY a.doc_id
          UNION ALL SELECT b.doc_id, 1, count(DISTINCT b.pos) FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) - 1 <= 3 WHERE a.term = 'rights' AND b.term = 'reserved' GROUP BY b.doc_id""",
    )
)
def match_near(spark, d):
    return _matched(spark, d, "NEAR(rights reserved, 3)")


_BATCH = f"""WITH {_TOKENS}, {_LENGTHS},
  q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS term FROM benchmark) GROUP BY 1, 2),
  need AS (SELECT item_id, count(*) AS n_terms FROM q GROUP BY 1),
  tf AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  hits AS (SELECT q.item_id AS query_id, tf.doc_id, sum(times * {_WEIGHT}) AS score, count(*) AS found FROM q JOIN tf USING (term) JOIN dfs USING (term) JOIN len ON len.doc_id = tf.doc_id CROSS JOIN st GROUP BY 1, 2),
  words AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits JOIN need ON item_id = query_id WHERE found = n_terms)"""


def _asked(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


@query(_BATCH + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM words WHERE rank <= 5")
def bm25_batch_topk(spark, d):
    best = bm25.batch_top(_asked(spark, d), *_index(spark, d), 5)
    return best.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(_match_sql(_term_tf("term = 'the'"), "f0 > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang >= 'en' AND source ILIKE '%SRC1%' AND source LIKE '%1%')", 1))
def bm25_filtered(spark, d):
    options = SearchOptions(after="en", project="SRC1", file_pattern="*1*")
    meta = _table(spark, d, "documents").filter(options.condition("lang", "source", "source")).select(F.col("doc_id").alias("chunk_id"))
    scored = bm25.match_scores("the", *_index(spark, d)).join(meta, "chunk_id", "left_semi")
    return bm25.top(scored, TOP).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


# --- chunks and paths ----------------------------------------------------------------------------------------------


def _chunk_sql(text: str, columns: str) -> str:
    return f"""WITH RECURSIVE src AS (SELECT doc_id, {text} AS body FROM documents WHERE text IS NOT NULL),
  ls AS (SELECT doc_id, string_split(CASE WHEN ends_with(body, chr(10)) THEN left(body, length(body) - 1) ELSE body END, chr(10)) AS l FROM src),
  pre AS (SELECT doc_id, l, list_transform(range(len(l) + 1), lambda k: coalesce(list_sum(list_transform(l[1:k], lambda x: octet_length(encode(x)) + 1)), 0)) AS p FROM ls),
  step AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM pre
    UNION ALL
    SELECT doc_id, i + 1,
      CASE WHEN starts_with(l[i + 1], '## ') THEN i WHEN p[i + 2] - p[start + 1] - 1 > {MAX_BYTES} THEN coalesce(list_max(list_filter(range(start, i), lambda x: p[i + 1] - p[x + 1] >= {OVERLAP_BYTES})), start) ELSE start END,
      CASE WHEN starts_with(l[i + 1], '## ') OR p[i + 2] - p[start + 1] - 1 > {MAX_BYTES} THEN start END,
      CASE WHEN starts_with(l[i + 1], '## ') OR p[i + 2] - p[start + 1] - 1 > {MAX_BYTES} THEN i END
    FROM step JOIN pre USING (doc_id) WHERE i < len(l)),
  ranges AS (SELECT doc_id, s, e FROM step WHERE s IS NOT NULL AND e > s UNION ALL SELECT doc_id, start, i FROM step JOIN pre USING (doc_id) WHERE i = len(l)),
  texts AS (SELECT doc_id, s, e, l, array_to_string(l[s + 1:e], chr(10)) AS content FROM ranges JOIN pre USING (doc_id)),
  kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS INTEGER) AS chunk_index FROM texts WHERE regexp_matches(content, '\\S'))
  SELECT doc_id, chunk_index, CAST(s + 1 AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, {columns} FROM kept"""


def _as_files(docs: DataFrame, text="text") -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col(text).alias("content"))


@query(_chunk_sql("text", "CAST(octet_length(encode(content)) AS INTEGER) AS n_bytes, md5(content) AS content_md5"))
def chunk_markdown(spark, d):
    chunks = chunk_documents(_as_files(_table(spark, d, "documents")))
    return chunks.select("doc_id", "chunk_index", "start_line", "end_line", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("content_md5"))


_HEADED = "regexp_replace(text, '\\n([AEIOT])', chr(10) || '## \\1', 'g')"


@query(_chunk_sql(_HEADED, "CAST(octet_length(encode(content)) AS INTEGER) AS n_bytes, trim(substr(l[1 + list_max(list_filter(range(0, s + 1), lambda k: starts_with(l[k + 1], '## ')))], 4)) AS section"))
def chunk_sections(spark, d):
    docs = _table(spark, d, "documents").withColumn("text", F.regexp_replace("text", "\\n([AEIOT])", "\n## $1"))
    return chunk_documents(_as_files(docs)).select("doc_id", "chunk_index", "start_line", "end_line", F.octet_length("content").alias("n_bytes"), "section")


_PATHS = [
    "/v/ARIA/Skills/x.md", "/v/aria/skills/memory.md", "/v/aria/MEMORY.md", "/v/other/memory.md", "/v/other/user.md", "/v/soul.md", "/v/aria/issues.md", "/v/Daily Notes/2024-01-02.md",
    "/v/periodic/daily/2024-01-02-x.md", "/v/aria/messages/m.md", "/v/aria/contacts/c.md", "/v/abcd-ef-gh.md", "/v/2024-05-06", "/v/Templates/2024-05-06.md", "/v/a.sync-conflict-1.md", "/v/attachments/q/r.md",
]
_PATH_SQL = f"SELECT doc_id, ([{', '.join(repr(p) for p in _PATHS)}])[1 + doc_id % {len(_PATHS)}] AS file_path FROM documents"


def _paths(spark, d):
    names = F.array(*(F.lit(p) for p in _PATHS))
    return _table(spark, d, "documents").select("doc_id", F.get(names, (F.col("doc_id") % len(_PATHS)).cast("int")).alias("file_path"))


@query(f"""WITH p AS ({_PATH_SQL}), l AS (SELECT *, lower(file_path) AS x, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM p)
  SELECT doc_id, file_path, CASE WHEN contains(x, '/aria/skills/') THEN 'skill' WHEN ends_with(x, '/memory.md') AND contains(x, '/aria/') THEN 'semantic' WHEN ends_with(x, '/soul.md') OR ends_with(x, '/user.md') THEN 'semantic'
    WHEN ends_with(x, '/issues.md') AND contains(x, '/aria/') THEN 'procedural' WHEN contains(x, '/daily notes/') OR contains(x, '/periodic/daily/') THEN 'episodic' WHEN contains(x, '/aria/messages/') THEN 'episodic'
    WHEN contains(x, '/aria/contacts/') THEN 'semantic' END AS memory_type,
    CASE WHEN octet_length(encode(stem)) = 10 AND substr(stem, 5, 1) = '-' AND substr(stem, 8, 1) = '-' THEN stem END AS date FROM l""")  # fmt: skip
def path_metadata(spark, d):
    return _paths(spark, d).select("doc_id", "file_path", memory_type("file_path").alias("memory_type"), file_date("file_path").alias("date"))


@query(f"""WITH p AS ({_PATH_SQL}) SELECT doc_id, contains(file_path, '/Templates/') OR contains(file_path, '/attachments/') OR regexp_matches(file_path, '\\.sync-conflict-[^/]*$') AS excluded, file_path LIKE '%/v/%_m%' AS liked FROM p""")
def path_filters(spark, d):
    globs = ["**/Templates/**", "**/.obsidian/**", "**/attachments/**", "**/*.sync-conflict-*"]
    return _paths(spark, d).select("doc_id", excluded("file_path", globs).alias("excluded"), F.col("file_path").like(like_of_glob("*/v/*?m*")).alias("liked"))


# --- vectors and fusion --------------------------------------------------------------------------------------------

_DISTANCE = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))"


@query(f"""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {_DISTANCE.format(a='embedding', b='v')} AS x FROM embeddings CROSS JOIN q)
  SELECT vec_id, round(x, 6) AS distance, CAST(row_number() OVER (ORDER BY x, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= {TOP}""")
def knn_topk(spark, d):
    vectors = _table(spark, d, "embeddings")
    asked = vectors.filter("vec_id = 0").first()["embedding"]
    return knn(vectors, list(asked), TOP, "vec_id").select(F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, {_DISTANCE.format(a='embedding', b='v')} AS x FROM embeddings CROSS JOIN q)
  SELECT query_id, vec_id, round(x, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= {TOP}""")
def knn_batch_topk(spark, d):
    vectors = _table(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return knn_batch(vectors, asked, TOP, "vec_id").select("query_id", F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


_HYBRID = f""", qv AS (SELECT item_id AS query_id, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
  near AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {_DISTANCE.format(a='embedding', b='v')}, vec_id) AS rank FROM embeddings CROSS JOIN qv),
  lists AS (SELECT query_id, doc_id, rank FROM words WHERE rank <= {5 * OVERFETCH} UNION ALL SELECT query_id, doc_id, rank FROM near WHERE rank <= {5 * OVERFETCH}),
  fused AS (SELECT query_id, doc_id, sum(1.0 / ({RRF_K} + CAST(rank AS DOUBLE))) AS score FROM lists GROUP BY 1, 2)
  SELECT query_id, doc_id, round(score, 10) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fused QUALIFY rank <= 5"""


@query(_BATCH + _HYBRID)
def hybrid_search(spark, d):
    words = bm25.batch_top(_asked(spark, d), *_index(spark, d), 5 * OVERFETCH)
    vectors = _table(spark, d, "embeddings")
    asked = vectors.join(_asked(spark, d), F.col("vec_id") == F.col("query_id")).select("query_id", "embedding")
    fused = rrf([words, knn_batch(vectors, asked, 5 * OVERFETCH, "vec_id")], 5)
    return fused.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 10).alias("score"), "rank")


_LISTED = "a AS (SELECT doc_id % 7 AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT vec_id % 7 AS query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY label, vec_id) AS rank FROM embeddings)"


@query(f"""WITH {_LISTED}, f AS (SELECT query_id, chunk_id, sum(1.0 / ({RRF_K} + CAST(rank AS DOUBLE))) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
  SELECT query_id, chunk_id, round(score, 10) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= {TOP}""")
def rrf_fuse(spark, d):
    ranked = lambda df, i, *order: df.select((F.col(i) % 7).alias("query_id"), F.col(i).alias("chunk_id"), F.row_number().over(Window.partitionBy(F.col(i) % 7).orderBy(*order)).alias("rank"))
    a = ranked(_table(spark, d, "documents"), "doc_id", F.desc("n_chars"), "doc_id")
    b = ranked(_table(spark, d, "embeddings"), "vec_id", "label", "vec_id")
    return rrf([a, b], TOP).withColumn("score", F.round("score", 10))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def missing_embeddings(spark, d):
    return _table(spark, d, "documents").select("doc_id").join(_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_embeddings(spark, d):
    return _table(spark, d, "embeddings").select("vec_id").join(_table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+')) AS term FROM documents),
  c AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM t GROUP BY 1, 2), norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
  SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(CAST(n / norm AS FLOAT) AS DOUBLE), 5) AS value FROM c JOIN norms USING (doc_id)""")
def hashed_embeddings(spark, d):
    vectors = hashed_vectors(_table(spark, d, "documents"), "doc_id", "text", 64)
    return vectors.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "v")).filter("v > 0").select("doc_id", "bucket", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("SELECT vec_id, len(embedding) AS n, 0.0::DOUBLE AS difference FROM embeddings")
def legacy_vectors(spark, d):
    """Vectors to little-endian bytes and back."""
    vectors = _table(spark, d, "embeddings")

    def pack(it):
        import pandas as pd

        from scrollmine.functions.vectors import to_bytes

        for pdf in it:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "blob": pdf["embedding"].map(to_bytes)})

    n = len(vectors.first()["embedding"])
    rows = vectors.select("vec_id", "embedding").mapInPandas(pack, "vec_id long, embedding array<float>, blob binary").withColumn("v", decoded("blob", n))
    return rows.select("vec_id", F.size("v").cast("long").alias("n"), l2_distance("embedding", "v").alias("difference"))


# --- files and status ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, n_chars AS mtime FROM documents d LEFT JOIN (SELECT doc_id AS id, n_chars - (CASE WHEN quality = 0 THEN 5 ELSE 0 END) AS stored FROM documents JOIN labels USING (doc_id)) s ON d.doc_id = s.id WHERE stored IS NULL OR stored < n_chars")
def change_detection(spark, d):
    listing = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("n_chars").alias("mtime"))
    stored = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("file_path"), (F.col("n_chars") - F.when(F.col("quality") == 0, 5).otherwise(0)).alias("mtime"))
    return changed_files(listing, stored).select(F.col("file_path").cast("long").alias("doc_id"), "mtime")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gone_detection(spark, d):
    rows = lambda n: _table(spark, d, n).select(F.col("doc_id").cast("string").alias("file_path"))
    return gone_files(rows("labels"), rows("documents")).select(F.col("file_path").cast("long").alias("doc_id"))


_UPSERT = "SELECT d.doc_id, md5(CASE WHEN l.toxic = 1 THEN upper(d.source) WHEN l.quality = 0 THEN NULL ELSE d.source END) AS content_md5 FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 0 AND l.quality = 0, false)"


def _store(spark: SparkSession, label: str, dimensions: int = 64, buckets: int = 4):
    """A store in the folder that driver and executors share."""
    import re
    import tempfile
    import uuid

    from scrollmine.plans.store import Store

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scrollmine-")  # everything runs in one process (tests)
    return Store(spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}", dimensions, buckets)


@query(_UPSERT)
def upsert_files(spark, d):
    """All documents' sources as files; then those of toxic documents replaced, and those of other bad ones dropped."""
    store = _store(spark, "upsert")
    docs, labels = _table(spark, d, "documents"), _table(spark, d, "labels")
    path = F.col("doc_id").cast("string").alias("file_path")
    store.replace_files(docs.select(path, F.lit(1).cast("long").alias("mtime"), F.col("source").alias("content")), indexed_at=0)
    newer = docs.join(labels.filter("toxic = 1"), "doc_id").select(path, F.lit(2).cast("long").alias("mtime"), F.upper("source").alias("content"))
    store.replace_files(newer, labels.filter("toxic = 0 AND quality = 0").select(path), indexed_at=1)
    rows = store.files().join(store.chunks(), "file_id")
    return rows.select(F.col("file_path").cast("long").alias("doc_id"), F.md5("content").alias("content_md5"))


@query(
    _chunk_sql("text", "content").replace("SELECT doc_id, chunk_index, CAST(s + 1 AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, content FROM kept", "SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS file_count, count(*) AS chunk_count, '1970-01-02 03:46:40' AS last_indexed, CAST(sum(len(regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}\\p{Co}]+'))) AS BIGINT) AS n_tokens FROM kept")
)
def index_status(spark, d):
    """The documents indexed as files: the store's own numbers."""
    store = _store(spark, "status")
    docs = _table(spark, d, "documents")
    store.replace_files(_as_files(docs).select("file_path", F.lit(1).cast("long").alias("mtime"), "content"), indexed_at=100_000, everything=True)
    s = store.stats()
    total = store.lengths().agg(F.sum("length").alias("n_tokens"))
    return total.select(F.lit(s.file_count).cast("long").alias("file_count"), F.lit(s.chunk_count).cast("long").alias("chunk_count"), F.lit(s.last_indexed).alias("last_indexed"), "n_tokens")


@query("SELECT count(e.vec_id) AS embedded, count(*) AS total, round(CASE WHEN count(*) > 0 THEN 100.0 * count(e.vec_id) / count(*) ELSE 0 END, 1) AS coverage FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_coverage(spark, d):
    joined = _table(spark, d, "documents").join(_table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    counts = joined.agg(F.count("vec_id").alias("embedded"), F.count("*").alias("total"))
    return counts.withColumn("coverage", F.round(F.when(F.col("total") > 0, 100.0 * F.col("embedded") / F.col("total")).otherwise(0.0), 1))


# --- results and reranking -----------------------------------------------------------------------------------------


def _ranked(spark, d):
    """The batch search's results with the columns of result rows."""
    best = bm25.batch_top(_asked(spark, d), *_index(spark, d), 5)
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"), F.lit(1).cast("long").alias("start_line"), F.col("n_chars").alias("end_line"), F.col("text").alias("content"), F.lit(None).cast("string").alias("date"), F.col("lang").alias("section"), F.lit(None).cast("string").alias("memory_type"))
    return best.join(docs, "chunk_id")


@query(_BATCH + """ SELECT query_id, words.doc_id, '[' || rank || '] ' || source || ':1-' || n_chars || ' (score: ' || printf('%.2f', score) || ')' AS header,
  trim(left(text, 200), ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN octet_length(encode(text)) > 200 THEN '...' ELSE '' END AS snippet FROM words JOIN documents d ON d.doc_id = words.doc_id WHERE rank <= 5""")
def snippet_compact(spark, d):
    return compact_rows(_ranked(spark, d)).select("query_id", F.col("chunk_id").alias("doc_id"), "header", "snippet")


@query(_BATCH + """ SELECT query_id, CAST(count(*) AS INTEGER) AS n, string_agg(source || ' 1-' || n_chars || ' ' || lang || ' ' || md5(text), ',' ORDER BY rank) AS parts FROM words JOIN documents d ON d.doc_id = words.doc_id WHERE rank <= 5 GROUP BY query_id""")
def result_json(spark, d):
    """Results to JSON, and the fields back from it."""
    parsed = F.from_json("json", "results array<struct<file:string,lines:string,score:double,snippet:string,date:string,section:string,memory_type:string>>")
    rows = json_rows(_ranked(spark, d)).withColumn("r", parsed["results"])
    part = F.transform("r", lambda x: F.concat_ws(" ", x["file"], x["lines"], x["section"], F.md5(x["snippet"])))
    return rows.select("query_id", F.size("r").alias("n"), F.array_join(part, ",").alias("parts"))


_ANSWERS = ["7,3,9,1,5", "  7 , 3 , 9 , 1 , 5  ", "7,3,9", "", "7,three,9,1,5", "15,-3,9,1,5", "1e1,0.5,2,3,4"]


@query(f"""WITH a AS (SELECT doc_id, trim(([{', '.join(repr(x) for x in _ANSWERS)}])[1 + doc_id % {len(_ANSWERS)}]) AS t FROM documents), p AS (SELECT doc_id, t, list_transform(string_split(t, ','), lambda x: trim(x)) AS parts FROM a)
  SELECT doc_id, CASE WHEN t <> '' AND len(parts) = 5 AND len(list_filter(parts, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0 THEN list_sum(list_transform(parts, lambda x: least(10.0, greatest(0.0, CAST(x AS DOUBLE))))) END AS total,
    CASE WHEN t = '' THEN 'empty' WHEN len(parts) <> 5 THEN 'count' WHEN len(list_filter(parts, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) > 0 THEN 'number' END AS problem FROM p""")
def parse_scores(spark, d):
    answers = F.array(*(F.lit(x) for x in _ANSWERS))
    rows = _table(spark, d, "documents").select("doc_id", F.get(answers, (F.col("doc_id") % len(_ANSWERS)).cast("int")).alias("t")).withColumn("p", parse_scores_column("t", F.lit(5)))
    problem = F.when(F.col("p.error").contains("empty"), "empty").when(F.col("p.error").contains("Expected"), "count").when(F.col("p.error").isNotNull(), "number")
    return rows.select("doc_id", F.aggregate("p.scores", F.lit(0.0), lambda s, x: s + x).alias("total"), problem.alias("problem"))


_CANDIDATES = "c AS (SELECT source AS query_id, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 20)"


def _candidates(spark, d):
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = _table(spark, d, "documents").withColumn("rank", F.row_number().over(order)).filter("rank <= 20")
    return rows.select(F.col("source").alias("query_id"), F.concat(F.lit("find "), "source").alias("query"), "doc_id", "rank", F.lit(0.0).alias("score"), F.col("text").alias("content"))


@query(f"""WITH {_CANDIDATES}, n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
  s AS (SELECT c.query_id, doc_id, rank, CASE WHEN length(c.query_id) = 4 THEN CAST((doc_id * 7) % 11 AS DOUBLE) END AS new FROM c)
  SELECT query_id, doc_id, coalesce(new, 0.0) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY new DESC NULLS LAST, rank) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY new DESC NULLS LAST, rank) <= 5""")
def rerank_apply(spark, d):
    """Scores for the sources with short names; the others get one score too few and keep their order."""
    rows = _candidates(spark, d)
    given = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", ((F.col("doc_id") * 7) % 11).cast("double").alias("s")))).alias("x"))
    scores = F.transform("x", lambda r: r["s"])
    given = given.select("query_id", F.when(F.length("query_id") == 4, scores).otherwise(F.slice(scores, 2, 20)).alias("scores"))
    return apply_scores(rows, given, 5).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {_CANDIDATES} SELECT query_id, CAST(count(*) AS INTEGER) AS n, md5('Score how relevant each document is to the query, from 0 to 10. Answer with exactly ' || count(*) || ' scores, separated by commas, and nothing else.' || chr(10) || chr(10)
  || 'Query: find ' || query_id || chr(10) || chr(10) || string_agg('Document ' || rank || ': ' || left(text, 500), chr(10) || chr(10) ORDER BY rank)) AS prompt_md5 FROM c JOIN documents USING (doc_id) GROUP BY query_id""")
def rerank_prompt(spark, d):
    return batch_prompts(_candidates(spark, d)).select("query_id", "n", F.md5("prompt").alias("prompt_md5"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 45 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, d):
    return debounce(_table(spark, d, "events"), "45 minutes", ["user_id"])


def _put(spark: SparkSession, path: str, text: str, seconds: int) -> None:
    """Write a file, with its time, by Spark's file systems."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(hadoop_path, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.setTimes(hadoop_path, seconds * 1000, -1)


@query()
def watch_index(spark, d):
    """A folder written, watched by the stream, rewritten in place, watched again: the index follows (one row a file)."""
    from scrollmine.streaming.watch import index_changes

    store = _store(spark, "watch")
    folder = f"{store.root}-files"
    for name, text in (("a.md", "alpha one"), ("_b.md", "beta two"), ("Templates/t.md", "skipped")):
        _put(spark, f"{folder}/{name}", text, 1_000_000)
    index_changes(store, [folder], ["Templates/"])
    _put(spark, f"{folder}/a.md", "alpha changed", 2_000_000)
    index_changes(store, [folder], ["Templates/"])
    rows = store.files().join(store.chunks(), "file_id")
    return rows.select(F.regexp_extract("file_path", "[^/]*$", 0).alias("name"), "content", F.size(tokens("content")).alias("n_tokens"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: hybrid search of all benchmark passages."""
    return hybrid_search(spark, d)


from scrollmine import store_queries  # noqa: E402,F401  registers its own
