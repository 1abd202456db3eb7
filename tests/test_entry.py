"""The driver's contract: names, columns that agree with the SQL, and an import without the optional subpackage."""

import glob
import os
import random
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from scrollmine.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FAST = ["corpus_statistics", "bm25_topk", "match_near", "chunk_markdown", "path_metadata", "knn_topk", "rrf_fuse", "parse_scores", "rerank_apply", "debounce_sessions"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, SF)
    result = c.execute(ORACLES[name])
    columns = sorted(x[0] for x in result.description)
    place = {x[0]: i for i, x in enumerate(result.description)}
    want = sorted(repr(tuple(r[place[n]] for n in columns)) for r in result.fetchall())
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r[n] for n in columns)) for r in df.collect()) == want


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    os.makedirs(tmp_path / "scrollmine")
    for name in os.listdir(f"{root}/scrollmine"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/scrollmine/{name}", tmp_path / "scrollmine" / name)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert 'pipeline' not in e.queries(); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_hybrid_search_of_the_store_equals_its_sql_in_order(spark, tmp_path):
    """The nearest stand far down among the words' matches, and there are equals in both lists, across them and within a document."""
    rng = random.Random(5)
    texts = ["rights nicht", "nicht rights rights", "rights", "## a\nnicht rights und\n## b\nnicht rights rights und hier", "nicht", "rights nicht und so weiter", "rights nicht und mehr und so weiter"]
    docs = [(i, rng.choice(texts)) for i in rng.sample(range(1500), 300)]
    near = {i for i, text in docs if text in texts[-2:]} | {0}
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.sql("create table embeddings (vec_id bigint, embedding float[], label int)")
    c.executemany("insert into documents values (?, ?, 'en', 's', 1)", docs)
    c.executemany("insert into embeddings values (?, ?, 0)", [(i, [i % 3 / 2 if i in near else 9.0] * 64) for i in range(1500)])
    for t in ("documents", "embeddings"):
        c.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = c.execute(ORACLES["store_search_hybrid"]).fetchall()
    assert any(1 / 61 < score < 2 / 90 for _, score in want)  # in both lists, and beyond the length of the near one among the words
    assert [tuple(r) for r in QUERIES["store_search_hybrid"](spark, str(tmp_path)).select("doc_id", "score").collect()] == want
