import math
import random
import sqlite3

import pytest

from scrollmine.operators import bm25, match
from scrollmine.operators.postings import build_postings, doc_lengths

TEXTS = {
    1: "alpha beta beta gamma", 2: "alpha delta", 3: "beta Beta café naïve epsilon zeta eta theta", 4: "user's pref snake_case foo-bar x1 2024-01-01", 5: "alpha alpha alpha alpha", 6: "lorem ipsum dolor",
}


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "chunk_id long, content string")
    return build_postings(df).cache(), doc_lengths(df).cache()


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(content)")
    c.executemany("insert into t(rowid, content) values (?, ?)", TEXTS.items())
    return c


QUERIES = [
    "beta", "alpha", "alpha beta", "beta beta", "cafe", "naive", "ALPHA", "alpha NOT beta", "alpha OR delta", "alp*", '"beta gamma"', "NEAR(alpha gamma, 2)", "NEAR(alpha gamma, 1)", "alpha+beta", "snake_case",
    "and", "(alpha OR lorem) AND beta", "alpha AND beta OR lorem", "lorem OR alpha NOT beta", "alpha NOT beta gamma", '"bet*', "^alpha", "^beta", "content:alpha", "{content}: beta", '"alpha be" *', "x1", "NEAR(beta eta)",
]
WRONG = ["user's", "what?", "a.b", "the, of", "(alpha", "", "alpha AND", "foo-bar", "2024-01-01", "file:x", "(alpha OR beta) gamma", "gamma (alpha OR beta)", "OR alpha", '"open', "alpha)"]


@pytest.mark.parametrize("query", QUERIES)
def test_ids_and_scores_equal_a_real_index(index, fts, query):
    try:
        want = dict(fts.execute("select rowid, -bm25(t) from t where t match ?", (query,)).fetchall())
    except sqlite3.OperationalError:
        with pytest.raises(match.MatchError):
            match.parse(query)
        return
    got = {r["chunk_id"]: r["score"] for r in bm25.match_scores(query, *index).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


@pytest.mark.parametrize("query", WRONG)
def test_errors(fts, query):
    with pytest.raises(match.MatchError):
        match.parse(query)
    with pytest.raises(sqlite3.OperationalError):
        fts.execute("select rowid from t where t match ?", (query,)).fetchall()


def test_safe_query_takes_anything(index):
    assert [r["chunk_id"] for r in bm25.match_scores(match.safe_query("the user's pref?").replace('"the" ', ""), *index).collect()] == [4]
    assert match.safe_query("?!") == ""
    assert match.parse('""') is None and bm25.match_scores('""', *index).collect() == []


def test_random_expressions(index, fts):
    rnd, words = random.Random(8), ["alpha", "beta", "gamma", "delta", "zeta", "lorem"]

    def expression(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice([*words, '"alpha beta"', "alp*"])
        return f"({expression(depth - 1)} {rnd.choice(['AND', 'OR', 'NOT'])} {expression(depth - 1)})"

    for _ in range(12):
        q = expression(2)
        want = {r[0] for r in fts.execute("select rowid from t where t match ?", (q,))}
        assert {r["chunk_id"] for r in bm25.match_scores(q, *index).collect()} == want, q


def test_batch_equals_single(spark, index):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta"), (3, "nothing here"), (4, "")], "query_id long, text string")
    got = {}
    for r in bm25.batch_top(asked, *index, 2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["score"], 9)))
    single = lambda q: [(r["rank"], r["chunk_id"], round(r["score"], 9)) for r in bm25.match_top(q, *index, 2).orderBy("rank").collect()]
    assert {k: sorted(v) for k, v in got.items()} == {1: single("alpha beta"), 2: single("beta beta")}
