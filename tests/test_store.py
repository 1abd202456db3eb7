import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrollmine.api import Engine
from scrollmine.cli import main
from scrollmine.config import Config, expand_home
from scrollmine.functions.vectors import to_bytes
from scrollmine.mcp import Server
from scrollmine.operators import postings
from scrollmine.operators import rerank as R
from scrollmine.operators.filters import SearchOptions
from scrollmine.operators.fusion import rrf
from scrollmine.operators.vector import knn, knn_batch
from scrollmine.plans import formats
from scrollmine.plans.store import Store
from scrollmine.sources import providers as P
from scrollmine.streaming.watch import index_changes, watch


def put(folder, files, at=1_600_000_000):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        os.utime(path, (at, at))


TREE = {
    "2024-01-02.md": "alpha beta\n## Plans\nalpha in plans", "sub/n.md": "gamma delta", "_under.md": "hidden beta", ".dot.md": "dotted alpha", "n.txt": "alpha", "Templates/t.md": "alpha",
    ".obsidian/o.md": "alpha", "attachments/a.md": "alpha", "x.sync-conflict-1.md": "alpha", "bad.md": b"\xff\xfe alpha",
}


@pytest.fixture
def tree(tmp_path):
    put(tmp_path / "v", TREE)
    return tmp_path / "v"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", dimensions=8, buckets=3)


def names(store):
    return sorted(os.path.basename(r["file_path"]) for r in store.files().collect())


def test_full_index_search_and_filters(spark, store, tree):
    failed = store.index_full([str(tree)]).collect()
    assert [os.path.basename(r["file_path"]) for r in failed] == ["bad.md"]
    assert names(store) == [".dot.md", "2024-01-02.md", "_under.md", "n.md"]
    rows = store.search_keyword("alpha", 5).collect()
    assert {os.path.basename(r["file_path"]) for r in rows} == {"2024-01-02.md", ".dot.md"} and all(r["score"] > 0 for r in rows)
    dated = store.search_keyword("alpha", 5, SearchOptions(after="2024-01-02")).collect()
    assert {r["date"] for r in dated} == {"2024-01-02"} and len(dated) == 2
    assert [r["section"] for r in store.search_keyword("alpha", 5, SearchOptions(project="PLAN")).collect()] == ["Plans"]
    assert len(store.search_keyword("beta", 5, SearchOptions(file_pattern="*.MD")).collect()) == 2
    s = store.stats()
    assert (s.file_count, s.chunk_count) == (4, 5) and s.last_indexed[:2] == "20"


def test_incremental_prune_and_vacuum(spark, store, tree):
    store.index_incremental([str(tree)])
    before = {r["chunk_id"] for r in store.chunks().collect()}
    put(tree, {"sub/n.md": "epsilon now"}, at=1_600_000_000)
    store.index_incremental([str(tree)])
    assert store.search_keyword("epsilon", 5).collect() == []  # the same second: not newer
    put(tree, {"sub/n.md": "epsilon now"}, at=1_600_000_001)
    os.remove(tree / "_under.md")
    store.index_incremental([str(tree)])
    assert len(store.search_keyword("epsilon", 5).collect()) == 1 and store.search_keyword("gamma", 5).collect() == []
    assert "_under.md" in names(store)
    store.index_incremental([str(tree)], prune=True)
    assert "_under.md" not in names(store) and store.search_keyword("hidden", 5).collect() == []
    assert len(before & {r["chunk_id"] for r in store.chunks().collect()}) >= 3
    assert store.vacuum() > 0 and len(store.search_keyword("epsilon", 5).collect()) == 1
    with pytest.raises(FileNotFoundError):
        store.index_file(str(tree / "none.md"))
    store.index_file(str(tree / "n.txt"))
    assert "n.txt" in names(store)


def test_vectors(spark, store, tree):
    store.index_full([str(tree)])
    embedder = P.HashingEmbedder(8)
    assert store.embed(embedder, limit=2) == (2, 0) and store.embedding_stats() == (2, 5)
    assert store.embed(embedder) == (3, 0) and store.missing_embeddings().count() == 0

    class Broken(P.HashingEmbedder):
        def embed(self, text):
            if "gamma" in text:
                raise RuntimeError("no")
            return super().embed(text)

    assert store.embed(Broken(8), everything=True) == (4, 1)
    found = store.search_hybrid("alpha", embedder.embed("alpha"), 3).collect()
    assert len(found) == 3 and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    put(tree, {"sub/n.md": "alpha again"}, at=1_700_000_000)
    store.index_incremental([str(tree)])
    assert store.embedding_stats() == (4, 5)
    ids = [r["chunk_id"] for r in store.missing_embeddings().collect()]
    legacy = spark.createDataFrame([(ids[0], bytearray(to_bytes([1.0] * 8))), (12345, bytearray(to_bytes([1.0] * 8))), (ids[0] + 1, bytearray(b"xx"))], "chunk_id long, embedding binary")
    store.migrate_blobs(legacy)
    assert store.embedding_stats() == (5, 5)
    with pytest.raises(ValueError):
        store.store_embeddings(spark.createDataFrame([(ids[0], [1.0])], "chunk_id long, embedding array<float>"))


def test_first_vectors_are_written_where_they_are_made(spark, store, tree, monkeypatch):
    """No join, cache or second copy of the vectors of a store that has none; what an update changes meanwhile is joined."""
    store.index_full([str(tree)])
    with monkeypatch.context() as m:
        m.setattr(store, "store_embeddings", lambda vectors: pytest.fail("vectors were joined"))
        m.setattr("pyspark.sql.DataFrame.persist", lambda *a: pytest.fail("vectors were cached"))
        assert store.embed(P.HashingEmbedder(8)) == (5, 0)
    assert store.embedding_stats() == (5, 5) and store.missing_embeddings().count() == 0
    with monkeypatch.context() as m:
        m.setattr("scrollmine.plans.store.hinted", lambda keys: pytest.fail("the join of vectors and texts was run to be counted"))
        assert store.missing_embeddings().count() == 0
    assert not os.listdir(f"{store.root.removeprefix('file://')}/staged")
    got = {r["chunk_id"]: r["embedding"] for r in store.embeddings().collect()}
    assert all(np.allclose(got[r["chunk_id"]], P.HashingEmbedder(8).embed(r["content"])) for r in store.chunks().collect())

    take = store._take

    def changed(*a):
        put(tree, {"sub/n.md": "alpha again"}, at=1_700_000_000)
        store.index_incremental([str(tree)])
        take(*a)

    monkeypatch.setattr(store, "_take", changed)
    assert store.embed(P.HashingEmbedder(8), everything=True) == (5, 0)
    assert store.embedding_stats() == (4, 5)
    with pytest.raises(ValueError):
        store.embed(P.HashingEmbedder(9))


def test_postings_of_few_texts_at_a_time_are_the_same(spark, monkeypatch):
    texts = ["alpha beta alpha", "", "beta gamma", "delta", "alpha delta beta beta", "...", "gamma gamma"]
    chunks = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "chunk_id long, bucket int, content string").coalesce(1)
    monkeypatch.setattr(postings, "_TEXTS", 3)
    got = postings.chunk_postings(chunks)
    key = lambda r: (r["term"], r["chunk_id"], tuple(r["positions"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, postings.build_postings(chunks).collect()))
    assert got.filter(F.col("bucket") != F.col("chunk_id") % 2).isEmpty()


def test_a_provider_remembers_a_bounded_number_of_words(monkeypatch):
    words = [f"word{i} naïve “quoted” café" for i in range(9)]
    want = [P.HashingEmbedder(16).embed(t) for t in words]
    monkeypatch.setattr(P._Hashes, "MOST", 3)
    monkeypatch.setattr(P, "_hashes", P._Hashes())
    assert [P.HashingEmbedder(16).embed(t) for t in words] == want and len(P._hashes) == 3


def test_native_hashing_equals_the_provider(spark):
    texts = ["alpha beta beta", "café Straße x1", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["embedding"] for r in P.hashed_vectors(df, "id", "t", 16).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], P.HashingEmbedder(16).embed(t), atol=1e-6)


def test_knn_and_fusion(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    x[10] = x[20]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    d = np.sqrt(((x.astype(float)[:, None] - x.astype(float)[None]) ** 2).sum(-1))
    want = {i: sorted(range(60), key=lambda j: (d[i, j], j))[:4] for i in range(60)}
    assert [r["chunk_id"] for r in knn(vectors, x[3].tolist(), 4).orderBy("rank").collect()] == want[3]
    got = {}
    for r in knn_batch(vectors, vectors.withColumnRenamed("chunk_id", "query_id"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want
    ranked = lambda ids: spark.createDataFrame([(0, c, k) for k, c in enumerate(ids, 1)], "query_id int, chunk_id long, rank int")
    fused = [(r["chunk_id"], round(r["score"], 10)) for r in rrf([ranked([10, 20, 30]), ranked([20, 40, 10])], 9).orderBy("rank").collect()]
    assert fused == [(20, 0.0325224749), (10, 0.0322664585), (40, 0.0161290323), (30, 0.0158730159)]
    assert [r["chunk_id"] for r in rrf([ranked([2]), ranked([1])], 9).orderBy("rank").collect()] == [1, 2]


def test_watch_indexes_a_rewritten_file(spark, store, tree):
    assert index_changes(store, [str(tree)], ["Templates/", ".obsidian/", "attachments/", ".sync-conflict-"]) == 5
    put(tree, {"sub/n.md": "rewritten here"}, at=1_700_000_000)
    running = watch(store, [str(tree)], ["Templates/", ".obsidian/", "attachments/", ".sync-conflict-"], 200)
    try:
        for _ in range(120):
            if store.search_keyword("rewritten", 1).collect():
                break
            running.awaitTermination(1)
        assert len(store.search_keyword("rewritten", 1).collect()) == 1
    finally:
        running.stop()


ROWS = [{"file_path": "a.md", "start_line": 1, "end_line": 5, "content": "Doc one content", "score": 1.0, "date": None, "section": "S", "project": None, "memory_type": None}, {"file_path": "b.md", "start_line": 1, "end_line": 3, "content": "Doc two content", "score": 0.5, "date": None, "section": None, "project": None, "memory_type": None}]


def test_parse_scores(spark):
    good = {"7,3,9,1,5": [7, 3, 9, 1, 5], "  7 , 3 , 9 , 1 , 5  ": [7, 3, 9, 1, 5], "15,-3,9,1,5": [10, 0, 9, 1, 5]}
    bad = {"7,3,9": "Expected 5", "": "empty", "7,three,9,1,5": "three", "7,3,": "Expected 5"}
    for s, want in good.items():
        assert R.parse_scores(s, 5) == want
    for s, want in bad.items():
        with pytest.raises(ValueError, match=want):
            R.parse_scores(s, 5)
    df = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string").select("s", R.parse_scores_column("s", F.lit(5)).alias("p")).collect()
    for r in df:
        assert r["p"]["scores"] == good.get(r["s"]) and (bad.get(r["s"]) or "") in (r["p"]["error"] or "")


def test_prompt_and_rerank_rules(spark):
    prompt = R.batch_prompt("test query", [r["content"] for r in ROWS])
    assert all(x in prompt for x in ("Document 1: Doc one content", "Document 2: Doc two content", "test query", "exactly 2 scores"))
    df = spark.createDataFrame([(1, "test query", i + 1, r["content"]) for i, r in enumerate(ROWS)], "query_id long, query string, rank int, content string")
    assert R.batch_prompts(df).first()["prompt"] == prompt

    class Fixed:
        def __init__(self, out):
            self.out = out

        def scores(self, query, contents):
            if isinstance(self.out, Exception):
                raise self.out
            return self.out

    files = lambda out: [(r["file_path"], r["score"]) for r in out]
    same = [("a.md", 1.0), ("b.md", 0.5)]
    assert R.rerank("q", [], Fixed([])) == []
    assert files(R.rerank("q", ROWS, Fixed([2, 9]))) == [("b.md", 9), ("a.md", 2)]
    assert files(R.rerank("q", ROWS, Fixed([3, 3]))) == [("a.md", 3), ("b.md", 3)]
    for broken in ([1], [-1, -1], [float("nan")] * 2, RuntimeError("x")):
        assert files(R.rerank("q", ROWS, Fixed(broken))) == same
    assert files(R.rerank("q", ROWS, None)) == same
    assert files(R.rerank("q", ROWS, Fixed([1]), top_k=2, taken=1)) == [("a.md", 1)]


def test_rerank_providers(monkeypatch):
    agent = P.AgentReranker(lambda prompt, model: iter([{"type": "text", "text": "4,"}, None, {"type": "text", "text": "8"}, {"type": "result"}, {"type": "text", "text": "9"}]))
    assert agent.scores("q", ["a", "b"]) == [4, 8]
    with pytest.raises(RuntimeError):
        P.AgentReranker(lambda *_: iter([None] * 60)).scores("q", ["a"])
    calls = []

    def post(url, body, headers=None):
        calls.append(body)
        if "bad" in body["messages"][0]["content"]:
            raise OSError("down")
        yield {"content": [{"text": " 12 "}]}

    monkeypatch.setenv("KEY", "k")
    messages = P.MessagesReranker(api_key_env="KEY", concurrency=2, post=post)
    assert messages.scores("q", ["good", "bad"]) == [10, 0]
    with pytest.raises(RuntimeError):
        messages.scores("q", ["bad", "bad"])
    with pytest.raises(RuntimeError):
        P.MessagesReranker(api_key_env="NO_SUCH_KEY", post=post).scores("q", ["a"])
    assert P.GenerateReranker(post=lambda *_: iter([{"response": "1,2"}])).scores("q", ["a", "b"]) == [1, 2]
    config = Config.parse('[reranking]\nprovider = "nobody"')
    assert P.rerank_provider(config.reranking) is None and isinstance(P.rerank_provider(Config().reranking), P.AgentReranker)


def test_config(tmp_path):
    c = Config.parse('[search]\ndefault_limit = 9\n[watch]\nexclude = ["zz"]\n[reranking.anthropic]\nmax_concurrent = 3\n[unknown]\nx = 1')
    assert (c.search.default_limit, c.search.rrf_k, c.watch.debounce_ms, c.reranking.messages) == (9, 60, 1500, {"max_concurrent": 3})
    assert c.should_skip_watch("/a/zz/b") and not c.should_skip_watch("/a/b")
    assert Config.load(tmp_path / "none.toml") == Config() and "default_limit = 5" in Config().show()
    assert expand_home("~/x") == os.path.expanduser("~") + "/x" and expand_home("~x") == "~x"


def test_formats(spark):
    text = formats.results_text("q", ROWS)
    assert text.startswith('Found 2 results for "q":\n\n[1] a.md:1-5 (score: 1.00)\nDoc one content\n')
    assert "Section: S\nDoc one" in formats.results_text("q", ROWS, full=True)
    assert json.loads(formats.results_json("q", ROWS))["results"][0] == {"file": "a.md", "lines": "1-5", "score": 1.0, "snippet": "Doc one content", "date": None, "section": "S", "memory_type": None}
    tool = json.loads(formats.results_tool_json("q", ROWS))
    assert tool["result_count"] == 2 and tool["results"][1]["score"] == "0.50" and formats.coverage(1, 3) == "33.3%"


def test_engine_cli_and_server(spark, tmp_path, tree, capsys):
    config = Config()
    config.index.paths = [str(tree)]
    engine = Engine(config, spark, f"file://{tmp_path}/e", P.HashingEmbedder(8))
    assert main(["index"], engine) == 0 and "Indexed 4 files, 5 chunks" in capsys.readouterr().out
    main(["alpha"], engine)
    assert "Found 3 results" in capsys.readouterr().out
    assert len(engine.search("alpha", 2, hybrid=True, after="2024-01-01")) == 2  # no vectors yet: keyword search with its filters
    main(["embed", "--incremental"], engine)
    assert "Embedded 5 chunks, 0 errors" in capsys.readouterr().out
    best = engine.search("alpha plans", 1, rerank_results=True, provider="overlap")
    assert best[0]["section"] == "Plans" and best[0]["score"] == 10.0
    main(["status", "--json"], engine)
    assert json.loads(capsys.readouterr().out)["embedded_count"] == 5
    server = Server(engine)
    ask = lambda method, **params: json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    lines = [ask("initialize"), "", ask("notifications/initialized"), "{oops", ask("tools/list"), ask("nope"), ask("tools/call", name="x_search", arguments={"query": "gamma"}), ask("tools/call", name="status", arguments={}), ask("tools/call", name="x", arguments={}), ask("tools/call", name="index", arguments={})]
    sink = io.StringIO()
    server.serve(io.StringIO("\n".join(lines) + "\n"), sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [o.get("error", {}).get("code") for o in out] == [None, -32700, None, -32601, None, None, None, None]
    assert json.loads(out[4]["result"]["content"][0]["text"])["results"][0]["content"] == "gamma delta"
    assert json.loads(out[5]["result"]["content"][0]["text"])["embedding_coverage"] == "100.0%"
    assert out[6]["result"]["isError"] and "across 1 paths" in out[7]["result"]["content"][0]["text"]
    assert main([], engine) == 0 and main(["config", "path"]) == 0


def test_texts_and_postings_are_written_without_a_shuffle(spark, store, tmp_path):
    """Each task writes its own file of a bucket, compactly; postings and lengths are those of the chunks."""
    from scrollmine.operators.postings import build_postings, doc_lengths

    docs = spark.createDataFrame([(f"/d/{i}.md", 1, f"Älpha beta {i} beta the\n## h{i}\n??") for i in range(40)] + [("/d/empty.md", 1, "")], "file_path string, mtime long, content string").repartition(4)
    store.replace_files(docs, indexed_at=0, everything=True)
    for table in ("chunks", "postings"):
        files = list((tmp_path / "store" / table / "gen=1").glob("bucket=*/*.parquet"))
        assert len(files) > store.buckets and all(f.name.endswith(".zstd.parquet") for f in files)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.postings()) == rows(build_postings(store.chunks())) and rows(store.lengths()) == rows(doc_lengths(store.chunks()))
    assert {r["chunk_count"] for r in store.files().filter("file_path = '/d/empty.md'").collect()} == {0}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_an_update_keeps_the_other_files(spark, store, monkeypatch, few):
    """Whether keys are sent to all tasks or shuffled; a path that occurs again counts with its latest time."""
    from scrollmine.operators.postings import build_postings
    from scrollmine.plans import store as module

    monkeypatch.setattr(module, "FEW", few)
    docs = lambda rows: spark.createDataFrame(rows, "file_path string, mtime long, content string")
    store.replace_files(docs([(f"/d/{i}.md", 1, f"alpha {i}") for i in range(12)]), indexed_at=0)
    store.replace_files(docs([("/d/1.md", 1, "older"), ("/d/1.md", 2, "newer alpha"), ("/d/20.md", 1, "other")]), docs([("/d/3.md", 0, "")]).select("file_path"), indexed_at=1)
    texts = {r["file_path"]: r["content"] for r in store.files().join(store.chunks(), "file_id").collect()}
    assert texts == {f"/d/{i}.md": f"alpha {i}" for i in range(12) if i != 3} | {"/d/1.md": "newer alpha", "/d/20.md": "other"}
    assert sorted(map(tuple, store.postings().collect())) == sorted(map(tuple, build_postings(store.chunks()).collect()))
    assert store.search_keyword("alpha", None).count() == 11


def test_a_search_without_a_limit_gives_all_in_order(spark, store):
    store.replace_files(spark.createDataFrame([(f"/d/{i}.md", 1, "alpha " * (i + 1) + "beta") for i in range(30)], "file_path string, mtime long, content string"), indexed_at=0)
    every, first = (store.search_keyword("alpha", k).collect() for k in (None, 10))
    assert len(every) == 30 and every[:10] == first
