import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from scrollmine.functions import paths, text, vectors
from scrollmine.operators.chunking import chunk_documents


def literal_chunks(content):
    """The chunker's rules as a plain loop over lines."""
    body = re.sub(r"\r?\n\Z", "", content)
    ls = re.split(r"\r?\n", body)
    prefix = [0]
    for x in ls:
        prefix.append(prefix[-1] + len(x.encode()) + 1)
    out, start = [], 0
    for i, line in enumerate(ls):
        if line.startswith("## "):
            if i > start:
                out.append((start, i))
            start = i
        elif prefix[i + 1] - prefix[start] - 1 > 1600:
            out.append((start, i))
            ok = [s for s in range(start, i) if prefix[i] - prefix[s] >= 240]
            start = max(ok) if ok else start
    out.append((start, len(ls)))
    rows = []
    for s, e in out:
        joined = "\n".join(ls[s:e])
        if joined.strip():
            heads = [x[3:].strip() for x in ls[: s + 1] if x.startswith("## ")]
            rows.append((s + 1, e, heads[-1] if heads else None, joined))
    return rows


CASES = [
    ("intro\n## Alpha \na1\n\n## Beta\nb1", [(1, 1, None, 5), (2, 4, "Alpha", 13), (5, 6, "Beta", 10)]),
    ("\n".join(["z" * 99] * 40), [(1, 16, None, 1599), (14, 29, None, 1599), (27, 40, None, 1399)]),
    ("\n".join(["é" * 60] * 20), [(1, 13, None, 1572), (12, 20, None, 1088)]),
    ("\n  \n## H1\nx", [(3, 4, "H1", 7)]),
    ("# T\n### S\n```\n## in fence\n```", [(1, 3, None, 13), (4, 5, "in fence", 15)]),
    ("## A\n" + "\n".join(["w" * 399] * 5) + "\n## B\nt", [(1, 4, "A", 1204), (4, 6, "A", 1199), (7, 8, "B", 6)]),
    ("## only", [(1, 1, "only", 7)]),
    ("", []),
]


def chunked(spark, contents):
    df = spark.createDataFrame([(i, f"/d/{i}.md", c) for i, c in enumerate(contents)], "doc_id long, file_path string, content string")
    out = {}
    for r in chunk_documents(df).orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_chunker_examples(spark):
    got = chunked(spark, [c for c, _ in CASES])
    for i, (_, want) in enumerate(CASES):
        assert [(r["start_line"], r["end_line"], r["section"], len(r["content"].encode())) for r in got.get(i, [])] == want
    echo = chunked(spark, ["x" * 2000 + "\n" + "\n".join(["y" * 30] * 12)])[0]
    assert [(r["start_line"], r["end_line"]) for r in echo] == [*((1, e) for e in range(1, 10)), (2, 13)]


def test_chunker_equals_the_loop(spark):
    rnd = random.Random(3)
    line = lambda: rnd.choice(["", "## " + "h" * rnd.randrange(4), "x" * rnd.randrange(500), "é" * rnd.randrange(900), " \t", "# no"])
    contents = [rnd.choice(["\n", "\r\n"]).join(line() for _ in range(rnd.randrange(1, 40))) + rnd.choice(["", "\n", "\n\n"]) for _ in range(300)]
    got = chunked(spark, contents)
    for i, c in enumerate(contents):
        assert [(r["start_line"], r["end_line"], r["section"], r["content"]) for r in got.get(i, [])] == literal_chunks(c), repr(c)[:300]
        assert [r["chunk_index"] for r in got.get(i, [])] == list(range(len(got.get(i, []))))


def test_path_metadata(spark):
    want = {
        "/v/ARIA/Skills/x.md": ("skill", None), "/v/aria/skills/memory.md": ("skill", None), "/v/aria/MEMORY.md": ("semantic", None), "/v/other/memory.md": (None, None), "/v/other/user.md": ("semantic", None),
        "/v/soul.md": ("semantic", None), "/v/aria/issues.md": ("procedural", None), "/v/Daily Notes/2024-01-02.md": ("episodic", "2024-01-02"), "/v/periodic/daily/2024-01-02-x.md": ("episodic", None),
        "/v/aria/messages/m.md": ("episodic", None), "/v/aria/contacts/c.md": ("semantic", None), "/v/abcd-ef-gh.md": (None, "abcd-ef-gh"), "/v/2024-01-02": (None, "2024-01-02"), "/v/.md": (None, None),
    }
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", paths.memory_type("p").alias("m"), paths.file_date("p").alias("d"))
    assert {r["p"]: (r["m"], r["d"]) for r in df.collect()} == want


def test_globs(spark):
    assert paths.like_of_glob("*.m?") == "%.m_"
    for glob, path, hit in [("**/Templates/**", "/a/Templates/x.md", True), ("**/Templates/**", "/a/Template/x.md", False), ("**/*.sync-conflict-*", "/q/x.sync-conflict-1.md", True), ("*.md", "/a.md", False), ("/a/?.md", "/a/b.md", True)]:
        assert bool(re.search(paths.glob_regex(glob), path)) == hit


@pytest.mark.parametrize("value", ["Café NAÏVE", "user's snake_case", "x1 2024-01-01", "éà", "", "ß Straße", "日本 語", "½ ²"])
def test_tokens_agree_with_the_driver(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(text.tokens("t").alias("x")).first()["x"] == text.query_tokens(value)


def test_lines_snippets_and_vectors(spark):
    df = spark.createDataFrame([("a\r\nb\n\n",), ("",), ("\n",)], "t string").select(text.lines("t").alias("x"))
    assert [r["x"] for r in df.collect()] == [["a", "b", ""], [""], [""]]
    long, wide = " " + "a" * 300, "é" * 150
    df = spark.createDataFrame([(long,), (wide,), (" ok ",)], "t string").select(text.snippet("t").alias("x"))
    assert [r["x"] for r in df.collect()] == ["a" * 199 + "...", "é" * 150 + "...", "ok"]
    values = [0.0, -0.0, 1.5, -2.75e-3, 3.4e38, 1e-40, float("inf"), 7e-46]
    blob = struct.pack("<8f", *values)
    df = spark.createDataFrame([(bytearray(blob),), (bytearray(b"123"),)], "b binary").select(vectors.decoded("b", 8).alias("v"))
    first, second = (r["v"] for r in df.collect())
    assert first == list(struct.unpack("<8f", blob)) and second is None
    assert vectors.from_bytes(vectors.to_bytes([1.5, 2.0])) == [1.5, 2.0]
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert df.select(vectors.l2_distance("a", "b").alias("d")).first()["d"] == 5.0
    assert df.select(vectors.normalized("b").alias("v")).select(F.round(F.col("v")[0].cast("double"), 4)).first()[0] == 0.5547
