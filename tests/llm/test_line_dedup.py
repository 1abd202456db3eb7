import hashlib
import random
import re

from scrollmine.llm import line_dedup as L

from .helpers import documents, frame, sf, with_clashes

SPACE = " \t\n\v\f\r"


def holds_window(counts):
    """Whether lines of so many words hold a line of 50 words, two that reach 50, or any three."""
    return len(counts) >= 3 or any(n >= 50 for n in counts) or sum(counts) >= 50


def brute(rows):
    """{(doc_id, text): (lines, removed line numbers)}: each longest run of lines that equals one which stands before,
    from every pair of places with equal lines, extended both ways as far as the lines are equal."""
    docs = []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        docs.append((i, text, lines, [(k, x.strip(SPACE), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(lines) if x.strip(SPACE)], set()))
    where = {}
    for d, (_, _, _, worded, gone) in enumerate(docs):
        for k, (_, line, _) in enumerate(worded):
            for e, j in where.get(line, ()):  # an equal line before
                other = docs[e][3]
                if k and j and worded[k - 1][1] == other[j - 1][1]:
                    continue  # inside a run that began further up
                n = 0
                while k + n < len(worded) and j + n < len(other) and worded[k + n][1] == other[j + n][1]:
                    n += 1
                if holds_window([c for _, _, c in worded[k : k + n]]):
                    gone.update(range(worded[k][0], worded[k + n - 1][0] + 1))
            where.setdefault(line, []).append((d, k))
    return {(i, text): (lines, gone) for i, text, lines, _, gone in docs}


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    got = L.report(df).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), len(lines), len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(lines) if k not in gone).encode()).hexdigest()) for i, t in rows for lines, gone in [want[i, t]])
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["clean_sha256"]) for r in got) == expected
    return got


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    pool = [f"line {k} " + "w " * rnd.choice((1, 5, 20, 30, 60)) for k in range(25)] + ["", "  ", "\x0b", " line 1 padded  "]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12))) for _ in range(80)] + [None, "", "\n\n", "same\n" * 12, "x " * 20000]
    df = with_clashes(documents(spark, texts), "runs", "text_hash", "first")
    check(df)
    check(df.union(df))
    check(frame(spark, [(None, "a\nb\nc", None, None, 0), (4, "z\na\nb\nc\ny", None, None, 0), (9, "a\nb\nc", None, None, 0)]))
    assert L.report(df.limit(0)).collect() == []


def test_driver_table_and_stage(spark):
    df = spark.read.parquet(sf("documents"))
    check(df)
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    kept = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    for (i, text), (lines, gone) in want.items():
        clean = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
        assert kept.get(i) == clean if not gone or clean.strip(SPACE) else i not in kept
    assert L.dedup_lines(df).columns == df.columns


def test_a_passage_goes_to_its_last_line(spark):
    line = lambda name, n: " ".join([name] + ["w"] * (n - 1))
    passages = [[line("a", 87), line("b", 7), line("c", 12)], [line("d", 53), line("e", 36)], [line("f", 60), line("g", 20), line("h", 20)], [line("i", 4), line("j", 5), line("k", 51), "", line("l", 3)]]
    texts = [line("a", 87) + "\nalone here"]  # the first copy of the long line ends otherwise
    for k in range(3):
        texts += ["\n".join([f"before {k} {n}", *p, f"after {k} {n}"]) for n, p in enumerate(passages)]
    texts += ["\n".join(passages[0]), "\n".join(passages[1] + passages[2])]
    got = {r["doc_id"]: r["removed"] for r in check(documents(spark, texts))}
    assert [got[i] for i in range(15)] == ["", "1-1", "", "", "", "1-3", "1-2", "1-3", "1-5", "1-3", "1-2", "1-3", "1-5", "0-2", "0-4"]


def test_long_texts_and_clashing_columns(spark):
    rnd = random.Random(4)
    long = "\n".join(f"row {rnd.randrange(10**6)} of a long text" for _ in range(15000))
    df = with_clashes(documents(spark, [long, "before\n" + long, "own words\n" + long[:5000], "x"]), "runs", "__runs", "__id", "run_id", "lines")
    got = {r["doc_id"]: r["n_removed"] for r in check(df)}
    assert got[1] == 15000 and got[0] == got[3] == 0
    kept = {r["doc_id"]: r for r in L.dedup_lines(df).collect()}
    assert kept[1]["text"] == "before" and kept[1]["__runs"] == 7 and L.dedup_lines(df).columns == df.columns


def test_native(spark):
    plan = L.report(documents(spark, ["a\nb\nc", "a\nb\nc"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
