import itertools
import random
import re

import numpy as np
import pytest

from scrollmine.llm import quality_rules as Q

from .helpers import documents, frame, sf, with_clashes

JUNK = "\n".join(["word### other%%% thing*** more&&& last$$$ " * 3] * 4)
GOOD = "This is a plain line of words that ends well.\nAnother line follows here, and it is fine too.\nThe end of it."
CASES = [None, "", " \n \n", GOOD, JUNK, GOOD + "\n" + JUNK * 5, "a b c d e " * 40, "x" * 50000, "Same line here.\n" * 9, "\x1ca\x85b c d　e " * 9, "|\n" * 5, "one two three four five six seven eight nine ten"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = CASES + [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(60))) for _ in range(200)]
    for t in texts:
        assert Q.base_counts(t or "") == brute(t), t and t[:80]
    many = [str(i % 9000) for i in range(20000)]
    assert Q.base_counts(" ".join(many)) == brute(" ".join(many))
    field = Q.fit([])
    df = with_clashes(documents(spark, texts), "kept", "n_words")
    got = {r["doc_id"]: r for r in Q.judge(df, field).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = brute(t), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = {r["doc_id"] for r in Q.keep_good(df, field).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert Q.judge(df.limit(0), field).collect() == [] and got[3]["kept"] and not got[5]["kept"]


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = Q.LineField()
    field.emit, field.move = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2))
    x = rng.normal(size=(6, len(Q.FEATURES)))
    scores = x @ field.emit
    paths = list(itertools.product((0, 1), repeat=6))
    value = [sum(scores[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
    assert tuple(field.decode(x)) == paths[int(np.argmax(value))]
    p = np.exp(value - np.logaddexp.reduce(value))
    label, pairs = Q._marginals(np.pad(scores, ((0, 3), (0, 0)))[None], field.move, np.array([[True] * 6 + [False] * 3]))
    want = np.array([[sum(q for q, y in zip(p, paths, strict=True) if y[t] == k) for k in (0, 1)] for t in range(6)])
    assert np.allclose(label[0, :6], want) and np.isclose(pairs.sum(), 5)


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(sf(n).replace("sf0.001", "sf0.01")) for n in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    return [(r["text"], r["quality"]) for r in rows]


def test_held_out_documents(labelled):
    field = Q.fit(labelled[::2])
    held = [(Q._judge(t, field)[6], q, Q.base_counts(t)[0]) for t, q in labelled[1::2]]
    good = [k for k, q, n in held if q == 1 and n >= 10]
    bad = [k for k, q, _ in held if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_sample_takes_both_grades_and_survives_repeats(spark):
    docs = documents(spark, [GOOD, JUNK, GOOD, None])
    labels = frame(spark, [(0, 1, 0), (1, 0, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(Q.sample_labelled(docs, labels)) == [("", 0), (JUNK, 0), (GOOD, 1)] or len(Q.sample_labelled(docs, labels)) == 3
    assert Q.sample_labelled(docs, labels.limit(0)) == []


def test_lines_are_learned_from_grades(labelled):
    """Marked lines of held-out bad documents, and none of good ones, though no line of the sample had a label."""
    field = Q.fit(labelled[::2])
    mixed = GOOD + "\n" + JUNK
    labels = field.decode(Q.line_features(mixed.split("\n"))[0])
    assert labels[:3].tolist() == [0, 0, 0] and labels[3:].all()
    base = [not Q.base_failed(c[0], c[4]) for t, q in labelled[1::2] if q == 0 for c in [Q.base_counts(t)]]
    kept = [Q._judge(t, field)[6] for t, q in labelled[1::2] if q == 0]
    assert sum(kept) < 0.2 * sum(base)


def test_long_texts_are_sampled_whole_or_not(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_CHARS", 500)
    docs = documents(spark, [GOOD, JUNK, "long text " * 100])
    labels = frame(spark, [(0, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.sample_labelled(docs, labels) == [(GOOD, 1)] + ([(JUNK, 0)] if len(JUNK) <= 500 else [])
