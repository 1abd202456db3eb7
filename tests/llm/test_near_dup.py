import math
import random
import re

import numpy as np
import pytest

from scrollmine.llm import near_dup as N

from .helpers import documents, frame, sf, with_clashes


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """{place: (set size, smallest place reachable)} by comparing all pairs."""
    sets = [brute_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def varied(rnd, words, share):
    return " ".join(rnd.choice("pqrst") * 3 if rnd.random() < share else w for w in words)


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \t\n", "one two", "One TWO", "one two three", "É a", "é a", "same " * 3000]
    for _ in range(6):
        base = [word() for _ in range(rnd.randrange(20, 200))]
        texts += [varied(rnd, base, rnd.choice((0, 0.005, 0.02, 0.04, 0.1))) for _ in range(20)]
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rnd.randrange(1, 90))]) for _ in range(60)]
    chain = [word() for _ in range(120)]
    texts += [" ".join(chain[i * 4 : i * 4 + 80]) for i in range(10)]
    rnd.shuffle(texts)
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    got = {r["doc_id"]: r for r in N.near_duplicates(with_clashes(documents(spark, texts), "row", "node", "kept")).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_many_hubs_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "OUTSIDERS", 1)
    monkeypatch.setattr(N, "HUB_ROUNDS", 2)
    monkeypatch.setattr(N, "BROADCAST_IDS", 3)
    texts = corpus(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_driver_table(spark):
    df = spark.read.parquet(sf("documents"))
    rows = sorted(df.select("doc_id", "text").collect())
    want = {rows[i][0]: (n, rows[c][0]) for i, (n, c) in brute([r[1] for r in rows]).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()} == want
    kept = {r["doc_id"] for r in N.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_repeated_rows_and_null_ids(spark):
    a, b = "one two three four five six seven", "completely other words stand in this text"
    rows = [(5, a, None, None, 0), (5, a, None, None, 0), (3, b, None, None, 0), (3, a, None, None, 0), (None, b, None, None, 0), (None, "null only text", None, None, 0), (None, None, None, None, 0)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(frame(spark, rows)).collect() if r["n_shingles"] != 1)
    assert got[:4] == [(False, 3, 3, 3, True), (False, 3, 3, 3, True), (False, 5, 3, 3, False), (False, 5, 3, 3, False)]
    assert N.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(3)
    for share in (0.75, 0.85, 0.95):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share), np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, (n - len(both)) // 2, np.uint64)])) for _ in range(2))
        x, y = N.minhash(a), N.minhash(b)
        differing = int(np.unpackbits((N.odd_sketch(x) ^ N.odd_sketch(y)).view(np.uint8)).sum())
        assert abs(N.estimate(differing) - share) < 0.13
        assert abs((x == y).mean() - share) < 0.13


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 8)], "a long, b long")
    got = {r["node"]: r["comp"] for r in N.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, 8: 7, 9: 7}
    assert N.components(links.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["a b c d", "A b c d e f", "x " * 50])
def test_set_sizes(text):
    assert len(N.shingle_set(text)) == len(brute_set(text))


def test_sketches_miss_less_than_the_bands():
    """The exact chance that a pair at the threshold has more differing bits than MOST_DIFFERING."""
    bits, share, k = N.SKETCH_BITS, N.PERCENT / 100, np.arange(N.SKETCH_BITS + 1)
    chance, missed = np.zeros(bits + 1), 0.0  # of each number of differing bits
    chance[0] = 1
    for differing in range(N.SAMPLES + 1):
        of_samples = math.comb(N.SAMPLES, differing) * (1 - share) ** differing * share ** (N.SAMPLES - differing)
        missed += of_samples * chance[N.MOST_DIFFERING + 1 :].sum()
        for _ in range(2):  # a differing sample flips one bit in either sketch
            more, less = chance[:-1] * (bits - k[:-1]) / bits, chance[1:] * k[1:] / bits
            chance = np.append(0, more) + np.append(less, 0)
    assert missed < 5e-6 < (1 - share**N.ROWS) ** N.BANDS


def test_a_pair_at_the_threshold_with_unlike_sketches(spark):
    words = (lambda rnd: [f"w{rnd.randrange(10**6)}" for _ in range(60)])(random.Random(15030))
    texts = [" ".join(words[:53]), " ".join(words[7:])]  # 42 of 56 shingles are shared; the sketches differ in 94 bits
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts) == {0: (49, 0), 1: (49, 0)}


def test_marks_never_reject_small_sets_at_the_threshold():
    rng = np.random.default_rng(5)
    for n in (7, 140, 511, 513, 700, 3000):
        for _ in range(30):
            both = rng.integers(0, 2**63, max(3, int(n * 0.86)), np.uint64)  # 6 of 8 shingles are shared
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, len(both) // 6, np.uint64)])) for _ in range(2))
            assert 100 * len(both) >= 75 * (len(a) + len(b) - len(both))
            x, y, low, high = N.marks(a), N.marks(b), *sorted((N.level_of(len(a)), N.level_of(len(b))))
            half = N.MARK_BITS // 64
            x, y = (v[half:] if N.level_of(len(s)) < high else v[:half] for v, s in ((x, a), (y, b)))
            differing = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            most = (len(a) + len(b)) / 7 / 2**high
            assert differing <= (most + 6 * most**0.5 if high else most) and high - low <= 1


def test_long_near_copies_across_levels(spark):
    rnd = random.Random(9)
    base = [f"v{rnd.randrange(10**7)}" for _ in range(1300)]
    texts = [" ".join(base[: rnd.randrange(980, 1300)]) for _ in range(12)] + [" ".join(base[k : k + 540]) for k in range(0, 200, 18)]
    texts += [varied(rnd, base[:600], 0.05) for _ in range(15)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_keep_one_tells_rows_apart(spark):
    a, b, c = ("one two three four five six seven", "completely other words stand in this text", "a third text of its own that nothing repeats")
    rows = [(1, a, "x", None, 0), (2, a, None, None, 0), (2, b, None, None, 0), (3, c, None, "s", 0), (3, c, None, "t", 0), (None, b, None, None, 0), (None, "no id but words here", None, None, 0), (4, "", None, None, 0), (4, "", None, None, 0), (None, None, None, None, 0)]
    df = with_clashes(frame(spark, rows), "row", "Row_", "keeper")
    got = N.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["lang"] or "") for r in got.collect()) == sorted([(1, a, "x"), (2, b, ""), (3, c, ""), (0, "no id but words here", ""), (4, "", ""), (4, "", ""), (0, "", "")])
    assert N.keep_one(df.limit(0)).collect() == []
