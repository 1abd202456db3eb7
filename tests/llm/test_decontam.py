import random
import re

import pytest

from scrollmine.llm import decontam as D

from .helpers import documents, frame, sf, with_clashes

ITEMS = "item_id long, text string"


def shingles(text):
    w = re.split(r"[\x20\x09-\x0D]+", (text or "").lower())
    w = [x for x in w if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def brute(docs, items):
    out = set()
    for item, text in set(items):
        q = shingles(text)
        for i, t in set(docs):
            both = len(q & shingles(t))
            if q and both and 100 * both >= 75 * len(q):
                out.add((i, item, len(q), both))
    return out


def check(df, items):
    docs, own = ([tuple(r) for r in x.select(*x.columns[:1], "text").collect()] for x in (df, items))
    got = [tuple(r) for r in D.report(df, items).collect()]
    assert set(got) == brute(docs, own)
    return got


@pytest.mark.parametrize("smallest", [1, 12])
def test_equals_brute_force(spark, smallest):
    rnd = random.Random(smallest)
    words = lambda n: [rnd.choice("abcdefghijklm") + rnd.choice("nopqrs") for _ in range(n)]
    items = [(k, " ".join(words(rnd.randrange(smallest + 4 if smallest > 1 else 1, 50)))) for k in range(30)] + ([(90, None), (91, ""), (92, "one two")] if smallest == 1 else [])
    texts = [None, "", "one two", "One\tTWO"]
    for k, (_, t) in enumerate(items[:30]):
        w = t.split()
        cut = rnd.randrange(0, max(1, len(w) // 3))
        texts += [" ".join(words(rnd.choice((3, 200, 3000))) + w[cut:] + words(20)), " ".join(w[: len(w) // 2] + words(9) + w[len(w) // 2 :]), t.upper()]
    df = with_clashes(documents(spark, texts), "h", "item_id", "shift")
    table = spark.createDataFrame(items, ITEMS)
    assert len(check(df, table)) > 25
    check(df.union(df), table.union(table))


def test_driver_table_stage_and_empty(spark, monkeypatch):
    df, items = (spark.read.parquet(sf(n)) for n in ("documents", "benchmark"))
    leaked = {r[0] for r in check(df, items)}
    assert leaked
    monkeypatch.setattr(D, "BROADCAST_ROWS", 1)
    check(df, items)
    kept = D.drop_contaminated(df, items)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in df.select("doc_id").collect()} - leaked and kept.columns == df.columns
    assert D.report(df.limit(0), items).collect() == [] and D.report(df, items.limit(0)).collect() == []
    assert {r["doc_id"] for r in D.report(frame(spark, [(None, items.first()["text"], None, None, 0)]), items).collect()} == {None}


def test_bins_follow_the_smallest_item():
    assert D.extra_bits(1) > D.extra_bits(10) >= D.extra_bits(100) >= 1


def test_long_texts_and_clashing_columns(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    item = " ".join(word() for _ in range(30))
    long = " ".join(word() for _ in range(60_000))
    df = with_clashes(documents(spark, [long, long[:200_000] + " " + item + " " + long[200_000:], None]), "__id", "__hash", "found_id", "text_hash")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["shared"]) for r in D.report(df, items).collect()] == [(1, 1, 26)]
    kept = D.drop_contaminated(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
