import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from scrollmine.llm import orc_tokens, packing
from scrollmine.llm.common import TokenCodec

from .helpers import documents, sf, with_clashes


@pytest.fixture(scope="module")
def codec():
    return TokenCodec()


def ids_of(codec, text, end):
    return [*codec.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codec_equals_library(codec):
    rnd, letters = random.Random(5), "ab'sSTRÉéßÿ _.,_-!?0129\t\n\r\x0b'lLdD$<|>#ſK²½\xa0é日"
    texts = ["<|endoftext|> a", "don't we'll I'M", "x" * 5000, "ª²", "İI", "ΑΣ Σ", *("".join(rnd.choices(letters, k=rnd.randrange(1, 40))) for _ in range(3000))]
    for t in texts:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == codec.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    small = TokenCodec(max_cached=3)
    assert all(small.encode(t) == codec.encode(t) for t in texts[:200])


HARD = [None, "", " ", "a", "word " * 9000, "the end. " * 3, "the end. " * 3, "é ß 日本", "x" * 30000]


def check_orc(spark, codec, df):
    rows = sorted((r.asDict() for r in df.select("doc_id", "text").collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted((r.asDict() for r in orc_tokens.encode_corpus(df).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((str(r["doc_id"]), len(x := ids_of(codec, r["text"], orc_tokens.END_ID)), crc(x)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_orc_round_trip(spark, codec):
    df = with_clashes(documents(spark, HARD), "tokens", "n_tokens", "row", "part")
    check_orc(spark, codec, df)
    check_orc(spark, codec, df.union(df).withColumn("doc_id", (df["doc_id"] % 3)))
    check_orc(spark, codec, spark.read.parquet(sf("documents")))
    assert orc_tokens.encode_corpus(df.limit(0)).collect() == []


def test_orc_lookup_uses_filter(spark, codec, tmp_path):
    df = documents(spark, HARD)
    orc_tokens.write_tokens(df, f"file://{tmp_path}/t")
    assert orc_tokens.lookup(spark, f"file://{tmp_path}/t", 5).first()["tokens"] == ids_of(codec, HARD[5], 1)
    plan = orc_tokens.lookup(spark, f"file://{tmp_path}/t", 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan


def check_packing(codec, df, got):
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = sorted(((d is None, d or 0), tuple(ids_of(codec, t, packing.END_ID))) for d, t in texts)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for k, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == packing.SEQUENCE or k == max(sequences) and at <= packing.SEQUENCE
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in want)
    by_doc: dict = {}
    for d, ids in want:
        by_doc.setdefault(d, []).append(ids)
    for r in got:
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        assert any(len(ids) == r["doc_tokens"] and crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in by_doc[key])


def test_packing(spark, codec):
    df = with_clashes(documents(spark, HARD * 2, {3: None}), "row", "queue", "n", "position")
    check_packing(codec, df, packing.pack(df).collect())
    df = spark.read.parquet(sf("documents"))
    got = packing.pack(df).collect()
    check_packing(codec, df, got)
    assert packing.pack(df.limit(0)).collect() == []


def test_packing_groups_and_written_order(spark, codec, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    df = spark.read.parquet(sf("documents"))
    got = packing.write_sequences(df, f"file://{tmp_path}/s").collect()
    check_packing(codec, df, got)
    # shares hold over every stretch of the stream, but for what a document more or less carries
    totals, longest = {}, max(r["doc_tokens"] for r in got)
    for r in got:
        totals[r["source"]] = totals.get(r["source"], 0) + r["length"]
    whole, served, at = sum(totals.values()), dict.fromkeys(totals, 0), 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        served[r["source"]] += r["length"]
        at += r["length"]
        if at > whole // 4:
            assert abs(served[r["source"]] - at * totals[r["source"]] / whole) <= longest + packing.SEQUENCE + len(totals) * longest
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    check_packing(codec, df, packing.pack(df).collect())


def test_packing_given_shares(spark, codec):
    df = spark.read.parquet(sf("documents"))
    got = packing.pack(df, {"src0": 0.5, "src1": 0.5}).collect()
    check_packing(codec, df, got)
    first = [r for r in got if r["sequence_id"] < 2]
    assert {r["source"] for r in first} <= {"src0", "src1"}


def test_phases():
    plan = packing.phases({"a": 100, "b": 50, "c": 0}, {"a": 1, "b": 1})
    assert plan == [(0, {"a": (0, Fraction(1, 2)), "b": (0, Fraction(1, 2))}), (100, {"a": (50, 1)})]
    assert packing.phases({}, None) == []
    assert len(packing.phases({"a": 3, "b": 5, "z": 9}, None)) == 1


def windows_of(got):
    """{sequence_id: {source: tokens}}"""
    out: dict = {}
    for r in got:
        own = out.setdefault(r["sequence_id"], {})
        own[r["source"]] = own.get(r["source"], 0) + r["length"]
    return out


def test_every_window_holds_the_target_proportions(spark, codec):
    rnd = random.Random(4)
    texts = ["word " * rnd.choice((3, 40, 700, 9000)) for _ in range(60)] + ["one"]
    df = documents(spark, texts, {i: "rare" if i == 60 else f"src{i % 7}" for i in range(61)})
    got = packing.pack(df).collect()
    check_packing(codec, df, got)
    windows = windows_of(got)
    totals = {s: sum(w.get(s, 0) for w in windows.values()) for s in {r["source"] for r in got}}
    whole = sum(totals.values())
    for k, own in windows.items():
        size = sum(own.values())
        for s, total in totals.items():
            assert abs(own.get(s, 0) - size * total / whole) <= len(totals) + 2, (k, s)
    assert len(windows) > 10
    # given shares hold in every window before a source runs dry, and all tokens are served once after it too
    got = packing.pack(df, {"src0": 0.75, "src1": 0.25}).collect()
    check_packing(codec, df, got)
    dry = min(totals["src0"] / 0.75, totals["src1"] / 0.25) // packing.SEQUENCE
    early = {k: w for k, w in windows_of(got).items() if k < dry}
    assert early and all(abs(w["src0"] - 3072) <= 4 and abs(w["src1"] - 1024) <= 4 for w in early.values())


def test_many_sources_keep_their_own_queues(spark, codec, monkeypatch):
    df = documents(spark, ["word " * (100 + 120 * (i % 9)) for i in range(180)], {i: f"host{i % 12}" for i in range(180)})
    few = [sorted(map(tuple, packing.pack(df, s).collect())) for s in (None, {"host3": 0.75, "host5": 0.25})]
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    got = packing.pack(df).collect()
    check_packing(codec, df, got)
    assert {r["source"] for r in got} == {f"host{k}" for k in range(12)}
    assert sorted(map(tuple, got)) == few[0]
    got = packing.pack(df, {"host3": 0.75, "host5": 0.25}).collect()
    check_packing(codec, df, got)
    first = windows_of(got)[0]
    assert set(first) == {"host3", "host5"} and abs(first["host3"] - 3072) <= 4
    assert sorted(map(tuple, got)) == few[1]
