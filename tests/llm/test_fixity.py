import pytest
from pyspark.sql import functions as F

from scrollmine.llm import fixity as X

PAGES = "page_id long, url string, html string"


def pages(spark, n=60):
    return spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 7 + 1)) for i in range(n)], PAGES)


def stored(spark, records, path, archives=3):
    X.write_warc(records, f"file://{path}", archives)
    return X.read_warc(spark, f"file://{path}")


def test_round_trip_of_hard_pages(spark, tmp_path):
    rows = [(1, "http://a\r\nb", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (2, None, None), (None, "u", "é日本"), (3, "u", ""), (3, "u", ""), (4, "u", "y" * 300000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("archive", F.lit(1)).withColumn("hash", F.lit("x"))
    got = stored(spark, X.warc_records(df), tmp_path / "a").collect()
    assert sorted((r["record_id"], r["turn"]) for r in got) == [("1", 1), ("2", 1), ("3", 1), ("3", 2), ("4", 1), ("none", 1)]
    import hashlib

    want = sorted(hashlib.sha256(r["record"].encode()).hexdigest() for r in X.warc_records(df).collect())
    assert sorted(r["hash"] for r in got) == want
    for a in {r["archive"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["archive"] == a), key=lambda r: r["ordinal"]):
            assert r["offset"] == at
            at += r["length"] + 4


@pytest.mark.parametrize("fanout", [2, 16])
def test_audit_equals_full_comparison(spark, tmp_path, monkeypatch, fanout):
    monkeypatch.setattr(X, "FANOUT", fanout)
    records = X.warc_records(pages(spark))
    copy = records.filter("page_id not in (7, 8)").withColumn("record", F.when(F.col("page_id").isin(20, 41), F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    copy = copy.withColumn("record", F.when(F.col("page_id") == 30, F.regexp_replace("record", "<p>", "<q>")).otherwise(F.col("record")))
    extra = X.warc_records(spark.createDataFrame([(999, "http://new", "n")], PAGES))
    a, b = stored(spark, records, tmp_path / "a"), stored(spark, copy.union(extra), tmp_path / "b")
    got = X.audit(a, b).collect()
    status = {(r["record_id"], r["status"]) for r in got}
    assert {("7", "missing"), ("8", "missing"), ("30", "changed"), ("999", "extra")} <= status
    one, two = ({(r["archive"], r["record_id"], r["turn"]): r["hash"] for r in x.collect()} for x in (a, b))
    assert {(r["archive"], r["record_id"], r["turn"]) for r in got} == {k for k in one.keys() | two.keys() if one.get(k) != two.get(k)}
    assert X.audit(a, a).collect() == []


def test_damaged_file_is_located():
    whole = b"".join(b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % i for i in range(4))
    broken = whole.replace(b"page:2>\r\nContent-Length: 3", b"page:2>\r\nContent-Length: 9")
    assert [r[2] for r in X._parse(whole)] == ["0", "1", "2", "3"]
    assert [r[2] for r in X._parse(broken)] == ["0", "1", "damaged", "3"]
    assert list(X._parse(b"")) == [] and [r[2] for r in X._parse(b"junk")] == ["damaged"]


def test_drill_and_empty(spark):
    got = sorted((r["page_id"], r["status"]) for r in X.drill(pages(spark, 120)).collect())
    assert got == [(13, "changed"), (14, "missing"), (110, "changed"), (111, "missing")]
    assert X.drill(pages(spark).limit(0)).collect() == []
