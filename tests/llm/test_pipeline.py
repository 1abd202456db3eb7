import random

import corpus_pipeline as C
from scrollmine.llm import decontam, line_dedup, near_dup, packing, quality_rules
from scrollmine.llm.common import materialize

from . import test_decontam, test_line_dedup, test_near_dup
from .helpers import frame, with_clashes

DIR = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_each_stage_against_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    good = materialize(stages["quality rules"](spark, docs, DIR), "t")
    field = quality_rules.fit(quality_rules.sample_labelled(docs, spark.read.parquet(f"{DIR}/labels.parquet")))
    assert good.columns == docs.columns and ids(good) == sorted(r["doc_id"] for r in docs.collect() if quality_rules._judge(r["text"], field)[6])

    lined = materialize(stages["line dedup"](spark, good, DIR), "t")
    want = test_line_dedup.brute([(r["doc_id"], r["text"]) for r in good.collect()])
    clean = {i: "\n".join(x for k, x in enumerate(lines) if k not in gone) for (i, _), (lines, gone) in want.items()}
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == {i: t for i, t in clean.items() if t.strip()}

    single = materialize(stages["MinHash near-dedup"](spark, lined, DIR), "t")
    rows = sorted((r["doc_id"], r["text"]) for r in lined.collect())
    assert ids(single) == [rows[i][0] for i, (_, c) in test_near_dup.brute([t for _, t in rows]).items() if c == i]

    safe = materialize(stages["benchmark decontamination"](spark, single, DIR), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {x[0] for x in test_decontam.brute([(r["doc_id"], r["text"]) for r in single.collect()], items)}
    assert ids(safe) == [i for i in ids(single) if i not in leaks]

    packed = stages["packing"](spark, safe, DIR).collect()
    assert sorted({r["doc_id"] for r in packed}) == ids(safe)
    whole = sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in C.run(spark, DIR).collect()) == whole
    assert {decontam, line_dedup, near_dup, packing}


def test_hard_cases_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, clashing columns, empty tables."""
    rnd = random.Random(12)
    prose = lambda n: ". ".join(" ".join("".join(rnd.choice("abcdeinorst") for _ in range(rnd.randrange(2, 9))) for _ in range(9)).capitalize() for _ in range(n)) + "."
    passage, item, twin = prose(9), prose(4), prose(12)
    rows = [(1, twin, "en", "a", 5), (1, twin, "en", "a", 5), (2, twin + " end", None, None, None), (2, prose(11), None, "", None), (None, prose(13), None, None, None), (None, None, None, None, None), (3, "", "en", "b", 0), (4, " \n ", "en", "b", 0)]
    rows += [(5, prose(3) + "\n" + passage, "en", "b", 1), (6, passage + "\n" + prose(3), "en", "b", 1), (7, prose(5) + " " + item + " " + prose(5), "en", "c", 1), (8, prose(4000), "en", "c", 1), (9, "short", "en", "c", 1)]
    docs = with_clashes(frame(spark, rows), "row", "runs", "text_hash", "found_id", "kept")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(1, 1, 0), (9, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, [(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage, (_, function) in enumerate(C.STAGES[:-1]):
        before = docs
        docs = materialize(function(spark, docs, str(tmp_path)), "t")
        assert docs.columns == before.columns and docs.count() <= before.count(), stage
    left = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
    want = [t for t in rows if t[1] and len(t[1].split()) >= 10]
    assert [i for i, _ in left] == [0, 1, 2, 5, 6, 8] and passage not in dict(left)[6] and len(dict(left)[8]) == len(next(t[1] for t in want if t[0] == 8))
    packed = C.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] or 0 for r in packed}) == [0, 1, 2, 5, 6, 8]
    assert {r["source"] for r in packed if r["doc_id"] == 2} == {""} and {r["source"] for r in packed if r["doc_id"] is None} == {None}
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert C.run(spark, str(empty)).collect() == []
