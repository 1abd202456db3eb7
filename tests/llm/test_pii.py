import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from scrollmine.llm import pii as P

from .helpers import documents, sf, with_clashes

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    None, "", "a@b.c", "a@b", "a@b@c.d e@f..g h@i.j. k@l.m.n.", "x@y.com_z@w.org", "..@a.b %+-@c-d.e-f", "é@ü.com jé.x@y.zé", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1.2.3",
    "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1112 5500  0000 0000 0004", "12 34-56 7890123456789012 345", "+1 (743) 555-3824 +12345678 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1++22 333 4444. (",
    "﷐a@b.c﷐ ﷑. 4111﷐1111", "1 2 " * 3000, "a." * 9000 + "@b" + ".c" * 9000, "9" * 40000, "1." * 20000, "u@v.w " * 1500,
    "mail: jane.doe (at) example (dot) com today", "call 555-123-4567 now", "ssn: 123-45-6789", "IBAN DE44 5001 0517 5407 3249 31 please", "order 555-123-4567 shipped", "𝒳𝒴 a@b.cd 𝒵 10.0.0.1",
]


def compare(df, model):
    texts = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    got = P.digests(P.find_spans(df, model)).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        want = brute(texts[r["doc_id"]][0])
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in PATTERNS] == want, (texts[r["doc_id"]][0] or "")[:200]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in want) for k in PATTERNS]
        assert r["n_added"] == len(spans) - len(want)
    return {r["doc_id"]: r["spans"] for r in got}


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark)


def test_base_equals_brute_force(spark, model):
    rnd = random.Random(6)
    letters = ["1", "2", "4111111111111111", "0", ".", ".", "@", "-", " ", "+", "(", ")", "a", "b.c", "é", "\n", "_", "%"]
    texts = CASES + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(800)]
    spans = compare(with_clashes(documents(spark, texts), "base", "scored"), model)
    at = CASES.index("mail: jane.doe (at) example (dot) com today")
    assert spans[at] == "email_spelled:6:37"
    assert spans[at + 1] == "phone_local:5:17" and spans[at + 2] == "national_id:5:16" and spans[at + 3].startswith("iban:5:") and spans[at + 4] == ""


def test_driver_table_empty_and_repeats(spark, model):
    compare(spark.read.parquet(sf("documents")), model)
    df = documents(spark, CASES[:12])
    compare(df.union(df), model)
    assert P.digests(P.find_spans(df.limit(0), model)).collect() == []


def test_expression_equals_trees_and_is_calibrated(spark, model):
    import numpy as np

    rows = P.training_texts(400, seed=99)
    table = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    from pyspark.sql import functions as F

    found = P.candidates(table).select("doc_id", F.explode("proposed").alias("c")).select("doc_id", "c.x", "c.start", "c.end", model.expression(F.col("c.x")).alias("p")).collect()
    x = np.array([r["x"] for r in found])
    assert np.allclose([r["p"] for r in found], model.probability(x))
    truth = np.array([rows[r["doc_id"]][3] and r["start"] < rows[r["doc_id"]][2] and rows[r["doc_id"]][1] < r["end"] for r in found])
    chosen = np.array([r["p"] >= model.thresholds[int(r["x"][0])] for r in found])
    assert truth[chosen].mean() > 0.93 and chosen[truth.astype(bool)].mean() > 0.7


def test_no_python_on_the_main_path_and_redaction(spark, model):
    df = documents(spark, ["write a@b.com or +1 (743) 555-3824, thanks", None, "plain"])
    found = P.find_spans(df, model)
    plan = P.digests(found)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert {r["doc_id"]: r["text"] for r in P.redacted(found).collect()} == {0: "write [email] or [phone], thanks", 1: "", 2: "plain"}


def test_every_match_of_a_generator_passes_its_gate(spark):
    rnd = random.Random(8)
    parts = [" at ", "at ", " at", "(at)", " [at] ", "{at}", " AT ", " dot ", "(dot)", " [dot] ", "{dot}", ".", " . ", "DOT", "anna", "mail", "org", "x" * 64, "x" * 70, "-", " ", "é", "\n", "555", "-12-", "(555) ", "1234", "DE44", " 5001"]
    texts = ["mail: john.smith at example.com", "contact john at example [dot] com", "reach me: anna at mail{dot}org", "write to bob at firm.de"]
    texts += ["ssn: 123-45-6789", "call 555-123-4567 now", "IBAN DE44 5001 0517 5407 3249 31 please"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(3, 12))) for _ in range(4000)]
    df = documents(spark, texts)
    for kind, (pattern, _) in P.GENERATORS.items():
        matched = df.filter(df["text"].rlike(pattern))
        assert matched.count() > 0
        assert matched.filter(~df["text"].rlike(P._GATES[kind])).select("text").take(5) == [], kind
    proposed = {r["doc_id"]: [c["kind"] for c in r["proposed"]] for r in P.candidates(df.filter("doc_id < 4")).collect()}
    assert proposed == {i: ["email_spelled"] for i in range(4)}


def test_many_matches_in_one_text(spark):
    n = 20_000
    text = " ".join(f"u{i}@x.org, 10.1.{i % 200}.7, my ssn is 123-45-{6789 + i % 100} ok" for i in range(n))
    r = P.digests(P.find_spans(documents(spark, [text]))).collect()[0]
    assert (r["n_email"], r["n_ip"], r["n_added"]) == (n, n, n)
    spans = [s.split(":") for s in r["spans"].split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "email"] == [f"u{i}@x.org" for i in range(n)]
    assert all(text[int(a) : int(b)].startswith("123-45-") for k, a, b in spans if k == "national_id")


def test_context_is_that_of_the_text(spark):
    texts = ["call 555-123-4567 555-123-4568 555.123.4569 ok 555-123-4570", "tel 555-123-4567", "a" * 100 + " ssn 123-45-6789" + "b" * 50, " 123-45-6789 123-45-6780 123-45-6781 123-45-6782 123-45-6783 123-45-6784 123-45-6785"]
    df = P._spans(documents(spark, texts), "s", F.col("text"), P.GENERATORS["phone_local"][0], P._GATES["phone_local"], context=True)
    df = P._spans(df, "n", F.col("text"), P.GENERATORS["national_id"][0], P._GATES["national_id"], context=True)
    seen = 0
    for r in df.collect():
        for c in [*r["s"], *r["n"]]:
            seen += 1
            assert (c["before"], c["after"]) == (r["text"][max(0, c["start"] - P.CONTEXT) : c["start"]], r["text"][c["end"] : c["end"] + P.AFTER])
    assert seen >= 12


def test_lengths_bound_the_candidates(spark):
    texts = [t for t, *_ in P.training_texts(300)] + ["x" * 64 + " (at) " + "y" * 63 + " (dot) " + "z" * 20 + " (dot) " + "z" * 20 + " (dot) " + "z" * 20, "ab at cd.ef", "GB12" + " ABCD" * 7 + " ABC"]
    found = {(c["kind"], c["end"] - c["start"]) for r in P.candidates(documents(spark, texts)).select("proposed").collect() for c in r["proposed"]}
    assert all(P._LENGTHS[k][0] <= n <= P._LENGTHS[k][1] for k, n in found) and ("email_spelled", 214) in found
