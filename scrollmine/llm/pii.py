"""Personal data: pattern spans, and further spans chosen by boosted trees among overlapping candidates.

The base finds e-mail addresses, IPv4 addresses, card numbers and international phone numbers by pattern and check
digits. The method adds spans: generators that miss little (GENERATORS) propose spans that may overlap, features of their
format and context go to gradient-boosted trees, and calibrated probabilities above a kind's threshold select them;
one that overlaps a likelier one goes, and none may touch a base span.

Everything over the documents is built of DataFrame functions. Positions come from splitting a text at its matches:
the gaps' and matches' lengths alternate, so their running sums are the spans. Patterns have no nested repetition
(a long run can't overflow Java's stack) and begin where a run begins (a long run isn't tried from each character).
The trees are trained here, in numpy on the driver, from a generated set of labelled texts (TRAINING of them) whose
features the same DataFrame functions compute; then they are one expression.

Defined cases: a null or empty text has no spans; repeated rows repeat their result; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base_columns

BASE = ("email", "ip", "card", "phone")
#: Candidate generators: kind, pattern, the words of context that speak for it. Fixed repetitions only.
GENERATORS = {
    "email_spelled": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]|\{at\}|at|AT) ?[A-Za-z0-9-]{2,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|dot|DOT|\.) ?[A-Za-z0-9-]{2,20}+){1,3}+", "mail|contact|write|reach|address"),
    "phone_local": (r"(?<![0-9A-Za-z.-])\(?[0-9]{3,4}+\)?[ ./-][0-9]{3,4}+[ ./-]?[0-9]{3,4}+(?![0-9A-Za-z])", "phone|tel|call|fax|mobile|cell|dial|whatsapp"),
    "national_id": (r"(?<![0-9A-Za-z.-])[0-9]{3}+[- ][0-9]{2}+[- ][0-9]{4}+(?![0-9A-Za-z-])", "ssn|social|security|id|tax|insurance"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}+[0-9]{2}+(?: ?[A-Z0-9]{4}+){3,7}+(?: ?[A-Z0-9]{1,3}+)?(?![0-9A-Za-z])", "iban|bank|account|transfer|konto|cuenta|compte"),
}
#: Cheap tests that a text must pass before a pattern runs over it: every match of the pattern passes its test.
_GATES = {
    "email": "[A-Za-z0-9-]@[A-Za-z0-9-]|[._%+]@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": "[0-9](?:[ -]?[0-9]){15}",
    "phone": r"\+[0-9]",
    # the generator from its at on: a bare one follows a space, or a local part of the full 64 characters
    "email_spelled": r"(?:\(at\)|\[at\]|\{at\}|(?:at|AT)(?<=(?: |[A-Za-z0-9._%+-]{64})(?:at|AT))) ?[A-Za-z0-9-]{2,63}+ ?(?:\(dot\)|\[dot\]|\{dot\}|dot|DOT|\.) ?[A-Za-z0-9-]{2}",
    "phone_local": r"[0-9]{3}\)?[ ./-][0-9]{3}",
    "national_id": "[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}",
    "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
}
_MARK, _OTHER = "﷐", "﷑"
CONTEXT, AFTER = 40, 12
#: The fewest and the most characters of a candidate of each generator: its pattern's bounds.
_LENGTHS = {"email_spelled": (9, 214), "phone_local": (10, 16), "national_id": (11, 11), "iban": (16, 43)}
SHORTEST, LONGEST = min(a for a, _ in _LENGTHS.values()), max(b for _, b in _LENGTHS.values())
#: Candidates beside one, in order of their starts, among which all that overlap it stand: those of a generator don't
#: overlap each other, so no more of them than this begin within LONGEST characters.
NEAR = sum(LONGEST // a + 1 for a, _ in _LENGTHS.values())
#: Base spans that are looked through together.
CHUNK = 64
TRAINING, ROUNDS, DEPTH, RATE = 1200, 40, 3, 0.3
#: The least share of truth among held-out training spans at or above a kind's threshold.
PRECISION = 0.97


def _marked(text: Column, pattern: str) -> Column:
    """text with each match of a one-character pattern replaced by a mark, so that lengths stay."""
    return F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, _MARK)


def _base_view(kind: str, text: Column) -> tuple[Column, str]:
    """(a text of the same length, the pattern to find in it): the contract's pattern without nested repetition."""
    if kind == "email":  # a dot that no label follows ends a domain
        local = rf"A-Za-z0-9._%+\-{_MARK}"
        return _marked(text, r"\.(?![A-Za-z0-9-])"), rf"(?:(?<![{local}])|\G)[{local}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
    if kind == "card":  # a separator stays only between two digits
        return _marked(text, "[ -](?![0-9])|(?<![0-9])[ -]"), "[0-9][0-9 -]++"
    if kind == "ip":
        return text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    return text, r"\+[0-9][ ().0-9-]+[0-9]"


def _running(df: DataFrame, lengths: str, name: str, block: int = 64) -> DataFrame:
    """df with `name`: the sum of the elements before each element of an array, in blocks so that long arrays don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    n = F.size(lengths)
    df = df.withColumn("__blocks", F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(lengths, b * block + 1, block)))))
    df = df.withColumn("__blocks", F.aggregate("__blocks", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)))
    # a column of its own: read in two places, it isn't merged into the lambda, where each element would compute it again
    start = lambda i: F.get("__blocks", F.floor(i / block).cast("int")) + total(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block))
    return df.withColumn(name, F.when((n > 0) & (F.size("__blocks") > 0), F.transform(F.sequence(F.lit(0), n - 1), start))).drop("__blocks")


_SPANS = "array<struct<start:int,end:int,found:string>>"


def _around(i: Column) -> list[Column]:
    """`before` and `after`: the CONTEXT and AFTER characters beside match i, put together of the matches and gaps beside
    it, as finding a character by its number walks through a long text. Matches have SHORTEST characters or more."""
    part = lambda name, k: F.coalesce(F.get(name, i + k), F.lit(""))
    back, ahead = -(-CONTEXT // SHORTEST), -(-AFTER // SHORTEST)
    gap = lambda k: F.right(part("__gaps", k), F.lit(CONTEXT))
    before = F.concat(*(x for k in range(-back, 0) for x in (gap(k), part("__hits", k))), gap(0))
    after = F.concat(*(x for k in range(1, ahead + 1) for x in (F.left(part("__gaps", k), F.lit(AFTER)), part("__hits", k))))
    return [F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(AFTER)).alias("after")]


def _spans(df: DataFrame, name: str, view: Column, pattern: str, gate: str, context: bool = False) -> DataFrame:
    """df with column `name`: the spans of the pattern's matches in view (same length as text), with their text and, on
    demand, what stands beside them."""
    on = F.col("text").rlike(gate)
    df = df.withColumn("__view", F.when(on, view))
    df = df.withColumn("__hits", F.regexp_extract_all("__view", F.lit(pattern), F.lit(0)))
    df = df.withColumn("__gaps", F.when(F.size("__hits") > 0, F.split("__view", pattern, -1)))
    # lengths of gap and match by turns; a match begins after all that stands before it
    df = df.withColumn("__steps", F.when(F.size("__hits") > 0, F.zip_with(F.slice("__gaps", 1, F.size("__hits")), "__hits", lambda g, h: F.length(g) + F.length(h))))
    df = _running(df, "__steps", "__before")
    span = lambda h, i: F.struct((F.get("__before", i) + F.get("__steps", i) - F.length(h)).alias("start"), (F.get("__before", i) + F.get("__steps", i)).alias("end"), h.alias("found"), *(_around(i) if context else []))
    kind = _SPANS.replace("found:string", "found:string,before:string,after:string") if context else _SPANS
    return df.withColumn(name, F.coalesce(F.when(F.col("__steps").isNotNull(), F.transform("__hits", span)), F.array().cast(kind))).drop("__view", "__hits", "__gaps", "__steps", "__before")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.reverse(digits)
    doubled = lambda i: F.substring(reverse, i, F.lit(1)).cast("int") * (2 - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


FEATURES = ("generator", "length", "digits", "letters", "separators", "separator_kinds", "distinct", "luhn", "cue", "other_cue", "colon_before", "number_before", "unit_after", "brackets", "line_start", "upper")


def _features(generator: int, c: Column) -> Column:
    """A candidate's features as an array of doubles, in the order of FEATURES."""
    found, before, after = c["found"], F.lower(c["before"]), F.lower(c["after"])
    cues = list(GENERATORS.values())
    own = cues[generator][1]
    others = "|".join(x for i, (_, x) in enumerate(cues) if i != generator) + "|order|invoice|ticket|version|isbn|serial|page|ref|date|article|sku"
    seps = F.regexp_replace(found, "[A-Za-z0-9]", "")
    values = [
        F.lit(generator), F.length(found), F.length(_digits(found)), F.length(F.regexp_replace(found, "[^A-Za-z]", "")), F.length(seps),
        F.size(F.array_distinct(F.split(seps, ""))), F.size(F.array_distinct(F.split(_digits(found), ""))),
        F.when(F.length(_digits(found)) >= 9, _luhn(_digits(found)).cast("int")).otherwise(0),
        before.rlike(rf"\b(?:{own})").cast("int"), before.rlike(rf"\b(?:{others})").cast("int"), before.rlike(r"[:=#] ?$").cast("int"), before.rlike(r"[0-9][ ,.]*$").cast("int"),
        after.rlike("^ ?(?:usd|eur|kg|km|cm|mm|ms|%|pages?|items?|[$€£])").cast("int"), found.rlike(r"[()\[\]{}]").cast("int"), (before.rlike(r"(?:^|\n)\s*$")).cast("int"), F.length(F.regexp_replace(found, "[^A-Z]", "")),
    ]
    return F.array(*(v.cast("double") for v in values))


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with `proposed`: array of (kind, start, end, x) from all generators, overlaps and all."""
    df = docs
    for kind, (pattern, _) in GENERATORS.items():
        df = _spans(df, f"__{kind}", F.col("text"), pattern, _GATES[kind], context=True)

    def part(i: int, kind: str) -> Column:
        return F.transform(f"__{kind}", lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _features(i, c).alias("x")))

    return df.withColumn("proposed", F.concat(*(part(i, kind) for i, kind in enumerate(GENERATORS)))).drop(*(f"__{kind}" for kind in GENERATORS))


# --- boosted trees -------------------------------------------------------------------------------------------------


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree for the second-order loss: a leaf's weight, or (feature, cut, left, right) with x <= cut to the left."""
    g, h = gradient.sum(), hessian.sum()
    weight = float(g / (h + 1.0))
    if depth == 0 or len(x) < 8:
        return weight
    best = (1e-3, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            gl, hl = gradient[left].sum(), hessian[left].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, (f, float(cut)))
    if best[1] is None:
        return weight
    f, cut = best[1]
    left = x[:, f] <= cut
    return (f, cut, _grow(x[left], gradient[left], hessian[left], depth - 1), _grow(x[~left], gradient[~left], hessian[~left], depth - 1))


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _walk(left, x), _walk(right, x))


class Boosted:
    """Boosted trees for the logistic loss, a calibration of their margin, and a threshold for each generator."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        held = np.arange(len(x)) % 4 == 0
        fit_x, fit_y = x[~held], y[~held]
        share = np.clip(fit_y.mean(), 0.01, 0.99)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(fit_x), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(fit_x, fit_y - p, p * (1 - p), DEPTH)
            self.trees.append(tree)
            margin += RATE * _walk(tree, fit_x)
        # calibration on the held-out quarter: a logistic curve of the margin, by Newton's method
        m, t = self.margin(x[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-6
            g = np.array([((t - p) * m).sum() - 0.01 * (a - 1), (t - p).sum()])
            hess = np.array([[(w * m * m).sum() + 0.01, (w * m).sum()], [(w * m).sum(), w.sum()]])
            a, b = np.array([a, b]) + np.linalg.solve(hess + 1e-6 * np.eye(2), g)
        self.slope, self.shift = float(max(a, 0.05)), float(b)
        p = self.probability(x[held])
        self.thresholds = []
        for g in range(len(GENERATORS)):
            own = x[held][:, 0] == g
            cuts = [c for c in np.unique(np.round(p[own], 3)) if c >= 0.5 and (own & (p >= c)).any() and t[own & (p >= c)].mean() >= PRECISION]
            self.thresholds.append(float(min(cuts)) if cuts else 0.99)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + RATE * sum(_walk(tree, x) for tree in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def expression(self, x: Column) -> Column:
        """The calibrated probability as one expression over an array of features."""

        def nest(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, cut, left, right = tree
            return F.when(F.get(x, F.lit(f)) <= cut, nest(left)).otherwise(nest(right))

        margin = F.lit(self.start)
        for tree in self.trees:
            margin = margin + RATE * nest(tree)
        return 1 / (1 + F.exp(-(self.slope * margin + self.shift)))


def training_texts(n: int = TRAINING, seed: int = 8) -> list[tuple[str, int, int, int]]:
    """(text, start, end, truth): generated sentences around one span that is personal data (1) or only looks like it (0)."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randrange(2, 9)))
    name = lambda: rnd.choice([word(), word() + "." + word(), word() + digits(2)])
    letters = lambda k: "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(k))

    def iban() -> str:
        body = digits(rnd.choice((14, 16, 18, 20)))
        whole = letters(2) + digits(2) + body
        return whole if rnd.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    phone = lambda: rnd.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))
    spelled = lambda at, dot: f"{name()}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net', 'de', 'fr'])}"
    true = [
        lambda: (rnd.choice(["mail: ", "contact ", "write to ", "reach me: ", ""]), spelled(*rnd.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", ".")]))),
        lambda: (rnd.choice(["phone: ", "tel. ", "call ", "fax ", "mobile ", "my cell is "]), phone()),
        lambda: (rnd.choice(["SSN ", "social security number ", "tax id: ", "ssn: "]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (rnd.choice(["IBAN ", "IBAN: ", "bank account ", "transfer to ", "konto "]), iban()),
    ]
    false = [
        lambda: (rnd.choice(["we met ", "they look ", ""]), f"{word()} at {word()} {rnd.choice(['dot', '.'])} {word()}"),
        lambda: (rnd.choice(["order ", "invoice no. ", "ticket ", "version ", "serial ", "ref: ", "page ", "sku ", ""]), rnd.choice([phone, lambda: f"{digits(4)} {digits(4)}{digits(3)}", lambda: f"{digits(4)}-{digits(4)}"])()),
        lambda: (rnd.choice(["article ", "ref ", "isbn ", "order ", ""]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (rnd.choice(["serial ", "code ", "model ", "sku "]), letters(2) + digits(2) + " ".join(letters(4) for _ in range(rnd.randrange(3, 5)))),
    ]
    out = []
    for i in range(n):
        cue, span = rnd.choice(true if i % 2 else false)()
        head = " ".join(word() for _ in range(rnd.randrange(0, 12)))
        text = f"{head} {cue}{span}"
        tail = rnd.choice(["", ".", ", ", " " + word()]) + " " + " ".join(word() for _ in range(rnd.randrange(0, 12)))
        out.append((text + tail, len(text) - len(span), len(text), i % 2))
    return out


_fitted: dict[int, Boosted] = {}


def fit(spark: SparkSession, texts: int = TRAINING) -> Boosted:
    """Train on the generated texts: a bounded table of `texts` rows, whose candidates come to the driver. Once a process."""
    if texts not in _fitted:
        rows = training_texts(texts)
        table = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
        found = candidates(table).select("doc_id", F.explode_outer("proposed").alias("c")).filter("c is not null").select("doc_id", "c.kind", "c.start", "c.end", "c.x").collect()
        found.sort(key=lambda r: (r["doc_id"], r["kind"], r["start"]))
        truth = [float(rows[r["doc_id"]][3] and r["start"] < rows[r["doc_id"]][2] and rows[r["doc_id"]][1] < r["end"]) for r in found]
        _fitted[texts] = Boosted(np.array([r["x"] for r in found]), np.array(truth))
    return _fitted[texts]


# --- the operator --------------------------------------------------------------------------------------------------


def find_spans(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(doc_id, text, base, added): arrays of (kind, start, end) in order of kind as listed, then start."""
    model = model or fit(docs.sparkSession)
    df = base_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    for kind in BASE:
        view, pattern = _base_view(kind, F.col("text"))
        df = _spans(df, f"__{kind}", view, pattern, _GATES[kind])
    named = lambda kind: F.transform(F.filter(f"__{kind}", lambda c: _valid(kind, c["found"])), lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    df = candidates(df.withColumn("base", F.concat(*(named(k) for k in BASE))).drop(*(f"__{k}" for k in BASE)))
    scored = F.transform("proposed", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.get(c["x"], F.lit(0)).cast("int").alias("g"), model.expression(c["x"]).alias("p")))
    df = df.withColumn("scored", F.when(F.size("proposed") > 0, scored)).drop("proposed")
    limit = F.array(*(F.lit(t) for t in model.thresholds))
    # base spans in chunks of neighbours, so that a candidate looks through few of them in a text with many
    df = df.withColumn("__sorted", F.sort_array(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))))
    chunk = lambda k: F.slice("__sorted", k * CHUNK + 1, CHUNK)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__sorted") - 1) / CHUNK).cast("int")), lambda k: F.struct(k.alias("k"), F.get("__sorted", k * CHUNK)["start"].alias("start"), F.array_max(F.transform(chunk(k), lambda b: b["end"])).alias("end")))
    df = df.withColumn("__chunks", F.when(F.size("__sorted") > 0, chunks))
    meets = lambda a, c: (a["start"] < c["end"]) & (c["start"] < a["end"])
    free = lambda c: ~F.coalesce(F.exists("__chunks", lambda k: meets(k, c) & F.exists(chunk(k["k"]), lambda b: meets(b, c))), F.lit(False))
    likely = F.filter("scored", lambda c: (c["p"] >= F.get(limit, c["g"])) & free(c))
    df = df.withColumn("likely", F.when(F.size("scored") > 0, F.sort_array(likely))).drop("scored", "__sorted", "__chunks")
    likelier = lambda o, c: (o["p"] > c["p"]) | ((o["p"] == c["p"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["g"] < c["g"]))))
    stays = lambda c, i: ~F.exists(F.slice("likely", F.greatest(i + 1 - NEAR, F.lit(1)), F.lit(2 * NEAR + 1)), lambda o: meets(o, c) & likelier(o, c))
    added = F.transform(F.array_sort(F.filter("likely", stays), lambda a, b: F.when(a["g"] != b["g"], a["g"] - b["g"]).otherwise(a["start"] - b["start"])), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return df.withColumn("added", F.coalesce(F.when(F.size("likely") > 0, added), empty)).select("doc_id", "text", "base", "added")


def digests(found: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redacted(found: DataFrame) -> DataFrame:
    """(doc_id, text) with every span of base and added replaced by [kind]; where spans overlap, the first stands for both."""
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    done = F.aggregate(spans, start, step)
    return found.withColumn("done", done).select("doc_id", F.concat(F.col("done.out"), F.expr("substring(text, done.at + 1)")).alias("text"))
