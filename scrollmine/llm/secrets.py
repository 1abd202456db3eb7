"""Secret scans: pattern spans, and random strings by the log-likelihood ratio of two character Markov models.

The base finds assigned values, access keys and long hexadecimal runs by pattern. The method adds spans of kind
`random`: every run of 16 or more key characters is scored by two second-order character Markov models, one trained
on random strings and one on ordinary identifiers and words; runs whose log-likelihood ratio passes the threshold
and that touch no base span are added. Ordinary samples are generated identifiers and a bounded sample of the
corpus's own words (SAMPLE_DOCS documents, SAMPLE_WORDS words); the threshold is set on held-out samples.

Defined cases: a null or empty text has no spans (the digest of no spans is that of the empty text); each row is
judged alone, so repeated rows repeat their result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import base_columns, batches, texts_of

KINDS = ("assign", "access", "hex", "random")
# fixed patterns of the row contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
SAMPLE_DOCS, SAMPLE_WORDS, GENERATED = 200, 20_000, 6_000
#: Nats by which a run must be likelier as a random string than the most random of the held-out ordinary ones.
MARGIN = 4.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS), in order of start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Parts of ordinary identifiers.
HEADS = ["re", "pre", "con", "de", "un", "in", "sub", "over", "inter", ""]
CORES = ["form", "port", "scrib", "duct", "struct", "press", "tract", "mit", "cess", "vert", "spect", "serv", "count", "point", "part", "order", "record", "stream", "window", "value"]
TAILS = ["er", "ing", "ed", "tion", "able", "ment", "s", "or", "ly", ""]
NAMES = """name user file path data key list map set get put open close read write start stop time date size type value index count first last next
previous parent child node text line page document string number total update delete insert create select config option default error warning message
request response server client session handler manager factory service test build run main plain camel case snake some for with and without from to is has
should could by on off all any each max min sum average buffer queue stack tree graph table column row field record schema query result cache memory disk
thread process task job worker driver executor system network socket address local remote public private static final abstract base model view control
identifier account payment invoice customer product price order shipping image video audio color width height left right top bottom background foreground
sure word words language article chapter section paragraph sentence letter question answer because through between another against during before after""".split()


def generated_samples(n: int = GENERATED, seed: int = 11) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers): labelled samples from two generators."""
    rng = np.random.default_rng(seed)
    letters = {"alnum": string.ascii_letters + string.digits, "b64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "upper": string.ascii_uppercase + string.digits, "lower": string.ascii_lowercase + string.digits, "hex": "0123456789abcdef"}
    kinds = list(letters.values())
    random = ["".join(rng.choice(list(kinds[i % len(kinds)]), int(rng.integers(16, 48)))) for i in range(n)]
    word = lambda: rng.choice(HEADS) + rng.choice(CORES) + rng.choice(TAILS) if rng.random() < 0.4 else rng.choice(NAMES)
    joins = [lambda w: "_".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "_".join(w).upper(), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w) + "_" + str(rng.integers(0, 2030))]
    ordinary = [joins[i % len(joins)]([word() for _ in range(int(rng.integers(2, 6)))]) for i in range(n)]
    return random, ordinary


class MarkovPair:
    """Second-order character models of random and ordinary strings over ALPHABET; `ratio` holds log P(random) - log P(ordinary)."""

    def __init__(self, random: list[str], ordinary: list[str], smooth: float = 0.05):
        size = len(ALPHABET)
        self.codes = np.full(128, size - 1, np.int64)
        for i, c in enumerate(ALPHABET):
            self.codes[ord(c)] = i
        tables = []
        for samples in (random, ordinary):
            three, two, one = np.zeros((size, size, size)), np.zeros((size, size)), np.zeros(size)
            for s in samples:
                x = self._codes(s)
                np.add.at(one, x, 1)
                np.add.at(two, (x[:-1], x[1:]), 1)
                np.add.at(three, (x[:-2], x[1:-1], x[2:]), 1)
            # each order backs off to the next lower one in proportion to how little it has seen
            p1 = (one + smooth) / (one.sum() + smooth * size)
            p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
            tables.append(np.log((three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)))
        self.ratio = (tables[0] - tables[1]).astype(np.float32)
        self.threshold = 0.0

    def _codes(self, s: str) -> np.ndarray:
        return self.codes[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]

    def score(self, s: str) -> float:
        """The log-likelihood ratio of a run; runs of digits alone are numbers, never keys."""
        if s.isdigit():
            return -np.inf
        x = self._codes(s)
        return float(self.ratio[x[:-2], x[1:-1], x[2:]].sum())


def fit(words: list[str]) -> MarkovPair:
    """Train on four fifths of the samples; the threshold lies MARGIN above the held-out ordinary ones."""
    random, ordinary = generated_samples()
    words = [w for w in words if 6 <= len(w) <= 60]
    cased = [f(w) for i, w in enumerate(words) for f in (str.lower, str.upper if i % 2 else str.title)]
    pairs = list(zip(words, words[1:], strict=False))[::3]
    cased += [f(a, b) for i, (a, b) in enumerate(pairs) for f in [(lambda a, b: a + b.title(), lambda a, b: f"{a}_{b}".lower(), lambda a, b: f"{a}-{b}".lower())[i % 3]]]
    held, kept = lambda xs: xs[::5], lambda xs: [x for i, x in enumerate(xs) if i % 5]
    model = MarkovPair(kept(random), kept(ordinary) + kept(cased))
    doubled = [a + b.lower() for a, b in zip(held(words), held(words)[1:], strict=False)]  # long words, as compounds have
    tops = sorted(model.score(x) for x in held(ordinary) + held(cased) + doubled if len(x) >= 16)
    model.threshold = max(0.0, tops[-1] if tops else 0.0) + MARGIN
    return model


def sample_words(docs: DataFrame, documents: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> list[str]:
    """A bounded sample of the corpus's plain words: those of the documents whose ids hash lowest."""
    ids = [r[0] for r in docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).collect()]
    if not ids:
        return []
    found = base_columns(docs, "doc_id", "text").filter(F.col("doc_id").isin(ids)).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,60}"), 0)).alias("w")).distinct()
    return sorted(r[0] for r in found.orderBy(F.xxhash64("w"), "w").limit(words).collect())


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def spans_of(text: str, model: MarkovPair) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    added = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if model.score(m[0]) > model.threshold and not any(s < b and a < e for s, e, _ in base):
            added.append((a, b, 3))
    return base, added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find_secrets(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans (code points, end exclusive)."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(sample_words(docs)))  # a table of 67**3 numbers

    def scan(it):
        own = held.value
        for batch in batches(it):
            out = []
            for doc_id, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts_of(batch), strict=True):
                base, added = spans_of(text, own)
                counts = [sum(k == i for *_, k in base) for i in range(3)]
                out.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return base_columns(docs, "doc_id", "text").mapInArrow(scan, SCHEMA)


def redact(docs: DataFrame, model: MarkovPair | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with the spans of their texts replaced, in the pass that finds them; overlapping spans become one mark.

    Each row stands for itself, so ids may be null or repeat; all other columns, whatever their names, stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(sample_words(docs)))

    def replace(it):
        own = held.value
        for batch in batches(it):
            place = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(place).to_pylist():
                base, added = spans_of(text or "", own)
                parts, at = [], 0
                for a, b, _ in sorted(base + added):
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                out.append("".join(parts) + text[at:] if parts else text)
            yield batch.set_column(place, "text", pa.array(out, pa.string()))

    return docs.mapInArrow(replace, docs.schema)
