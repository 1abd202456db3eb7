"""Quality rules by line sequence labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Each line of a text has a vector of features (symbols, upper case, digits, repeats within the text, length, end mark,
stock phrases). The field is trained here, in numpy, by the gradient of its conditional likelihood on the lines of a
bounded sample of labelled documents (SAMPLE_DOCS ids of them; of these the whole texts of up to SAMPLE_CHARS
characters); Viterbi decoding then labels the lines of every whole text, and a document is kept if the share of its
words in content lines reaches the threshold, which is set on the sample's document labels so that good documents stay.

No line is labelled by hand or by a rule: the documents' grades are the labels, and those of lines are latent. At first
every line has its document's grade, and the field tells lines apart by themselves, as a chain would learn that documents
are all of a kind. Then the field's own marginals open the lines that stand out in their document:
lines of good ones that are surely boilerplate, and lines of bad ones that are likelier content, as long as lines with
LEAST_BAD of the document's words stay boilerplate. Open lines carry no gradient of their own when it is trained again.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows repeat their result; an
empty table gives no rows, an empty table of labels a field trained on generated lines; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import base_columns, batches, texts_of

SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
#: Turns of training, the marginal beyond which a good document's line is opened, the least share of bad words in a bad one.
TURNS, SURE, LEAST_BAD = 2, 0.9, 0.5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
#: Phrases of page furniture, in lower case; one of them marks its line.
STOCK = ("all rights reserved", "copyright", "©", "licensed under", "licenced under", "cookie", "privacy policy", "terms of use", "terms of service", "subscribe", "click here", "sign up", "log in ", "login", "read more", "share this", "javascript")
FEATURES = ("bias", "symbols", "upper", "digits", "bars", "few_distinct", "repeated", "log_words", "end_mark", "stock", "long_words", "blank", "first", "last")
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 10, 20


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at exactly the contract's white space
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    repeats = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                repeats += bool(line.strip(_SPACES))
            else:
                seen.add(line)
    return len(words), chars, symbols, repeats, repeat_words(words)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in windows of `width` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint64, len(words))
    bits = max(1, len(known) - 1).bit_length()
    if bits * width <= 64:
        key = np.zeros(n, np.uint64)
        for i in range(width):
            key = (key << np.uint64(bits)) | ids[i : i + n]
        _, first, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:  # ids too wide for one number: pairs of windows are numbered first
        left = ids[:-1] * np.uint64(len(known)) + ids[1:]
        two = np.unique(left, return_inverse=True)[1].astype(np.uint64)
        four = np.unique(two[:-2] * np.uint64(len(two)) + two[2:], return_inverse=True)[1].astype(np.uint64)
        _, first, counts = np.unique(four[:n] * np.uint64(len(known)) + ids[4 : 4 + n], return_inverse=True, return_counts=True)
    again = counts[first] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < BASE_MIN_WORDS or 100 * n_repeat > BASE_REPEAT_PERCENT * n_words


def _character_classes() -> np.ndarray:
    """Bits for each Latin-1 character: 1 symbol, 2 upper case, 4 letter, 8 digit, 16 bar, 32 white space."""
    table = np.zeros(256, np.uint8)
    for i in range(256):
        c = chr(i)
        table[i] = (c in SYMBOLS + "!") + 2 * c.isupper() + 4 * c.isalpha() + 8 * c.isdigit() + 16 * (c == "|") + 32 * (c in _SPACES)
    return table


_CLASSES = _character_classes()


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, words of each line). Characters beyond Latin-1 count as none of the classes."""
    classes = _CLASSES[np.frombuffer("\n".join([*lines, ""]).encode("latin-1", "replace"), np.uint8)]
    sizes = np.array([len(x) + 1 for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    count = lambda bit: np.add.reduceat((classes & bit) != 0, starts, dtype=np.int64)
    size = np.maximum(1, sizes - count(32))
    split = [x.split() for x in lines]
    counts = np.array([len(w) for w in split], np.int64)
    n = np.maximum(1, counts)
    distinct = np.array([len(set(w)) for w in split], np.int64) / n
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    ends = [w[-1][-1] in ".!?:;\"'”…" if w else False for w in split]
    out = np.zeros((len(lines), len(FEATURES)))
    out[:, 1] = np.minimum(1, 4 * count(1) / size)
    out[:, 2] = count(2) / np.maximum(1, count(4))
    out[:, 3] = np.minimum(1, 3 * count(8) / size)
    out[:, 4] = np.minimum(1, 6 * count(16) / n)
    out[:, 5] = np.where(counts >= 8, np.maximum(0, 1 - 2 * distinct), 0)
    out[:, 6] = np.array([seen[x] > 1 for x in lines]) * np.minimum(1, counts / 8)
    out[:, 7] = np.log1p(counts) / 5
    out[:, 8] = ends
    text = "\n".join(lines).lower()
    if found := [p for p in STOCK if p in text]:
        out[:, 9] = [any(p in x for p in found) for x in text.split("\n")]
    out[:, 10] = np.maximum(0, size / n - 8) / 8
    out[counts == 0] = 0
    out[:, 0] = 1
    out[:, 11] = counts == 0
    out[0, 12] = out[-1, 13] = 1
    return out, counts


class LineField:
    """A linear-chain conditional random field with two labels: 0 content, 1 boilerplate."""

    def __init__(self):
        self.emit = np.zeros((len(FEATURES), 2))
        self.move = np.zeros((2, 2))
        self.threshold = 0.5

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.15, ridge: float = 0.0002, stiff: float = 0.01, chained: bool = True) -> LineField:
        """Ascend the conditional likelihood by Adam; sequences are (features, labels with -1 for open lines). Unchained, lines are
        told apart by themselves: the moves stay as they are. `stiff` holds moves back, as documents of one kind would make
        the chain call a whole text what most of its lines are."""
        sequences = [s for s in sequences if len(s[0])]
        if not sequences:
            return self
        longest, count = max(len(x) for x, _ in sequences), len(sequences)
        feats, allowed, mask = np.zeros((count, longest, len(FEATURES))), np.zeros((count, longest, 2)), np.zeros((count, longest), bool)
        for k, (x, y) in enumerate(sequences):
            feats[k, : len(x)], mask[k, : len(x)] = x, True
            allowed[k, : len(x)] = np.where(y[:, None] < 0, 0, np.where(y[:, None] == np.arange(2), 0, -1e9))
        theta, m, v = np.concatenate([self.emit.ravel(), self.move.ravel()]), 0.0, 0.0
        for step in range(1, rounds + 1):
            emit, move = theta[: self.emit.size].reshape(self.emit.shape), theta[self.emit.size :].reshape(2, 2)
            scores = feats @ emit
            marginals = _marginals if chained else _alone
            free, clamped = marginals(scores, move, mask), marginals(scores + allowed, move, mask)
            gradient = np.concatenate([np.einsum("ktf,ktl->fl", feats, clamped[0] - free[0]).ravel(), (clamped[1] - free[1]).ravel()]) / mask.sum() - np.repeat([ridge, stiff], [self.emit.size, 4]) * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.emit, self.move = theta[: self.emit.size].reshape(self.emit.shape), theta[self.emit.size :].reshape(2, 2)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a text's lines (Viterbi)."""
        scores = x @ self.emit
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b, back = *scores[0].tolist(), []
        for p, q in scores[1:].tolist():
            from_a = (a + m00 >= b + m10, a + m01 >= b + m11)
            back.append(from_a)
            a, b = p + (a + m00 if from_a[0] else b + m10), q + (a + m01 if from_a[1] else b + m11)
        label = int(b > a)
        labels = [label]
        for from_a in reversed(back):
            label = 0 if from_a[label] else 1
            labels.append(label)
        return np.array(labels[::-1])

    def content_share(self, text: str) -> tuple[float, int, int]:
        """(share of the words in content lines, lines, boilerplate lines)."""
        lines = text.split("\n")
        x, counts = line_features(lines)
        labels = self.decode(x)
        total = counts.sum()
        return (float(counts[labels == 0].sum() / total) if total else 0.0), len(lines), int(((labels == 1) & (counts > 0)).sum())


def _marginals(scores: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: label marginals (k, t, 2) and expected moves (2, 2)."""
    count, longest, _ = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, longest):
        moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + move[None], axis=1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        moved = np.logaddexp.reduce(move[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None], moved, 0.0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    label = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
    pairs = np.zeros((2, 2))
    for t in range(1, longest):
        p = forward[:, t - 1, :, None] + move[None] + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
        pairs += (np.exp(p) * mask[:, t, None, None]).sum(0)
    return label, pairs


def _alone(scores: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _marginals() gives without moves, and none to learn from."""
    p = np.exp(scores - scores.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True) * mask[..., None], np.zeros_like(move)


def generated_lines(seed: int = 3, count: int = 120) -> list[tuple[str, int]]:
    """Texts with a document label (1 good), for tables without labels."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeiou"), 1)[0] + rng.choice(list("bcdlmnrst"), 1)[0] for _ in range(int(rng.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(8, 40)))).capitalize() + "."
    junk = [lambda: " ".join(f"{word()}{rng.choice(list('#%&*$')) * 3}" for _ in range(20)), lambda: " | ".join(word() for _ in range(15)), lambda: " ".join(word().upper() + "!!" for _ in range(15)), lambda: " ".join([word()] * 60)]
    return [("\n".join(prose() for _ in range(6)), 1) if i % 2 else ("\n".join([prose(), *(junk[(i // 2) % 4]() for _ in range(5))]), 0) for i in range(count)]


def _opened(field: LineField, x: np.ndarray, counts: np.ndarray, good: int) -> np.ndarray:
    """The lines' labels by their document's grade, -1 for those that the field holds for the other kind."""
    p = _marginals((x @ field.emit)[None], field.move, np.ones((1, len(x)), bool))[0][0][:, 1]
    if good:
        return np.where((counts > 0) & (p <= SURE), 0, -1)
    order = np.argsort(-p, kind="stable")
    needed = np.zeros(len(x), bool)
    needed[order] = np.cumsum(counts[order]) - counts[order] < LEAST_BAD * counts.sum()
    return np.where((counts > 0) & (needed | (p >= 0.5)), 1, -1)


def fit(labelled: list[tuple[str, int]]) -> LineField:
    """Train the field and its threshold on (text, 1 good or 0 bad)."""
    labelled = labelled or generated_lines()
    graded = [(*line_features(text.split("\n")), good) for text, good in labelled if text.strip(_SPACES)]
    labels, field = [np.where(counts > 0, 0 if good else 1, -1) for _, counts, good in graded], LineField()
    for turn in range(TURNS):
        if turn:
            labels = [_opened(field, *g) for g in graded]
        field.fit([(x, y) for (x, _, _), y in zip(graded, labels, strict=True)], chained=turn > 0)
    shares = [(field.content_share(text)[0], good) for text, good in labelled if text.strip(_SPACES)]
    good = np.array(sorted(s for s, g in shares if g) or [1.0])
    bad = np.array([s for s, g in shares if not g] or [0.0])
    # no more than one good document in 200 may go; within that, the best split of the labels
    limit = good[int(len(good) * 0.005)]
    cuts = np.unique(np.concatenate([[0.3], good, bad]))
    cuts = cuts[cuts <= min(limit, 0.9)]
    if len(cuts):
        right = [(good >= c).mean() + (bad < c).mean() for c in cuts]
        best = int(np.argmax(right))
        below = bad[bad < cuts[best]]
        field.threshold = float((cuts[best] + below.max()) / 2 if len(below) else cuts[best])
    return field


def sample_labelled(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCS) -> list[tuple[str, int]]:
    """A bounded sample: the labelled documents whose ids hash lowest, as many good ones as bad ones where there are."""
    known = labels.select("doc_id", "quality").dropna()
    picked = []
    for quality in (0, 1):
        picked += known.filter(F.col("quality") == quality).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents // 2).collect()
    ids = [r[0] for r in picked]
    if not ids:
        return []
    texts = base_columns(docs, "doc_id", "text").filter(F.col("doc_id").isin(ids) & (F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS))
    by_id = {r["doc_id"]: r["text"] or "" for r in texts.collect()}  # a row for each of at most SAMPLE_DOCS ids; repeats overwrite
    grades = {r["doc_id"]: r["quality"] for r in known.filter(F.col("doc_id").isin(ids)).collect()}
    return [(by_id[i], int(grades[i])) for i in sorted(by_id)]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_boilerplate_lines long, content_share double"
_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]


def _judge(text: str, field: LineField) -> tuple:
    counts = base_counts(text)
    failed = base_failed(counts[0], counts[4])
    share, lines, boilerplate = field.content_share(text)
    return (*counts, failed, not failed and share >= field.threshold, lines, boilerplate, share)


def judge(docs: DataFrame, field: LineField) -> DataFrame:
    """One row per document: base counts, the base verdict, and the verdict with the field's."""
    held = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen numbers

    def run(it):
        own = held.value
        for batch in batches(it):
            rows = [(i, *_judge(t, own)) for i, t in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return base_columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(it):
        own = held.value
        for batch in batches(it):
            yield batch.filter(pa.array([_judge(t, own)[6] for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
