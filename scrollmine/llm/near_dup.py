"""Near-duplicate detection: banded MinHash candidates, odd-sketch estimates, exact confirmation, components.

A text's set holds its distinct five-word shingles as 64-bit hashes (A-Z in lower case). Equal sets are one node
from the start, so exact copies cost nothing further. A node has SAMPLES MinHash values: BANDS bands of ROWS values
are its bucket keys, and all of them fold into an odd sketch, a bitmap in which every (place, value) flips one bit.
The bits in which two sketches differ estimate the similarity of their sets precisely where it is high; only pairs
whose estimate reaches ESTIMATE (over five standard deviations below the threshold) go on. A second odd sketch folds
the set itself, or of a set over MARKED shingles those whose smallest bits are zero, as many bits as bring it below
MARKED (its level). Its differing bits never outnumber the shingles in which two sets differ, so for sets up to MARKED
it rejects without a loss, and near the threshold almost everything below it: only what is left is confirmed on full sets.

No bucket emits all its pairs. In a first round every node of a bucket is paired with the bucket's first node (the
hub), linked pairs become components, and then only nodes outside the component of their bucket's hub ("outsiders")
are compared within the bucket, the sketch being a condition of that join; buckets with many outsiders take further
hubs before that. So every candidate pair is either tested or lies in one component already: nothing is capped.

A pair with similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32 = 5.2e-6, and its sketches differ in
more than MOST_DIFFERING bits with probability 2.2e-7: together it is missed with probability 5.4e-6 at most. Sets over
MARKED shingles add less than 2e-7, the chance that a sample has six standard deviations more than it is expected to.

Defined cases: texts without words (or null) have an empty set, no links, and are their own component; repeated rows
are equal sets; a null doc_id takes the smallest doc_id of its component (null if there is none) and is kept only if
that is null; an empty table gives no rows; other columns are ignored. The report names documents by doc_id alone;
keep_one() tells rows apart, so of repeated rows one stays, whatever their ids are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base_columns, batches, fresh, materialize, release, texts_of

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
ESTIMATE = 0.5
#: The second sketch: its bits, the most shingles that it folds, and the standard deviations left to samples.
MARK_BITS, MARKED, DEVIATIONS = 1024, 512, 6
#: Buckets with more outsiders than this take another hub; after HUB_ROUNDS hubs the join compares what is left.
OUTSIDERS, HUB_ROUNDS = 512, 6
#: Ids of candidates are broadcast to the scan of the texts up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 500_000
#: Hashes of words that a Python worker remembers, some 20 MB.
MAX_WORDS = 100_000

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**64, (SAMPLES, 1), np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, (SAMPLES, 1), np.uint64)
_PLACE = _rng.integers(0, 2**64, SAMPLES, np.uint64) | np.uint64(1)
_POSITION = _rng.integers(0, 2**64, WIDTH, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit integers: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_WORDS:
            self[word] = value
        return value


_words = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; the words of a shorter text are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() is A-Z alone, bytes.split() the contract's white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        total += h[i : i + n] * _POSITION[i]
    return np.unique(_mix(total))


def minhash(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), block):
        np.minimum(low, (shingles[None, at : at + block] * _MULTIPLY + _ADD).min(axis=1), out=low)
    return low


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits over the (place, value) pairs, as signed 64-bit integers."""
    bits = _mix(values * _PLACE + _PLACE) % np.uint64(SKETCH_BITS)
    parity = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view("<i8")


def level_of(size: int) -> int:
    """How often the shingles of a set of that size are halved until MARKED are expected at most."""
    return max(0, (size - 1) // MARKED).bit_length()


def marks(shingles: np.ndarray) -> np.ndarray:
    """Odd sketches of the set at its level and at the next one, for a partner whose level is higher by one."""
    out = []
    for level in (level_of(len(shingles)), level_of(len(shingles)) + 1):
        own = shingles[(shingles & np.uint64((1 << level) - 1)) == 0] >> np.uint64(level)
        parity = np.bincount((_mix(own) % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
        out.append(np.packbits(parity.astype(np.uint8)).view("<i8"))
    return np.concatenate(out)


def band_keys(values: np.ndarray) -> np.ndarray:
    parts = _mix(values).reshape(BANDS, ROWS) * _POSITION[:ROWS]
    return _mix(parts.sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[:BANDS]).view(np.int64)


def estimate(differing: int, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """The similarity for which sketches are expected to differ in that many bits."""
    return 1 + bits / (4 * samples) * math.log(max(1e-9, 1 - 2 * differing / bits))


#: The most differing bits of a pair whose estimate reaches ESTIMATE.
MOST_DIFFERING = max(m for m in range(SKETCH_BITS // 2) if estimate(m) >= ESTIMATE)

_SIGNED = "doc_id long, row long, n_shingles long, set_key string, bands array<long>, sketch array<long>, level int, marks array<long>"


def _sign(it):
    for batch in batches(it):
        out = []
        for text in texts_of(batch):
            s = shingle_set(text)
            if not len(s):
                out.append((0, None, None, None, None, None))
                continue
            values = minhash(s)
            out.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), band_keys(values), odd_sketch(values), level_of(len(s)), marks(s)))
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        longs = pa.list_(pa.int64())
        own = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), longs, longs, pa.int32(), longs), strict=True)]
        yield pa.RecordBatch.from_arrays([column("doc_id"), column("row"), *own], names=[x.split()[0] for x in _SIGNED.split(", ")])
    _words.clear()  # so that a worker that is used again doesn't hold it beside the next task's memory


def _confirm(it):
    cached: tuple[int, np.ndarray] | None = None
    for batch in batches(it):
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("a", "b", "text_a", "text_b")]
        a, b, keep = [], [], []
        for x, y, s, t in zip(*columns, strict=True):
            if cached is None or cached[0] != y:
                cached = (y, shingle_set(t))
            own = shingle_set(s)
            both = len(np.intersect1d(own, cached[1], assume_unique=True))
            a.append(x)
            b.append(y)
            keep.append(100 * both >= PERCENT * (len(own) + len(cached[1]) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep))
    _words.clear()


def _own_sets(it):
    """The rows whose text has the node's set: a doc_id may stand on several rows."""
    for batch in batches(it):
        keys = batch.column(batch.schema.get_field_index("set_key")).to_pylist()
        mine = [xxhash.xxh3_128_hexdigest(shingle_set(t).tobytes()) == k for t, k in zip(texts_of(batch), keys, strict=True)]
        yield batch.select(["node", "text"]).filter(pa.array(mine, pa.bool_()))


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold, from the whole texts of those nodes alone."""
    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc_id", "set_key"), "node"), "near-wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    found = base_columns(docs, "doc_id", "text").join(ids.withColumnRenamed("doc_id", "wanted_id"), F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    texts = materialize(found.select("node", "text", "set_key").mapInArrow(_own_sets, "node long, text string"), "near-texts")
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    links = materialize(pairs.join(left, "a").join(right, "b").mapInArrow(_confirm, "a long, b long"), "near-links")
    release(wanted, texts)
    return links


def components(links: DataFrame, label: str = "near-components") -> DataFrame:
    """(node, comp): the smallest node that each linked node reaches, by alternating large and small stars.

    Every step groups edges by a node with a partial minimum and writes its result; stars need two or three rounds.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), label)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        done, edges = edges, materialize(small, label)
        release(done, large)
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _differing(x: str, y: str, bits: int, from_x: Column | int = 0, from_y: Column | int = 0) -> Column:
    """Bits in which two sketch columns differ, word by word, so that the join's condition is compiled code."""
    word = lambda name, at: F.get(name, at if isinstance(at, Column) else F.lit(at))
    total = F.lit(0)
    for i in range(bits // 64):
        total = total + F.bit_count(word(x, from_x + i).bitwiseXOR(word(y, from_y + i))).cast("int")
    return total


def _alike(x: str, y: str) -> Column:
    """Sizes and sketches allow the threshold."""
    size_x, size_y, level_x, level_y = F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles"), F.col(f"{x}level"), F.col(f"{y}level")
    sizes = 100 * F.least(size_x, size_y) >= PERCENT * F.greatest(size_x, size_y)  # so levels differ by one at most
    # sets at the threshold differ in (size_x + size_y) * (1 - s) / (1 + s) shingles
    level = F.greatest(level_x, level_y)
    most = (size_x + size_y) * (100 - PERCENT) / F.lit(100.0 + PERCENT) / F.pow(F.lit(2.0), level)
    allowed = most + F.when(level > 0, DEVIATIONS * F.sqrt(most)).otherwise(1e-6)
    half = F.lit(MARK_BITS // 64)
    marked = _differing(f"{x}marks", f"{y}marks", MARK_BITS, F.when(level_x < level_y, half).otherwise(0), F.when(level_y < level_x, half).otherwise(0))
    return sizes & (_differing(f"{x}sketch", f"{y}sketch", SKETCH_BITS) <= MOST_DIFFERING) & (marked <= allowed)


_TRAITS = ("n_shingles", "sketch", "level", "marks")


def _with_traits(df: DataFrame, nodes: DataFrame, key: str, *more: str) -> DataFrame:
    """df with what _alike() reads about the nodes of column `key`, under names that begin with it."""
    return df.join(nodes.select(F.col("node").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in (*_TRAITS, *more))), key)


def find_links(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, components) between the nodes (those of _SIGNED, row as node) of different sets."""
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    members = materialize(banded.join(buckets, "bucket").select("bucket", "node", "hub", "size"), "near-members")

    def tested(pairs: DataFrame) -> DataFrame:
        """Sketches first, then full sets."""
        both = _with_traits(_with_traits(pairs, nodes, "a"), nodes, "b")
        likely = materialize(both.filter(_alike("a_", "b_")).select("a", "b"), "near-pairs")
        links = confirm(likely, nodes, docs)
        release(likely)
        return links

    links = tested(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    comps = components(links)
    open_ = members.filter("size > 2").select("bucket", "node", "hub")
    for _ in range(HUB_ROUNDS):
        open_ = materialize(_unsettled(open_, comps), "near-open")
        crowded = open_.filter("node_comp <> hub_comp").groupBy("bucket").agg(F.count("*").alias("outsiders"), F.min("node").alias("next")).filter(F.col("outsiders") > OUTSIDERS)
        if crowded.isEmpty():
            break
        paired = open_.join(crowded, "bucket").filter("node <> next").select(F.col("node").alias("a"), F.col("next").alias("b")).distinct()
        further = tested(paired)
        if further.isEmpty():
            break  # a crowd of unlike nodes, which another hub would not thin out
        links = materialize(links.union(further), "near-links")
        comps = components(links)
        # the component of the new hub may be the larger one: outsiders are counted against it from now on
        open_ = open_.join(crowded.select("bucket", "next"), "bucket", "left").select("bucket", "node", F.coalesce("next", "hub").alias("hub"))
    else:
        open_ = materialize(_unsettled(open_, comps), "near-open")
    outsiders = open_.filter("node_comp <> hub_comp").select("bucket", F.col("node").alias("a"), F.col("node_comp").alias("a_comp"))
    others = open_.select("bucket", F.col("node").alias("b"), F.col("node_comp").alias("b_comp"))
    # a pair that shares several buckets is made in the first of them alone
    left, right = _with_traits(outsiders, nodes, "a", "bands"), _with_traits(others, nodes, "b", "bands")
    shared = F.filter("a_bands", lambda x, i: x == F.get("b_bands", i))
    once = F.get(shared, F.lit(0)) == left["bucket"]
    cross = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("a_comp") != F.col("b_comp")) & _alike("a_", "b_") & once)
    pairs = materialize(cross.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    further = confirm(pairs, nodes, docs)
    release(open_, pairs, members)
    if further.isEmpty():
        return links, comps
    links = materialize(links.union(further), "near-links")
    return links, components(links)


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component, with the node's and the hub's component."""
    of = lambda key, name: comps.select(F.col("node").alias(key), F.col("comp").alias(name))
    known = members.select("bucket", "node", "hub").join(of("node", "c"), "node", "left").withColumn("node_comp", F.coalesce("c", "node")).drop("c")
    hubs = known.filter("node = hub").select("bucket", F.col("node_comp").alias("hub_comp"))
    mixed = known.groupBy("bucket").agg(F.min("node_comp").alias("low"), F.max("node_comp").alias("high")).filter("low <> high").select("bucket")
    return known.join(hubs.join(mixed, "bucket"), "bucket").select("bucket", "node", "hub", "node_comp", "hub_comp")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, classes) of rows (doc_id, text, row): classes (set_key, component_id, keeper) name each set's component.

    The component's lowest doc_id (nulls last) is its id, and the first of the rows with that id its keeper.
    """
    signed = materialize(base_columns(rows, "doc_id", "text", "row").mapInArrow(_sign, _SIGNED), "near-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    sets = materialize(signed.filter("set_key is not null").groupBy("set_key").agg(first), "near-sets")
    own = signed.join(sets.select(F.col("first.row").alias("row")), "row")
    nodes = materialize(own.select(F.col("row").alias("node"), "doc_id", "set_key", "bands", *_TRAITS), "near-nodes")
    _, comps = find_links(nodes, rows)
    owned = sets.withColumn("node", F.col("first.row")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = owned.groupBy("comp").agg(F.min("first").alias("lowest"))
    named = owned.join(lowest, "comp").select("set_key", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row").alias("keeper"))
    return signed, materialize(named, "near-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed, classes = _classes(base_columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    own = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, its keeper, with all columns; rows without words stay.

    Rows are told apart by a number that is written with them, so a doc_id may be null or stand on several rows; of
    rows with equal sets one stays.
    """
    (number,) = fresh(docs, "row")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    signed, classes = _classes(rows.select("doc_id", "text", F.col(number).alias("row")))
    gone = signed.join(classes, "set_key").filter("row <> keeper").select(F.col("row").alias(number))
    return rows.join(gone, number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
