"""Near-duplicate components by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum; both
agree between two sets with probability equal to their Jaccard similarity.  180 permutations give 360
values, banded by six; the two values of one permutation never share a band, so the values of a band are
independent.  A pair of similarity 0.75 misses all 60 bands with probability below 1e-5.

Links are confirmed on the full shingle sets.  Components need not see every link: equal sets are first
folded into one class, then every member of a bucket is compared with the bucket's leader, and at last all
members of different components that share a bucket are compared, so that no candidate link between two
components is left out while links inside one are not expanded.  Three bounds spare that last step most of
its pairs: sets with many shingles of their own can have no link, sizes must allow one, and sketches of the
signatures must (they miss a pair at 0.75 with probability below 1e-5).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import arrow_batches, cut, cut_counted, join_counted, text_or_empty
from binloom.llm._tokens import forget
from binloom.operators.graph import components

SHINGLE_WORDS = 5
PERMUTATIONS, BAND_ROWS = 180, 6
#: Words whose hash a Python worker remembers, so that its memory stays bounded.
REMEMBERED_WORDS = 120_000
#: Rows of a batch that carries texts or sets.
BATCH_ROWS = 512
#: Ids that are broadcast at most to find their texts; more are joined by a shuffle.
SMALL_ROWS = 300_000
#: Bits of each signature value that a sketch keeps, and the deviations by which its estimate may fall below the similarity.
SKETCH_BITS, SKETCH_DEVIATIONS = 4, 4.4
#: Slots of parities, a power of two.
PARITY_SLOTS = 4096
_ODD = np.random.default_rng(20240611).integers(1, 2**63, size=SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes.  bytes.lower and bytes.split know ASCII alone, as wanted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([known[w] for w in words], dtype=np.uint64)
    width = min(SHINGLE_WORDS, len(words))
    count = len(words) - width + 1
    total = np.full(count, np.uint64(width) * _ODD[SHINGLE_WORDS] & np.uint64(2**64 - 1), dtype=np.uint64)
    for i in range(width):
        total += hashes[i : i + count] * _ODD[i]
    return np.unique(_mix(total))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    factors = rng.integers(0, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors[:, None], rng.integers(0, 2**63, size=count, dtype=np.uint64)[:, None]


def min_max(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of every permutation, over slices so that long texts need no more memory."""
    low = np.full(len(factors), np.uint64(2**64 - 1))
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(hashes), 2048):
        values = hashes[None, at : at + 2048] * factors + shifts
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def bands(low: np.ndarray, high: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key a band: bands of minima first, bands of maxima after them."""
    values = np.concatenate([low, high]).reshape(-1, rows)
    keys = np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        keys = _mix(keys ^ values[:, i])
    return keys.view(np.int64)


def sketch(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Four bits of every signature value, sixteen values in a long; the last long is filled up with zeros."""
    values = _mix(np.concatenate([low, high])) & np.uint64(15)
    values = np.concatenate([values, np.zeros(-len(values) % 16, np.uint64)]).reshape(-1, 16)
    return (values << (np.arange(16, dtype=np.uint64) * np.uint64(SKETCH_BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def most_differences(percent: int, permutations: int) -> int:
    """How many values of two sketches may differ if their sets may be alike enough."""
    count = 2 * permutations
    match = percent / 100 + (1 - percent / 100) / (1 << SKETCH_BITS)
    return int(count * (1 - match) + SKETCH_DEVIATIONS * (count * match * (1 - match)) ** 0.5)


def _differences(one: str, two: str):
    """How many values of two sketches differ."""

    def nibbles(a, b):
        x = a.bitwiseXOR(b)
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(one, two, nibbles), F.lit(0), lambda acc, n: acc + n)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each slot has an odd number of a set's shingle hashes, 64 slots in a long."""
    slots = (hashes >> np.uint64(65 - PARITY_SLOTS.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=PARITY_SLOTS) & 1).astype(np.uint8)).view(np.int64)


def _parities_of(batches):
    for batch in batches:
        found = [parities(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column("hashes")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "odd"])


def _near_in_parity(percent: int):
    """Two sets differ in at least as many shingles as slots, and linked ones in at most (1 - p) / (1 + p) of their sizes' sum."""
    apart = F.aggregate(F.zip_with("x.odd", "y.odd", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, n: acc + n)
    return F.coalesce(apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent), F.lit(True))


def _raw_texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def _signed(permutations: int, rows: int):
    def run(batches):
        forget()
        known = _WordHashes()
        factors, shifts = _permutations(permutations)
        for batch in batches:
            counts, digests, keys, sketches = [], [], [], []
            for text in _raw_texts(batch.column("_text")):
                hashes = shingle_set(text, known)
                counts.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                both = min_max(hashes, factors, shifts)
                keys.append(bands(*both, rows) if len(hashes) else np.empty(0, np.int64))
                sketches.append(sketch(*both) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "keys", "sketch"],
            )

    return run


def _sets(batches):
    forget()
    known = _WordHashes()
    for batch in batches:
        found = [shingle_set(text, known).tobytes() for text in _raw_texts(batch.column("_text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.large_binary()).cast(pa.binary())], ["id", "hashes"])


def _spread(batches):
    for batch in batches:
        for id_, hashes in zip(batch.column("id"), batch.column("hashes"), strict=True):
            values = np.frombuffer(hashes.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), id_.as_py())), pa.array(values)], ["id", "hash"])


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    one, two = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(_linked(percent), "a long, b long")


def with_shared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds c to rows (id, n, ...): how many shingles of the set are in the set of another id of ``rows`` too.

    No intersection is larger than c, so a set with many shingles of its own is known to have no link
    without being compared with anything.
    """
    spread = sets.join(rows.select("id").distinct(), "id", "left_semi").mapInArrow(_spread, "id long, hash long")
    common = spread.groupBy("hash").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))
    alone = common.filter("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    return rows.join(alone, "id", "left").withColumn("c", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")


def still_open(members: DataFrame, labels: DataFrame, count: int, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (key, id, n, comp, c) of members whose set may link with a set of another component in its bucket."""
    placed = join_counted(members.select("key", "id", "n"), labels, count, ["id"], "left").withColumn("comp", F.coalesce("comp", "id"))
    meet = cut(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).filter("lo < hi").drop("lo", "hi"))
    rows = cut(placed.join(meet, "key"))  # both sides are dealt by key alone, so Spark can split a large bucket
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    return with_shared(rows, sets).filter(F.col("c") * (100 + percent) >= (F.col("n") + partner) * percent).drop("least")


def _may_link(percent: int):
    """|x and y| >= p (|x| + |y|) / (1 + p) must be possible, and neither set much larger than the other."""
    both, sizes = F.least("x.c", "y.c"), F.col("x.n") + F.col("y.n")
    return (both * (100 + percent) >= sizes * percent) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)


def apart(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, permutations: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and that the bounds allow.

    One end of each pair is outside the bucket's largest component, so that is never paired with itself; a
    pair leaves the join once, in the first bucket that it shares, and only if its sketches and parities allow a link.
    """
    ids, count = cut_counted(rows.select("id", "n").distinct())
    signs = join_counted(classes, ids, count, ["id", "n"], "left_semi").groupBy("id").agg(F.first(F.struct("keys", "sketch")).alias("s")).select("id", "s.keys", "s.sketch")
    # an id of several sets has no parities, as they could be those of another
    odd = sets.join(ids.select("id").distinct(), "id", "left_semi").mapInArrow(_parities_of, "id long, odd array<long>").groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.first("odd").alias("odd"))
    signs = signs.join(odd.select("id", F.when(F.col("k") == 1, F.col("odd")).alias("odd")), "id", "left")
    largest = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
    largest = cut(largest.filter("comps > 1").select("key", F.col("m.comp").alias("main")))  # cut, so that Spark can split a large bucket
    tagged = cut(rows.join(largest, "key").join(signs, "id").select("key", "main", "comp", F.struct("id", "n", "c", "keys", "sketch", "odd").alias("x")))
    one = tagged.filter("comp <> main").select("key", F.col("comp").alias("ca"), "x")
    two = tagged.select("key", F.col("main"), F.col("comp").alias("cb"), F.col("x").alias("y"))
    other = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("x.id") < F.col("y.id")))
    alike = _differences("x.sketch", "y.sketch") <= most_differences(percent, permutations)
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("key")
    pairs = one.join(two, "key").filter(other).filter(_may_link(percent)).filter(alike).filter(_near_in_parity(percent)).filter(first)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept, one for each row of ``docs`` (doc_id and text are read).

    A null text is an empty one; empty texts link with nothing and are kept.  Rows with the same doc_id are
    one document, whatever links with any of them.  A row without doc_id has no component and is kept.
    Ties need no rule: the smallest id names a component.  An empty table gives an empty result.
    """
    docs = docs.select("doc_id", text_or_empty().alias("_text"))
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_ROWS):
        signed = cut(docs.mapInArrow(_signed(permutations, band_rows), "doc_id long, n long, digest binary, keys array<long>, sketch array<long>"))
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # an id of several texts is one class for each
    classes = cut(full.groupBy("digest", "n").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")))
    rows = classes.select(F.explode("keys").alias("key"), "id", "n")
    leaders = rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).filter("leader < _last").drop("_last")
    members = cut(rows.join(cut(leaders), "key"))  # two tables dealt by key alone, so that Spark can split a large bucket
    ids, count = cut_counted(members.select(F.col("id").alias("doc_id")).distinct())
    with arrow_batches(spark, BATCH_ROWS):
        sets = cut(join_counted(docs, ids, count, ["doc_id"], "left_semi", SMALL_ROWS).mapInArrow(_sets, "id long, hashes binary"))
        tried = cut(members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
        edges = cut(verified(tried, sets, percent))
    labels, count = cut_counted(components(edges))
    with arrow_batches(spark, BATCH_ROWS):
        rows, still = cut_counted(still_open(members, labels, count, sets, percent))
        if still:
            pairs = apart(rows, classes, sets, percent, permutations).join(tried, ["a", "b"], "left_anti")
            found, links = cut_counted(verified(cut(pairs), sets, percent))
            if links:
                labels = cut(components(edges.union(found)))
    # the classes whose component isn't named by their only member
    named = classes.select("digest", "id", "copies").join(labels, "id", "left").filter("copies > 1 OR comp <> id")
    named = cut(named.select("digest", F.coalesce("comp", "id").alias("comp")))
    found = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
