"""Runs of repeated words: every maximal stretch of least period q that holds at least four periods and six words.

A run of period q has all of i, ..., i + q inside for at least 3q values of i, so one of the grid points 0, 3q, 6q, ...
is among them: a harmonic number of (period, grid point) pairs for a whole text.  Prefix hashes of the words' numbers
tell whether two stretches are alike, and halving finds how far the words at i and at i + q agree, forward and
backward, for all pairs of a text at once.  Equal words have equal hashes, so no run is missed; what hashes claim is
then compared word by word, and split where it was wrong.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import WORD, text_or_empty

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Modulus and base of the prefix hashes, and pairs that are searched at once.
PRIME, BASE, PAIRS = 2_147_483_647, 1_000_003, 4_000_000
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes, each word weighed by a power of the base, and the powers."""
    n = len(ids)
    powers = np.ones(n + 1, dtype=np.uint64)
    done = 1
    while done <= n:
        step = min(done, n + 1 - done)
        powers[done : done + step] = powers[:step] * (powers[done - 1] * BASE % PRIME) % PRIME
        done += step
    # numbers of words are spread, so that small ones do not cancel
    spread = (ids.astype(np.uint64) + 1) * np.uint64(0x9E3779B1) % np.uint64(PRIME)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(spread * powers[:n] % PRIME, out=sums[1:])
    return sums % PRIME, powers


def grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, grid point) of all periods from low to high - 1."""
    periods = np.arange(low, high)
    counts = np.maximum(0, -(-(n - periods) // (3 * periods)))
    q = np.repeat(periods, counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return q, (np.arange(len(q)) - np.repeat(first, counts)) * 3 * q


def agreement(hashes: np.ndarray, powers: np.ndarray, q: np.ndarray, i: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from i on (or before i) agree with those q later, by halving for all pairs at once."""
    n = len(hashes) - 1
    low, high = np.zeros(len(q), dtype=np.int64), (n - i - q if forward else i).astype(np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        a, b = (i, i + middle) if forward else (i - middle, i)
        one = (hashes[b] + PRIME - hashes[a]) % PRIME * powers[q] % PRIME
        two = (hashes[b + q] + PRIME - hashes[a + q]) % PRIME
        same = one == two
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    return low


def least_length(q):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * q)


def verified(ids: np.ndarray, start: int, stop: int, q: int) -> list[tuple[int, int, int]]:
    """The stretches of period q that a claimed one really has: usually the one itself."""
    same = ids[start : stop - q] == ids[start + q : stop]
    if same.all():
        return [(start, stop - start, q)]
    breaks = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    return [(start + int(a) + 1, int(b - a) - 1 + q, q) for a, b in zip(breaks[:-1], breaks[1:], strict=True) if int(b - a) - 1 + q >= least_length(q)]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    hashes, powers = prefix_hashes(ids)
    claimed: set[tuple[int, int, int]] = set()
    low, top = 1, n // LEAST_PERIODS + 1
    while low < top:
        # so many periods at a time that their grid points are about PAIRS
        high = min(top, max(low + 1, int(low * np.exp(min(30.0, 3 * PAIRS / n)))))
        q, i = grid(n, low, high)
        alike = ids[i] == ids[i + q]
        q, i = q[alike], i[alike]
        if len(q):
            ahead, behind = agreement(hashes, powers, q, i, True), agreement(hashes, powers, q, i, False)
            long = ahead + behind + q >= least_length(q)
            claimed.update(zip((i - behind)[long].tolist(), (i + q + ahead)[long].tolist(), q[long].tolist(), strict=True))
        low = high
    found: dict[tuple[int, int], int] = {}
    for start, stop, q in sorted(claimed):
        for s, length, p in verified(ids, start, stop, q):
            # a stretch of several periods is found with each of them; the least counts
            found[s, length] = min(p, found.get((s, length), p))
    return sorted((s, length, q) for (s, length), q in found.items())


def numbered(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words outside of runs and in the first period of those that hold them."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, word: str = WORD) -> DataFrame:
    """``docs`` (doc_id and text are read) as doc_id, runs (start, length, period by start, then period), collapsed.

    Words are numbered from 0 over the whole text.  ``collapsed`` is the text without what a run repeats, its words
    joined by one space.  A null or empty text has no words, no runs and an empty ``collapsed``; a null doc_id is one
    more value; rows that repeat are rows of their own; no rows give none.  A text is worked on in whole, in memory
    of some 100 bytes a word, however long.
    """
    pattern = re.compile(word)

    def work(batches):
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(1):
                words = pattern.findall(text.as_py())
                found = find_runs(numbered(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(" ".join(collapsed(words, found)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(work, f"doc_id {kind}, runs {RUN}, collapsed string")


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text, where of every tenth document, by a hash of its id, the words from some place on repeat the first of them."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("w").cast("long")})
    a = F.col("g") % F.col("n")
    p = F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    edited = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int"))), " ")
    marked = (F.col("h") % 10 == 0) & (F.col("n") > 0)
    rows = rows.withColumn("a", F.when(marked, a)).withColumn("p", F.when(marked, p))
    return rows.select("doc_id", F.when(marked, edited).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length over period (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of ``periodic_runs``.

    Ties go to the least start, then period.  Without runs the four are null.
    """
    first = F.reduce(
        "runs", F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("r"), F.sha2(F.encode(text, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), F.col("r.length").alias("length"), F.col("r.period").alias("period"),
        F.expr("r.length * 1000 div r.period").cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
