"""Shards of near-equal bytes that keep equal texts together: a minimax contiguous partition of ordered groups.

Groups are the distinct texts, in the order of their SHA-256, and their sizes are summed where they lie.  The driver
holds sums of ranges of that order only: a range's first bits, its bytes and whether it is one group.  The least
capacity for which a greedy filling needs no more than the shards is searched by halving, twice: as if cuts could
fall anywhere inside a range, and as if only at its ends.  Ranges that a cut between the two answers can fall into are
summed again by their next bits, until both agree; then the cuts are made at that capacity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import cut, running_total, text_or_empty

SHARDS = 8
#: Bits of the order that one pass over the groups resolves, and all that tell groups apart; those that share all are one.
STEP_BITS, ORDER_BITS = 10, 60


@dataclass
class Ranges:
    """Consecutive ranges of the order: first key of each, bits that it fixes, bytes, and its text's hash where it is one group."""

    low: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    only: list[str | None] = field(default_factory=list)

    def whole(self) -> np.ndarray:
        return np.array([o is not None or b >= ORDER_BITS for o, b in zip(self.only, self.bits, strict=True)], dtype=bool)

    def ends(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.array(self.size, dtype=np.int64))]).astype(np.int64)

    def without(self, places: set[int]) -> Ranges:
        return Ranges(*[[v for i, v in enumerate(column) if i not in places] for column in (self.low, self.bits, self.size, self.only)])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's hash and its place in the order, computed once; a null text is empty."""
    text = text_or_empty()
    named = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("h"), F.monotonically_increasing_id().alias("at"),
    )
    return named.withColumn("key", order_key(F.col("h")))


def order_key(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("long")


def summed(rows: DataFrame, within: list[tuple[int, int]] | None = None) -> Ranges:
    """The groups' bytes by ranges: of the whole order, or of ranges (low, bits) by the next bits."""
    spans = within or [(0, 0)]
    found: dict[tuple[int, int], Ranges] = {}
    for bits in sorted({b for _, b in spans}):
        step = min(bits + STEP_BITS, ORDER_BITS)
        lows = [low for low, b in spans if b == bits]
        part = rows if bits == 0 else rows.join(F.broadcast(rows.sparkSession.createDataFrame([(low >> (ORDER_BITS - bits),) for low in lows], "top long")), F.shiftright("key", ORDER_BITS - bits) == F.col("top"), "left_semi")
        sums = part.groupBy(F.shiftright("key", ORDER_BITS - step).alias("part")).agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("b")).collect()
        for r in sorted(sums):
            top = (r["part"] >> (step - bits)) << (ORDER_BITS - bits)
            into = found.setdefault((top, bits), Ranges())
            into.low.append(r["part"] << (ORDER_BITS - step))
            into.bits.append(step)
            into.size.append(r["size"])
            into.only.append(r["a"] if r["a"] == r["b"] else None)
    out = Ranges()
    for span in sorted(found):
        for name in ("low", "bits", "size", "only"):
            getattr(out, name).extend(getattr(found[span], name))
    return out


def refined(rows: DataFrame, ranges: Ranges, places: list[int]) -> Ranges:
    """``ranges`` with those at ``places`` replaced by their parts."""
    finer = summed(rows, [(ranges.low[i], ranges.bits[i]) for i in places])
    kept = ranges.without(set(places))
    order = sorted(zip(kept.low + finer.low, kept.bits + finer.bits, kept.size + finer.size, kept.only + finer.only, strict=True), key=lambda r: r[0])
    return Ranges(*[list(column) for column in zip(*order, strict=True)])


def filled(ends: np.ndarray, whole: np.ndarray, capacity: int, shards: int, anywhere: bool) -> list[int]:
    """Where greedy shards of a capacity end, in bytes of the order; ``anywhere``: cuts may fall inside ranges that are not one group."""
    stops, at, total = [], 0, int(ends[-1])
    for _ in range(shards):
        most = at + capacity
        if most >= total:
            at = total
        else:
            i = int(np.searchsorted(ends, most, side="right")) - 1
            at = most if anywhere and not whole[i] else max(at, int(ends[i]))
        stops.append(at)
    return stops


def least_capacity(ends: np.ndarray, whole: np.ndarray, shards: int, anywhere: bool) -> int:
    """The smallest capacity whose greedy filling reaches the end, by halving."""
    low, high = -(-int(ends[-1]) // shards), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if filled(ends, whole, middle, shards, anywhere)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def settled(rows: DataFrame, ranges: Ranges, shards: int) -> tuple[Ranges, int]:
    """Ranges fine enough that the least capacity is exact, and that capacity."""
    while True:
        ends, whole = ranges.ends(), ranges.whole()
        low, high = (least_capacity(ends, whole, shards, anywhere) for anywhere in (True, False))
        touched: set[int] = set()
        first, last = filled(ends, whole, low, shards, False), filled(ends, whole, high, shards, True)
        for a, b in zip(first, last, strict=True):
            i, j = int(np.searchsorted(ends, a, side="right")) - 1, int(np.searchsorted(ends, b, side="left"))
            touched.update(k for k in range(max(0, i), min(j, len(whole))) if not whole[k])
        if not touched or low == high:
            return ranges, high
        ranges = refined(rows, ranges, sorted(touched))


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Places in ``ends`` where shards begin: each as near its even share as the capacity of all that follow allows."""
    total, latest = int(ends[-1]), [len(ends) - 1]
    for _ in range(shards - 1):
        latest.append(int(np.searchsorted(ends, ends[latest[-1]] - capacity, side="left")))
    cuts, at = [], 0
    for j in range(1, shards):
        low, high = max(at, latest[shards - j]), int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        share = int(ends[at]) + (total - int(ends[at])) // (shards - j + 1)
        near = int(np.searchsorted(ends, share))
        at = min((k for k in (near - 1, near, low, high) if low <= k <= high), key=lambda k: (abs(int(ends[k]) - share), k))
        cuts.append(at)
    return cuts


@dataclass
class Plan:
    """Where each text goes: hashes of groups that are shards of their own, and the keys at which other shards begin."""

    shards: int
    alone: list[str]
    cuts: list[int]
    capacity: int

    def shard(self, digest: Column, key: Column) -> Column:
        place = F.lit(len(self.alone))
        for c in self.cuts:
            place = place + (key >= F.lit(c)).cast("int")
        out = F.when(F.lit(False), F.lit(0))
        for i, h in enumerate(self.alone):
            out = out.when(digest == h, F.lit(i))
        return out.otherwise(place).cast("int")


def plan_shards(rows: DataFrame, shards: int = SHARDS) -> Plan:
    """The plan for ``rows`` (h, key, size).

    A group larger than an even share of what is left is a shard of its own, larger ones first; the others are
    cut at the least capacity of what remains, so that a large group does not leave other shards empty.
    """
    ranges, alone, largest = summed(rows), [], 0
    while len(alone) < shards - 1 and ranges.size:
        share = sum(ranges.size) / (shards - len(alone))
        coarse = [i for i, (s, w) in enumerate(zip(ranges.size, ranges.whole(), strict=True)) if s > share and not w]
        if coarse:
            ranges = refined(rows, ranges, coarse)
            continue
        big = max((i for i, o in enumerate(ranges.only) if o is not None), key=lambda i: (ranges.size[i], -i), default=None)
        if big is None or ranges.size[big] <= share:
            break
        alone.append(ranges.only[big])
        largest = max(largest, ranges.size[big])
        ranges = ranges.without({big})
    left = shards - len(alone)
    if not ranges.size:
        return Plan(shards, alone, [], largest)
    others = rows.filter(~F.col("h").isin(alone)) if alone else rows
    ranges, capacity = settled(others, ranges, left)
    places = even_cuts(ranges.ends(), capacity, left)
    return Plan(shards, alone, [ranges.low[i] if i < len(ranges.low) else 1 << ORDER_BITS for i in places], max(largest, capacity))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id and text are read).

    A null text is empty and of one group with empty ones; its size is 1.  Equal texts, whatever their ids, share a
    shard, however many they are; rows that repeat are rows of their own.  A null doc_id is one more value.  Fewer
    texts than shards leave shards empty; an empty table gives no rows.  Slots number a shard's rows as they lie in
    the input.  The law is ``bytes``, so grown_shard is null.
    """
    rows = cut(keyed(docs))
    plan = plan_shards(rows, shards)
    placed = rows.select("doc_id", "size", "text_crc32", "at", plan.shard(F.col("h"), F.col("key")).alias("shard"), F.lit(1).cast("long").alias("one"))
    # the upper bits of the place are the part of the input that a row comes from, whoever reads it
    numbered = running_total(placed.withColumn("part", F.shiftright("at", 33)), ["shard"], "part", ["at"], {"slot": "one"})
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> Plan:
    """Writes all columns of ``docs`` as Parquet under folder/shard=N; no row moves, as the plan is a few constants."""
    rows = cut(keyed(docs))
    plan = plan_shards(rows, shards)
    digest = F.sha2(F.encode(text_or_empty(), "UTF-8"), 256)
    docs.withColumn("shard", plan.shard(digest, order_key(digest))).write.mode("overwrite").partitionBy("shard").parquet(folder)
    return plan
