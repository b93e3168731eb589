"""Packing documents into sequences by linear grouping and best fit.

Lengths never exceed the sequence, so the table of piece counts by length is small whatever the corpus, and
the packing is planned on it: large lengths are put in groups of equal cardinality and rounded up to their
group's largest, configurations of these few sizes are chosen fullest first and used as often as the
counts allow, actual lengths take the places of the rounded ones, and small pieces go where they fit best.
The plan has runs of like sequences; executors look up each piece by its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import cut, hash_segment, running_total, text_or_empty
from binloom.llm._tokens import ID_BYTES, crc32, default_path, encoder

LIMIT = 2048
#: Lengths above this share of the limit are large.
LARGE_SHARE = 1 / 8
GROUPS = 256
END_ID = 0


def _encoded(path: str, limit: int):
    def run(batches):
        coder, end = encoder(path), END_ID.to_bytes(ID_BYTES, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.all_ids(batch.column("_text")), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), limit * ID_BYTES)):
                    part = ids[at : at + limit * ID_BYTES]
                    rows.append((doc_id, piece, at // ID_BYTES, len(part) // ID_BYTES, crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole texts encoded, ended by id 0, cut every ``limit`` ids."""
    texts = docs.select("doc_id", text_or_empty().alias("_text"))
    return texts.mapInArrow(_encoded(path, limit), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(limit: int, first: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """A configuration of rounded sizes with ``first`` in it that fills a sequence best, larger sizes first.

    Reachable sums are bits of one integer; a size with n pieces is added n times at most.
    """
    reached, steps = 1 << first, []
    mask = (1 << (limit + 1)) - 1
    for s in sizes:
        for _ in range(min(counts[s] - (s == first), (limit - first) // s)):
            steps.append((s, reached))
            reached |= (reached << s) & mask
            if reached >> limit & 1:
                break
        if reached >> limit & 1:
            break
    total, chosen = reached.bit_length() - 1, [first]
    for s, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(s)
            total -= s
    return chosen


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count)] by falling length): groups of equal cardinality, one more or less."""
    total, out = sum(counts.values()), []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                done = sum(n for _, part in out for _, n in part)
                room = max(1, total * len(out) // min(groups, total) - done) if len(out) <= groups else left
            took = min(left, room)
            out[-1][1].append((length, took))
            left, room = left - took, room - took
    return out


class Plan:
    """Runs of like sequences: [multiplicity, room left, [(length, first rank)]]."""

    def __init__(self, limit: int):
        self.limit, self.rank = limit, defaultdict(int)
        self.runs: list[list] = []
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms: list[int] = []

    def _file(self, i: int) -> None:
        room = self.runs[i][1]
        if room:
            if not self.by_room[room]:
                insort(self.rooms, room)
            self.by_room[room].append(i)

    def add(self, lengths: list[int], times: int) -> None:
        items = []
        for length in lengths:
            items.append((length, self.rank[length]))
            self.rank[length] += times
        self.runs.append([times, self.limit - sum(lengths), items])
        self._file(len(self.runs) - 1)

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.limit // length
                if count >= each:
                    self.add([length] * each, count // each)
                    count %= each
                if count:
                    self.add([length] * count, 1)
                return
            room = self.rooms[at]
            i = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.rooms[at]
            times, _, items = self.runs[i]
            each = min(room // length, max(1, count // times))
            use = min(times, count // each)
            if use < times:
                self.runs.append([times - use, room, [(n, r + use) for n, r in items]])
                self._file(len(self.runs) - 1)
            placed = []
            for _ in range(each):
                placed.append((length, self.rank[length]))
                self.rank[length] += use
            self.runs[i] = [use, room - each * length, items + placed]
            self._file(i)
            count -= use * each


def plan(counts: dict[int, int], limit: int = LIMIT, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> Plan:
    """The packing of so many pieces of each length."""
    out = Plan(limit)
    large = {n: c for n, c in counts.items() if limit * large_share < n < limit and c}
    if counts.get(limit):
        out.add([limit], counts[limit])
    stock = defaultdict(list)  # by rounded size: actual lengths, the longest last
    for size, members in linear_groups(large, groups):
        stock[size] = [list(m) for m in reversed(members)] + stock[size]
    left = {s: sum(n for _, n in stock[s]) for s in stock}
    while left:
        sizes = sorted(left, reverse=True)
        config = fullest(limit, sizes[0], sizes, left)
        need = {s: config.count(s) for s in set(config)}
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        while times:  # the actual lengths come in runs
            step = times
            for size, n in need.items():
                step = min(step, max(1, stock[size][-1][1] // n))
            lengths = []
            for size, n in need.items():
                while n:
                    top = stock[size][-1]
                    took = min(n, top[1] // step)
                    lengths += [top[0]] * took
                    top[1] -= took * step
                    n -= took
                    if not top[1]:
                        stock[size].pop()
            out.add(lengths, step)
            times -= step
    for length in sorted((n for n in counts if n <= limit * large_share), reverse=True):
        out.best_fit(length, counts[length])
    return out


def segments(made: Plan) -> np.ndarray:
    """Rows length, first rank, first sequence, offset, sorted: ranks from one row's to the next's share it."""
    rows, sequence = [], 0
    for times, _, items in made.runs:
        offset = 0
        for length, rank in items:
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _placed(table: np.ndarray, limit: int):
    def run(batches):
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(table[at, 3])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset, one for each piece.

    Reads doc_id and text of ``docs``; ``path`` names the tokenizer file, which must drop white space.  A
    null or empty text is one piece with id 0 alone.  Only documents longer than ``limit`` are cut.  Rows
    that repeat a doc_id, and null ones, are packed each for itself.  Sequence numbers run from 0 without
    gaps.  An empty table packs into nothing.
    """
    parts = cut(pieces(docs, path or default_path(), limit).withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``limit`` rows
    table = segments(plan(counts, limit))
    segmented = parts.withColumn("segment", hash_segment("h", sum(counts.values()))).withColumn("one", F.lit(1).cast("long"))
    order = [F.col("h").bitwiseXOR(F.lit(-(2**63))), "doc_id", "piece"]
    ranked = running_total(segmented, ["length"], "segment", order, {"rank": "one"}).drop("one", "segment", "h")
    names = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(table, limit), names)
