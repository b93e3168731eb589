"""Ranks and order statistics of whole tables without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.storage import cut

#: Values that are sorted by the driver at the end of a selection, and the share of the values around a rank that a round looks at.
LAST_VALUES, AROUND = 10_000, 0.005


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds ``name``, the place of each row from 0 in an order of the whole table.

    Rows are dealt to ranges of the order and sorted there; a partition's ranks begin after the rows of those before it,
    of which a number each comes to the driver.  Rows that tie in all of ``order`` get places in any order.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits of the place are the partition, the lower ones the row in it
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))  # a row a partition
    met = placed.join(known, F.shiftright("_at", 33) == F.col("_part"))
    return met.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values of a column at ranks from 0 among those that are not null, exactly.

    Each round brackets a rank between two values that a mergeable sketch puts a little before and after it, and counts
    what lies below and between them, which proves the bracket or moves it.  When few values are left they are sorted.
    """
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    return [_at_rank(values, r) for r in ranks]


def _at_rank(values: DataFrame, rank: int) -> float:
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    low, high, below, n = ends["low"], ends["high"], 0, ends["n"]
    if not 0 <= rank < n:
        raise IndexError(f"rank {rank} of {n} values")
    while n > LAST_VALUES and low < high:
        inside = values.filter(F.col("v").between(low, high))
        share = (rank - below + 0.5) / n
        a, b = inside.agg(F.percentile_approx("v", [max(0.0, share - AROUND), min(1.0, share + AROUND)], 10_000).alias("p")).first()["p"]
        seen = inside.agg(F.count_if(F.col("v") < a).alias("a"), F.count_if(F.col("v") == a).alias("at_a"), F.count_if(F.col("v") <= b).alias("b"), F.count_if(F.col("v") == b).alias("at_b"),
                          F.max(F.when(F.col("v") < a, F.col("v"))).alias("before"), F.min(F.when(F.col("v") > b, F.col("v"))).alias("after")).first()
        if rank < below + seen["a"]:
            high, n = seen["before"], seen["a"]
        elif rank < below + seen["a"] + seen["at_a"]:
            return a
        elif rank >= below + seen["b"]:
            low, n, below = seen["after"], n - seen["b"], below + seen["b"]
        elif rank >= below + seen["b"] - seen["at_b"]:
            return b
        else:
            low, high, n, below = a, b, seen["b"] - seen["a"], below + seen["a"]
    if low == high:
        return low
    return sorted(r["v"] for r in values.filter(F.col("v").between(low, high)).collect())[rank - below]  # LAST_VALUES at most


def exact_median(rows: DataFrame, column: str) -> float | None:
    """The median of a column, the mean of the two middle values where their number is even; None without values."""
    n = rows.filter(F.col(column).isNotNull()).count()
    if not n:
        return None
    found = order_statistics(rows, column, sorted({(n - 1) // 2, n // 2}))
    return sum(found) / len(found)
