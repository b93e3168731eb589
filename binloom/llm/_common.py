"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.storage import cut, cut_counted

__all__ = ["WORD", "arrow_batches", "cut", "cut_counted", "hash_segment", "join_counted", "join_small", "running_total", "table", "text_or_empty"]
#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside goes to Python in batches of at most so many rows, which bounds a worker's memory for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """Join with a table that is usually small: it is counted, broadcast up to ``most_rows``, shuffled beyond.

    ``small`` should have been cut, as counting it runs it.
    """
    return join_counted(big, small, small.count(), on, how, most_rows)


def join_counted(big: DataFrame, small: DataFrame, rows: int, on: list[str], how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """``join_small`` for a table whose rows have been counted."""
    return big.join(F.broadcast(small) if rows <= most_rows else small, on, how)


def hash_segment(name: str, count: int, rows: int = 4096) -> Column:
    """The leading bits of a hash column, so many that a segment has about ``rows`` of ``count`` rows."""
    bits = min(20, max(0, (max(1, count) // rows).bit_length()))
    return F.shiftrightunsigned(name, 64 - bits) if bits else F.lit(0).cast("long")


def running_total(df: DataFrame, keys: list[str], segment: str, order: list, totals: dict[str, str]) -> DataFrame:
    """Adds, by name, exclusive running totals of columns along ``order`` within ``keys``, without one task per key.

    ``segment`` must not decrease along ``order``; neither it nor the keys may be null.  Rows are summed
    inside (keys, segment); the far fewer segment sums are then added up along each key.  So a hot key is
    spread over its segments.
    """
    within = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    sums = df.groupBy(*keys, segment).agg(*[F.sum(value).alias(f"_sum_{out}") for out, value in totals.items()])
    base = sums.select(*keys, segment, *[F.coalesce(F.sum(f"_sum_{out}").over(along), none).alias(f"_base_{out}") for out in totals])
    inner = df.withColumns({f"_in_{out}": F.coalesce(F.sum(value).over(within), none) for out, value in totals.items()})
    found = inner.join(base, [*keys, segment]).withColumns({out: F.col(f"_base_{out}") + F.col(f"_in_{out}") for out in totals})
    return found.drop(*[f"_{kind}_{out}" for out in totals for kind in ("in", "base")])
