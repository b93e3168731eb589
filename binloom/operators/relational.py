"""Set operations and keyed selections that the binning flows use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    for other in others:
        first = first.unionByName(other)
    return first


def distinct_union(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two).distinct()


def in_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return rows.join(keys.select(key), key, "left_semi")


def not_in_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return rows.join(keys.select(key), key, "left_anti")


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def member_lists(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Members of each group as a sorted list."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("members"))


def largest_remaining(rows: DataFrame, chosen: DataFrame, key: str, value: str, k: int = 1) -> DataFrame:
    """The k rows of largest value whose key was not chosen yet, ties by key."""
    return not_in_keys(rows, chosen, key).orderBy(F.col(value).desc(), key).limit(k)


def farthest_pair(distances: DataFrame) -> DataFrame:
    """(seed, partner) of the largest distance among (a, b, distance), and the second largest partner of the seed."""
    from pyspark.sql import Window

    top = distances.orderBy(F.col("distance").desc(), "a", "b").limit(1).select(F.col("a").alias("seed"))
    order = Window.partitionBy("seed").orderBy(F.col("distance").desc(), "b")
    near = distances.join(F.broadcast(top), distances["a"] == top["seed"]).withColumn("rank", F.row_number().over(order))  # one row
    return near.filter("rank <= 2").select("seed", "b", "rank", "distance")
