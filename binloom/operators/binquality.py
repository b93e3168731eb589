"""Quality of a binning against known genomes, by base pairs.

Input rows are (contig, length, bin, genome); all measures start from the overlaps of bins and genomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(rows: DataFrame) -> DataFrame:
    """(bin, genome, bp)."""
    return rows.groupBy("bin", "genome").agg(F.sum("length").cast("double").alias("bp"))


def _best(over: DataFrame, key: str, other: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("bp").desc(), other)
    return over.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def best_genome(over: DataFrame) -> DataFrame:
    """(bin, genome, bp): the genome with most base pairs in each bin, the first by name among equals."""
    return _best(over, "bin", "genome").select("bin", "genome", "bp")


def best_bin(over: DataFrame) -> DataFrame:
    """(genome, bin, bp): the bin with most base pairs of each genome."""
    return _best(over, "genome", "bin").select("genome", "bin", "bp")


def purity(over: DataFrame) -> DataFrame:
    """(bin, genome, purity, contamination)."""
    size = over.groupBy("bin").agg(F.sum("bp").alias("size"))
    share = F.col("bp") / F.col("size")
    return best_genome(over).join(size, "bin").select("bin", "genome", share.alias("purity"), (1 - share).alias("contamination"))


def completeness(over: DataFrame) -> DataFrame:
    """(genome, bin, completeness): the share of each genome in its best bin."""
    size = over.groupBy("genome").agg(F.sum("bp").alias("size"))
    return best_bin(over).join(size, "genome").select("genome", "bin", (F.col("bp") / F.col("size")).alias("completeness"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def summary(over: DataFrame) -> DataFrame:
    """One row: average purity, accuracy, average completeness, the older completeness, both F1, adjusted Rand index."""
    genomes = over.groupBy("genome").agg(F.sum("bp").alias("g"))
    sizes = over.groupBy("bin").agg(F.sum("bp").alias("b"))
    by_bin = best_genome(over).join(genomes, "genome")
    one = by_bin.agg(F.sum("bp").alias("tp"), F.sum(F.col("bp") / F.col("g")).alias("older"))
    two = purity(over).agg(F.avg("purity").alias("purity"))
    three = completeness(over).agg(F.avg("completeness").alias("completeness"))
    four = genomes.agg(F.sum("g").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(_pairs(F.col("g"))).alias("pg"))
    five = sizes.agg(F.sum(_pairs(F.col("b"))).alias("pb"))
    six = over.agg(F.sum(_pairs(F.col("bp"))).alias("po"))
    row = one.crossJoin(two).crossJoin(three).crossJoin(four).crossJoin(five).crossJoin(six)  # each has one row
    older = F.col("older") / F.col("n")
    expected = F.col("pb") * F.col("pg") / _pairs(F.col("total"))
    return row.select(
        "purity", (F.col("tp") / F.col("total")).alias("accuracy"), "completeness", older.alias("older_completeness"),
        (2 * F.col("purity") * F.col("completeness") / (F.col("purity") + F.col("completeness"))).alias("f1"),
        (2 * F.col("purity") * older / (F.col("purity") + older)).alias("older_f1"),
        ((F.col("po") - expected) / ((F.col("pb") + F.col("pg")) / 2 - expected)).alias("adjusted_rand"),
    )
