"""Made-up communities: how many genomes of a taxon, how abundant each is, and how many reads that gives.

Every draw is an inverse distribution function of a hash of what it is for and a seed, so reruns agree however the rows
lie, and a row's draw does not hang on the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20240613
#: Mean and deviation of the logarithm of abundances, and the deviation of a sample's noise on it.
LOG_MEAN, LOG_DEVIATION, NOISE = 1.0, 2.0, 1.0


def uniform(*of: Column | str, seed: int = SEED) -> Column:
    """A number above 0 and below 1, from a hash of columns and a seed."""
    bits = F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def normal(*of: Column | str, seed: int = SEED) -> Column:
    """A standard normal number, by the polar form of two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(*of, seed=seed))) * F.cos(2 * math.pi * uniform(*of, seed=seed + 1))


def truncated_geometric(u: Column, most: int) -> Column:
    """1 to ``most``, geometric of mean most / 2 but cut off, by the inverse of its distribution function."""
    p = min(1.0, 2.0 / most)
    if p == 1.0:
        return F.when(u < 0, 1).otherwise(1)
    whole = 1 - (1 - p) ** most
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.ln(1 - u * whole) / math.log(1 - p)).cast("int")))


def community(genomes: DataFrame, most: int, samples: int = 1, reads: int = 1_000_000, seed: int = SEED) -> DataFrame:
    """(sample, taxon, genome, abundance, reads) drawn from ``genomes`` (genome, taxon, size).

    Each taxon gets a truncated geometric number of genomes, those of least hash.  Abundances are log-normal, with
    log-normal noise for each sample after the first, and sum up to 1 in a sample; reads are in proportion to abundance times size.
    Rows with a null genome, taxon or size are left out.
    """
    known = genomes.select("genome", "taxon", "size").dropna()
    counted = known.select("taxon").distinct().withColumn("wanted", truncated_geometric(uniform("taxon", seed=seed), most))
    order = Window.partitionBy("taxon").orderBy(F.xxhash64("genome", F.lit(seed)), "genome")
    # a taxon's genomes are ranked by hash, and no more than ``most`` of them are taken
    chosen = known.withColumn("place", F.row_number().over(order)).join(counted, "taxon").filter("place <= wanted")
    drawn = chosen.withColumn("base", LOG_MEAN + LOG_DEVIATION * normal("genome", seed=seed + 2))
    each = drawn.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    noise = F.when(F.col("sample") > 0, NOISE * normal("genome", "sample", seed=seed + 4)).otherwise(0.0)
    weighed = each.withColumn("weight", F.exp(F.col("base") + noise))
    exact = lambda c: F.sum(c.cast("decimal(34,10)")).cast("double")  # noqa: E731  whatever order the rows are added in
    totals = weighed.groupBy("sample").agg(exact(F.col("weight")).alias("all_weight"), exact(F.col("weight") * F.col("size")).alias("all_size"))
    met = weighed.join(F.broadcast(totals), "sample")  # a row a sample
    share = F.col("weight") * F.col("size") / F.col("all_size")
    return met.select("sample", "taxon", "genome", (F.col("weight") / F.col("all_weight")).alias("abundance"), F.round(share * reads).cast("long").alias("reads"))
