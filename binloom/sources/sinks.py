"""Writers.  All replace what an earlier run left at their path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_counts(counts: DataFrame, path: str) -> None:
    """Counts (sample, contig, count), a folder for each sample."""
    counts.write.mode("overwrite").partitionBy("sample").parquet(path)


def write_table(rows: DataFrame, path: str, separator: str = " ", header: bool = False) -> None:
    """A delimited text table: links, audits, bins, hits, predictions."""
    rows.write.mode("overwrite").csv(path, sep=separator, header=header)


def write_columns(rows: DataFrame, path: str) -> None:
    """Arrays and everything else: tetramers, shares, codons, factors, latents."""
    rows.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    """Raw lines, as a copy of a stream."""
    lines.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_bin_fasta(sequences: DataFrame, bins: DataFrame, path: str) -> None:
    """FASTA records (name, seq) in a folder for each bin (contig, bin); a contig of several bins is in each."""
    joined = sequences.join(bins.withColumnRenamed("contig", "name"), "name")
    records = joined.select("bin", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))
    records.repartition("bin").write.mode("overwrite").partitionBy("bin").text(path)


def write_model(net, spark, path: str, losses: list[list[float]] | None = None) -> None:
    """A network's weights, and its losses by epoch and head, in two folders of ``path``."""
    from binloom.operators import network

    write_columns(network.weights_table(spark, net), f"{path}/weights")
    rows = [(e, h.name, float(x)) for e, each in enumerate(losses or []) for h, x in zip(net.heads, each, strict=True)]
    write_columns(spark.createDataFrame(rows, "epoch int, head string, loss double"), f"{path}/losses")
