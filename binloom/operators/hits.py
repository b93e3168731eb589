"""Marker-gene hits: cut-offs, best hit of each contig, counting of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bit-score cut-offs of the 41 marker groups, as published with the fetchMGs collection.
CUTOFFS = {
    "COG0012": 210.0, "COG0016": 240.0, "COG0018": 340.0, "COG0048": 100.0, "COG0049": 120.0, "COG0052": 140.0,
    "COG0080": 90.0, "COG0081": 130.0, "COG0085": 1020.0, "COG0086": 60.0, "COG0087": 120.0, "COG0088": 110.0,
    "COG0090": 180.0, "COG0091": 80.0, "COG0092": 120.0, "COG0093": 80.0, "COG0094": 110.0, "COG0096": 80.0,
    "COG0097": 100.0, "COG0098": 140.0, "COG0099": 120.0, "COG0100": 80.0, "COG0102": 100.0, "COG0103": 80.0,
    "COG0124": 320.0, "COG0172": 170.0, "COG0184": 60.0, "COG0185": 70.0, "COG0186": 80.0, "COG0197": 70.0,
    "COG0200": 60.0, "COG0201": 210.0, "COG0202": 80.0, "COG0215": 400.0, "COG0256": 70.0, "COG0495": 450.0,
    "COG0522": 80.0, "COG0525": 740.0, "COG0533": 300.0, "COG0541": 450.0, "COG0552": 220.0,
}


def cutoff_table(spark) -> DataFrame:
    """(cog, cutoff): the cut-offs as a table of 41 rows."""
    return spark.createDataFrame(sorted(CUTOFFS.items()), "cog string, cutoff double")


def contig_of(query):
    """Name after the first underscore of ``index_contig``."""
    return F.expr(f"substring({query}, instr({query}, '_') + 1)")


def above_cutoff(hits: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Hits whose bit score reaches the cut-off (cog, cutoff) of their group; groups without one are dropped."""
    return hits.join(cutoffs, "cog").filter("bitscore >= cutoff").drop("cutoff")


def best_hits(hits: DataFrame) -> DataFrame:
    """(query, cog, bitscore): the group of the highest score of each query; queries whose best hits disagree are dropped."""
    best = Window.partitionBy("query")
    top = hits.withColumn("top", F.max("bitscore").over(best)).filter("bitscore = top")
    return top.groupBy("query").agg(F.min("cog").alias("cog"), F.max("cog").alias("other"), F.max("bitscore").alias("bitscore")).filter("cog = other").drop("other")


def accuracy(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: the share of rows whose prediction is right."""
    return rows.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))
