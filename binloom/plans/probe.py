"""Command line of the linear probe: how well known labels can be read off latent vectors."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import hits, latent, normalise
from binloom.plans.binning import session
from binloom.sources import sinks, text
from binloom.storage import cut


def probed(latents: DataFrame, labels: DataFrame, names: DataFrame, steps: int = 300) -> DataFrame:
    """(name, label, prediction, probability, held_out) of rows (row, values), (row, label) and (row, name)."""
    codes = normalise.dense_labels(labels, "label", "row").select("label", "code")
    points = latents.join(labels, "row").join(codes, "label").select(F.col("row").alias("id"), F.col("values").alias("embedding"), F.col("code").alias("label"))
    found = latent.probe(points, steps=steps).join(names.withColumnRenamed("row", "id"), "id")
    back = codes.select(F.col("code").alias("prediction"), F.col("label").alias("called"))
    return found.join(F.broadcast(codes.select(F.col("code").alias("label"), F.col("label").alias("known"))), "label").join(F.broadcast(back), "prediction").select(
        "name", F.col("known").alias("label"), F.col("called").alias("prediction"), F.array_max("probability").alias("probability"), "held_out"
    )  # a row for each label


def numbered_lines(spark, path: str, name: str) -> DataFrame:
    """(row, name) of a text file's lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("row", name))
    return lines.withColumn("row", F.col("row").cast("long"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Linear probe of latent vectors")
    parser.add_argument("--latent", required=True, help="latent vectors, .npy or .npz")
    parser.add_argument("--otuids", required=True, help="text file of labels, in order")
    parser.add_argument("--names", required=True, help="text file of names, in order")
    parser.add_argument("--outdir", required=True)
    args = parser.parse_args(argv)
    spark = session()
    found = cut(probed(text.read_matrix(spark, args.latent), numbered_lines(spark, args.otuids, "label"), numbered_lines(spark, args.names, "name")))
    sinks.write_table(found.select("name", "prediction"), f"{args.outdir}/bins", "\t")
    sinks.write_table(found.select("name", "probability"), f"{args.outdir}/probabilities", "\t")
    sinks.write_table(hits.accuracy(found.filter("held_out"), "prediction", "label"), f"{args.outdir}/accuracy", "\t")


if __name__ == "__main__":
    main()
