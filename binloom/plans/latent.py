"""Command line of the bins' network: matrices in, latent vectors, losses and the model out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators import latent
from binloom.plans.binning import session
from binloom.sources import sinks, text


def profiles_of(spark: SparkSession, reads: str, kmers: str) -> DataFrame:
    """(contig, profile, kmer): rows of two matrix files, .npy or .npz, side by side by number."""
    one = text.read_matrix(spark, reads).select(F.col("row").alias("contig"), F.col("values").alias("profile"))
    return one.join(text.read_matrix(spark, kmers).select(F.col("row").alias("contig"), F.col("values").alias("kmer")), "contig")


def run(spark: SparkSession, profiles: DataFrame, outdir: str, epochs: int = latent.EPOCHS, **shape) -> None:
    """Trains on all rows, and writes latent vectors, weights and losses below ``outdir``."""
    net, losses = latent.fit_with_losses(profiles, epochs, **shape)
    sinks.write_columns(latent.transform(profiles, net), f"{outdir}/latent")
    sinks.write_model(net, spark, f"{outdir}/model", losses)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Latent vectors of bins from read and k-mer profiles")
    parser.add_argument("--reads_matrix", required=True, help="pseudo-counts of bins, .npy or .npz")
    parser.add_argument("--kmers_matrix", required=True, help="k-mer counts summed over bins, .npy or .npz")
    parser.add_argument("--outdir", required=True)
    parser.add_argument("--nlatent", type=int, default=latent.LATENT)
    parser.add_argument("--kmerweight", type=float, default=latent.KMER_WEIGHT)
    parser.add_argument("--epochs", type=int, default=latent.EPOCHS)
    parser.add_argument("--hidden", type=int, default=latent.HIDDEN)
    args = parser.parse_args(argv)
    spark = session()
    profiles = profiles_of(spark, args.reads_matrix, args.kmers_matrix)
    run(spark, profiles, args.outdir, args.epochs, latent=args.nlatent, kmer_weight=args.kmerweight, hidden=args.hidden)


if __name__ == "__main__":
    main()
