"""The binning plan: alignments and sequences to bins, by composing operators."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom import __version__
from binloom.operators import clustering, composition, counts, leaders, priors
from binloom.sources import bam, sinks, text
from binloom.storage import cut


def read_counts(records: DataFrame, contigs: DataFrame, least_identity: float = 97.0) -> DataFrame:
    """(sample, contig, count) of alignment records, zero rows included."""
    entries = counts.fold_contigs(counts.candidates(records, contigs))
    found = cut(counts.contig_counts(counts.read_weights(entries, least_identity)))
    samples = records.select("sample").distinct()
    return counts.with_zero_rows(found, contigs, samples)


@dataclass
class Evidence:
    """Profiles (contig, total, profile, kmer) of the contigs that have counts, and the priors of both kinds."""

    profiles: DataFrame
    alpha: list[float]
    kmer_alpha: list[float]
    by_sample: dict


def evidence(table: DataFrame, sequences: DataFrame) -> Evidence:
    """What binning knows of contigs, from counts (sample, contig, count) and sequences (name, seq)."""
    table = cut(counts.without_empty_samples(table.filter("count > 0")))
    _, by_sample = priors.dirichlet_prior(table)
    profiles = counts.profiles(table)
    chosen = sequences.join(profiles.select(F.col("contig").alias("name")), "name", "left_semi")
    words = composition.without_repeats(composition.halved(composition.long_form(composition.tetramers(chosen))), composition.gc(chosen))
    words = cut(words)
    fitted = {r["kmer"]: r["alpha"] for r in priors.tetramer_priors(words).collect()}  # 256 rows
    kmers = words.groupBy(F.col("name").alias("contig")).agg(F.sort_array(F.collect_list(F.struct("kmer", "n"))).alias("k")).select("contig", F.col("k.n").alias("kmer"))
    both = cut(profiles.join(kmers, "contig"))
    return Evidence(both, [by_sample[s] for s in sorted(by_sample)], [max(fitted.get(i, 0.0), 1e-9) for i in range(256)], by_sample)


def lead(known: Evidence, d0: float = clustering.LEADER_DISTANCE) -> DataFrame:
    """(contig, leader, owned): the leader rule on both kinds of evidence, with distances from leaders only."""
    return leaders.lead(known.profiles, known.alpha, known.kmer_alpha, d0)


def bin_contigs(table: DataFrame, sequences: DataFrame) -> DataFrame:
    """(contig, bin) from counts (sample, contig, count) and sequences (name, seq).

    Contigs without any count are left out.  Priors of both kinds of evidence are fitted first.
    """
    return clustering.bins(lead(evidence(table, sequences)))


def main(argv: list[str] | None = None) -> None:
    """Command line: alignments and contigs to bins."""
    parser = argparse.ArgumentParser(description="Bin contigs by read counts and composition")
    parser.add_argument("-i", "--input", help="folder of BAM or SAM files, grouped by read name")
    parser.add_argument("-c", "--contigs", help="FASTA file of contigs")
    parser.add_argument("-l", "--minlength", type=int, default=2000)
    parser.add_argument("-s", "--seq_identity", type=float, default=97.0)
    parser.add_argument("-o", "--output", default="bins", help="name of the table of bins in the output folder")
    parser.add_argument("--fasta", action="store_true", help="write a FASTA folder for each bin")
    parser.add_argument("-n", "--ncores", type=int, default=0, help="local cores; 0 leaves the master to the session")
    parser.add_argument("-d", "--outdir", help="output folder, the input folder where it isn't given")
    parser.add_argument("-v", "--version", action="store_true", help="print the version and exit")
    parser.add_argument("--format", choices=["bam", "sam"], default="bam")
    args = parser.parse_args(argv)
    if args.version:
        print("binloom", __version__)
        return
    if not (args.input and args.contigs):
        parser.error("-i and -c are needed")
    outdir = args.outdir or args.input
    spark = session(args.ncores)
    if args.format == "bam":
        bam.register(spark)
        records, contigs = spark.read.format("bam").load(args.input), bam.bam_contigs(spark, args.input, args.minlength)
    else:
        records, contigs = text.read_sam(spark, args.input, args.minlength)
        contigs = contigs.select("ref_id", "name", "length").distinct()
    sequences = text.selected(text.read_fasta(spark, args.contigs), contigs)
    table = cut(read_counts(records, contigs, args.seq_identity))
    found = cut(bin_contigs(table, sequences))
    sinks.write_counts(table, f"{outdir}/counts")
    sinks.write_table(found, f"{outdir}/{args.output}", ",")
    if args.fasta:
        sinks.write_bin_fasta(sequences, found, f"{outdir}/fasta")


def session(cores: int = 0) -> SparkSession:
    """The running session, or one on so many local cores."""
    builder = SparkSession.builder.appName("binloom")
    return (builder.master(f"local[{cores}]") if cores else builder).getOrCreate()


if __name__ == "__main__":
    main()
