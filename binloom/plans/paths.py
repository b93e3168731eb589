"""Three more ways from evidence to bins: by density of clusters, by peaks of an embedding, by deconvolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import clustering, counts, embedding, neighbour_index, nmf, priors
from binloom.operators.order import ranked
from binloom.plans import binning
from binloom.storage import cut


def density_bins(table: DataFrame, sequences: DataFrame, d1: float = 1.0) -> DataFrame:
    """(centre, contig): leaders' clusters summed up, and followed to clusters of high density that are far from denser ones.

    ``table`` has (sample, contig, count), ``sequences`` (name, seq).
    """
    known = binning.evidence(table, sequences)
    members = cut(binning.lead(known).filter("owned").select("contig", F.col("leader").alias("cluster")))
    sized = sequences.select(F.col("name").alias("contig"), F.length("seq").alias("length"))
    sums = clustering.cluster_profiles(members, table, sized)
    reads = counts.profiles(sums.select(F.col("cluster").alias("contig"), "sample", "count"))
    lengths = sums.groupBy(F.col("cluster").alias("id")).agg(F.max("length").alias("length"))
    words = members.join(known.profiles.select("contig", F.posexplode("kmer").alias("i", "n")), "contig").groupBy("cluster", "i").agg(F.sum("n").alias("n"))
    kmers = words.groupBy(F.col("cluster").alias("contig")).agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("k")).select("contig", F.col("k.n").alias("kmer"))
    dense = clustering.densities_by_tiles(reads.join(kmers, "contig"), lengths, known.alpha, known.kmer_alpha, d1)
    return clustering.merged_lists(clustering.assign_centres(dense), members)


def embedding_bins(points: DataFrame, dimensions: int, first: int = 4, enough: int = embedding.ENOUGH_LENGTH) -> DataFrame:
    """(id, peak, cluster) of embedded contigs (id, embedding, length): density peaks, linked where the valley between is shallow."""
    index = neighbour_index.build(points)
    found = embedding.adaptive_neighbours(points, first, enough, search=lambda k: index.search(points, k, exact=True))
    lists = cut(embedding.neighbourhoods(found, points, dimensions, enough))
    peaks = cut(embedding.density_peaks(lists))
    clusters = embedding.peak_clusters(peaks, embedding.valley_edges(lists, peaks))
    return peaks.join(clusters, "id")


def peaks_by_length(peaks: DataFrame, points: DataFrame) -> DataFrame:
    """(ordinal, peak, length, members): peaks (id, peak) by falling length of their contig, ties by id."""
    sizes = peaks.groupBy("peak").agg(F.count(F.lit(1)).alias("members")).join(points.select(F.col("id").alias("peak"), "length"), "peak")
    return ranked(sizes, F.col("length").desc(), "peak", name="ordinal").select("ordinal", "peak", "length", "members")


def deconvolved_bins(table: DataFrame, members: DataFrame, lengths: DataFrame, most: int = nmf.MOST_RANK) -> tuple[DataFrame, DataFrame]:
    """(cluster, component, bin, members, z) and the components themselves, from clusters (contig, cluster).

    The counts (contig, sample, count) of each cluster are split into few profiles, and components of like
    profiles joined again where they are plausible genomes by length (contig, length).
    """
    _, prior = priors.dirichlet_prior(table)
    parts = cut(nmf.deconvolve(table, members, most, prior))
    joined = nmf.join_components(parts, lengths, prior)
    return nmf.component_members(parts).join(joined, ["cluster", "component"]), parts
