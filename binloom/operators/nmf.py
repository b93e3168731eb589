"""Deconvolution of a cluster's counts into few profiles (non-negative factors under Poisson likelihood).

Each cluster is small and is worked on by numpy in one group: X (samples x contigs) ~ W^T Z.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.numeric import ENTROPY_E, LARGE_MEAN, chi2_sf, log_gamma_np
from binloom.operators import clustering
from binloom.operators.distance import own_distances, pair_distances, tile_distances
from binloom.storage import cut

#: Ridge of the first factors, highest rank, level of the likelihood ratio test, size below which a parameter does not count.
RIDGE, MOST_RANK, LEVEL, TINY = 0.1, 19, 0.01, 1e-17
ITERATIONS, TOLERANCE = 2000, 1e-10
#: Chance that two contigs are of one genome, in the distances by which seeds are found.
SEED_Q = math.exp(-7.0)
#: Components nearer than this are one bin.
JOIN_DISTANCE = 0.001
#: Base pairs of a bin that is kept.
LEAST_SIZE, MOST_SIZE = 100_000, 10_000_000


def first_factors(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Z by ridge least squares, made positive: |(W W^T + 0.1 I)^-1 W X|; w is rank x samples, x samples x contigs."""
    return np.abs(np.linalg.solve(w @ w.T + RIDGE * np.eye(len(w)), w @ x)) + 1e-12


def poisson_entropy(mean: np.ndarray) -> np.ndarray:
    """Entropy of Poisson variables: a series up to a mean of 5, an asymptotic expansion beyond."""
    mean = np.maximum(mean, 1e-12)
    k = np.arange(1, 50)
    log_k = np.array([math.lgamma(i + 1) for i in k])
    small = np.minimum(mean, LARGE_MEAN)
    series = (np.exp(k * np.log(small)[..., None] - log_k) * log_k).sum(axis=-1)
    low = small - small * np.log(small) + np.exp(-small) * series
    high = 0.5 * np.log(2 * np.pi * ENTROPY_E * mean) - 1 / (12 * mean) - 1 / (24 * mean**2) - 19 / (360 * mean**3)
    return np.where(mean > LARGE_MEAN, high, low)


def likelihood_gaps(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """How far each contig's mean log likelihood is above what its factors let expect."""
    mean = np.maximum(mean, 1e-12)
    found = x * np.log(mean) - mean - log_gamma_np(x + 1)
    return (found + poisson_entropy(mean)).mean(axis=0)


def first_seeds(x: np.ndarray, alpha: np.ndarray) -> list[int]:
    """Two contigs far from each other by the Bayesian distance: the farthest from the fullest, and the farthest from that."""
    rows = x.T

    def far(i: int) -> np.ndarray:
        return tile_distances(rows[i : i + 1], rows, alpha, 1, SEED_Q)[0]

    one = int(np.argmax(far(int(np.argmax(x.sum(axis=0))))))
    order = np.argsort(-far(one), kind="stable")
    return [one, int(next((i for i in order if i != one), one))]


def next_seed(gaps: np.ndarray, chosen: list[int]) -> int:
    """The contig of the largest gap that is no seed yet."""
    left = gaps.copy()
    left[chosen] = -np.inf
    return int(np.argmax(left))


def profiles_of(x: np.ndarray, chosen: list[int]) -> np.ndarray:
    """Rows of W: the seeds' profiles as shares, nowhere zero."""
    w = x[:, chosen].T + 1e-3
    return w / w.sum(axis=1, keepdims=True)


def log_likelihood(x: np.ndarray, mean: np.ndarray) -> float:
    return float((x * np.log(mean) - mean - log_gamma_np(x + 1)).sum())


def factorise(x: np.ndarray, chosen: list[int], iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, float]:
    """W, Z and the log likelihood by multiplicative updates from seed contigs; stops when it no longer grows."""
    w = profiles_of(x, chosen)
    z = first_factors(w, x)
    last = -np.inf
    for step in range(iterations):
        z *= (w @ (x / np.maximum(w.T @ z, 1e-12))) / np.maximum(w.sum(axis=1)[:, None], 1e-12)
        w *= ((x / np.maximum(w.T @ z, 1e-12)) @ z.T).T / np.maximum(z.sum(axis=1)[:, None], 1e-12)
        size = np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
        w, z = w / size, z * size
        if step % 50 == 49:
            now = log_likelihood(x, np.maximum(w.T @ z, 1e-12))
            if now - last < TOLERANCE * abs(now):
                break
            last = now
    return w, z, log_likelihood(x, np.maximum(w.T @ z, 1e-12))


def select_rank(x: np.ndarray, most: int = MOST_RANK, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Factors of the best rank: ranks grow while the likelihood ratio test finds them better, then the highest AIC wins.

    The first two seeds are far from each other, every further one is the contig that the factors so far explain
    least as expected.  ``alpha`` is the prior of each sample, shares of the counts where it isn't given.
    """
    n, c = x.shape
    alpha = x.sum(axis=1) / x.sum() * n if alpha is None else alpha
    chosen = first_seeds(x, np.maximum(alpha, 1e-9)) if c > 1 else [0]
    best, score, last = None, -np.inf, None
    for rank in range(1, min(most, c) + 1):
        if rank > len(chosen):
            chosen.append(next_seed(gaps, chosen))
        w, z, value = factorise(x, chosen[:rank])
        gaps = likelihood_gaps(x, w.T @ z)
        parameters = int((w > TINY).sum() + (z > TINY).sum())
        if value - parameters > score:
            best, score = (w, z, value), value - parameters
        if last is not None and chi2_sf(max(0.0, 2 * (value - last)), max(1, n + c - 2 * rank)) >= LEVEL:
            break
        last = value
    return best


def deconvolve(counts: DataFrame, members: DataFrame, most: int = MOST_RANK, prior: dict | None = None) -> DataFrame:
    """(cluster, component, contig, z, sample_counts): components of each cluster, long over their contigs.

    ``counts`` is (contig, sample, count), ``members`` (contig, cluster).  z is the contig's share, and
    sample_counts maps samples to the component's pseudo-counts, its profile times the sum of its z.
    ``prior`` (sample: prior) enters the distances by which seeds are found.
    Samples without counts in a cluster are left out of its factors, and so of the map.  A contig is in
    each component that it has a share of; ``main`` marks the largest.
    """
    rows = counts.join(members, "contig").select("cluster", "contig", "sample", F.col("count").cast("double").alias("count"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        matrix = part.pivot_table(index="sample", columns="contig", values="count", aggfunc="sum", fill_value=0.0)
        matrix = matrix.loc[matrix.sum(axis=1) > 0].sort_index()
        out = []
        if matrix.size:
            alpha = np.array([prior.get(s, 0.0) for s in matrix.index]) if prior else None
            w, z, _ = select_rank(matrix.to_numpy(float), most, alpha)
            for k in range(len(w)):
                pseudo = dict(zip(map(str, matrix.index), (w[k] * z[k].sum()).tolist(), strict=True))
                out += [(part["cluster"].iloc[0], k, c, float(z[k, i]), bool(k == int(np.argmax(z[:, i]))), pseudo) for i, c in enumerate(matrix.columns) if z[k, i] > TINY]
        return pd.DataFrame(out, columns=["cluster", "component", "contig", "z", "main", "sample_counts"])

    cluster, contig = members.schema["cluster"].dataType.simpleString(), counts.schema["contig"].dataType.simpleString()
    return rows.groupBy("cluster").applyInPandas(run, f"cluster {cluster}, component int, contig {contig}, z double, main boolean, sample_counts map<string,double>")


def component_members(parts: DataFrame) -> DataFrame:
    """(cluster, component, members, z): ragged lists, contigs where the component is the main one."""
    listed = F.sort_array(F.collect_list(F.struct("contig", "z")))
    return parts.filter("main").groupBy("cluster", "component").agg(listed.alias("m")).select("cluster", "component", F.col("m.contig").alias("members"), F.col("m.z").alias("z"))


def kept_bins(sizes: DataFrame, least: int = LEAST_SIZE, most: int = MOST_SIZE) -> DataFrame:
    """Bins (bin, length) of a plausible genome size."""
    return sizes.filter(F.col("length").between(least, most))


def join_components(parts: DataFrame, lengths: DataFrame, prior: dict, d0: float = JOIN_DISTANCE, q: float = SEED_Q) -> DataFrame:
    """(cluster, component, bin): components (see ``deconvolve``) of like pseudo-counts joined by the leader rule.

    Components whose contigs (contig, length) are no plausible genome in size are left alone.  A bin is known
    by its leader's cluster and component.
    """
    key = F.concat_ws("/", F.col("cluster").cast("string"), F.col("component").cast("string"))
    named = parts.withColumn("contig_", F.col("contig")).drop("contig").withColumn("contig", key)
    sizes = named.filter("main").join(lengths.select(F.col("contig").alias("contig_"), "length"), "contig_").groupBy("contig").agg(F.sum("length").alias("length"))
    samples = sorted(prior)
    profile = F.array(*[F.coalesce(F.element_at("sample_counts", F.lit(str(s))), F.lit(0.0)) for s in samples])
    whole = named.groupBy("contig", "cluster", "component").agg(F.first("sample_counts").alias("sample_counts")).withColumn("profile", profile)
    whole = cut(whole.join(sizes, "contig", "left").withColumn("total", F.aggregate("profile", F.lit(0.0), lambda a, x: a + x)))
    good = whole.filter(F.coalesce("length", F.lit(0)).between(LEAST_SIZE, MOST_SIZE))
    alpha = [prior[s] for s in samples]
    bound = max(d0, own_distances(good, alpha, None, q).agg(F.max("distance")).first()[0] or 0.0)
    pairs = pair_distances(good, alpha, bound + 1e-9, None, q)
    led = clustering.leaders(pairs, good.select("contig", "total"), d0).filter("owned").select("contig", F.col("leader").alias("bin"))
    return whole.select("contig", "cluster", "component").join(led, "contig", "left").select("cluster", "component", F.coalesce("bin", "contig").alias("bin"))
