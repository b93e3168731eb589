"""Latent representations of profiles, and a linear probe on them.

``BinRows`` and ``ContigRows`` say what the networks of ``network`` read and predict for bins and for contigs;
training goes over all rows, and executors apply the trained network.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import network
from binloom.operators.network import Head, Network
from binloom.storage import cut

#: Width of hidden layers, of the middle, weights of the k-mer and codon losses.
HIDDEN, LATENT, KMER_WEIGHT, CODON_WEIGHT = 512, 32, 0.1, 1.0
EPOCHS, BATCH = 300, 256
#: Epochs at which the batch doubles, for bins and for contigs.
DOUBLE_AT, CONTIG_DOUBLE_AT = (25, 50, 75, 100), (50, 100)
#: Contigs that are thinned: so long at least, where the share that is kept is a half or more, or less.
THIN_LONG, THIN_LONGER = 4000, 7000
MODES = ("reads", "kmers", "both", "threesources")


def over_mean(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(m.mean(axis=1, keepdims=True), 1e-9)


def inputs(reads: np.ndarray, kmers: np.ndarray) -> np.ndarray:
    """[reads over their mean | k-mers over their mean | log of the total]."""
    total = reads.sum(axis=1, keepdims=True)
    return np.concatenate([over_mean(reads), over_mean(kmers), np.log(np.maximum(total, 1e-9))], axis=1)


def split_counts(counts: np.ndarray, share: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A binomial thinning of whole counts, and what it leaves."""
    whole = np.floor(counts).astype(np.int64)
    kept = rng.binomial(whole, share)
    return kept.astype(float), (whole - kept).astype(float)


def thinned(counts: np.ndarray, lengths: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """Counts of long contigs thinned to a share: the mean of draws from the counts rounded down and up."""
    long = lengths >= (THIN_LONG if share >= 0.5 else THIN_LONGER)
    out = counts.copy()
    low, high = np.floor(counts[long]).astype(np.int64), np.ceil(counts[long]).astype(np.int64)
    out[long] = (rng.binomial(low, share) + rng.binomial(high, share)) / 2
    return out


def half_of_epoch(epoch: int) -> str:
    """Which half's k-mers an epoch reads."""
    return "left" if epoch < 25 or 50 < epoch < 75 else "right"


@dataclass
class BinRows:
    """Read and k-mer profiles of bins, predicted as shares; with ``thin`` from thinned reads, the rest being the target."""

    reads: np.ndarray
    kmers: np.ndarray
    thin: float | None = None

    def __len__(self) -> int:
        return len(self.reads)

    def batch(self, part, epoch, rng):
        reads = target = self.reads[part]
        kmers = self.kmers[part]
        if self.thin is not None and rng is not None:
            reads, target = split_counts(reads, self.thin, rng)
        return inputs(reads, kmers), [m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9) for m in (target, kmers)]


@dataclass
class ContigRows:
    """Profiles of contigs in one of four modes, predicted over their means.

    In training reads are thinned, and with codons the k-mers read are those of one half of the sequence.
    ``centre`` and ``spread`` of k-mers over all rows make them z-scores, which are predicted with squared errors.
    """

    mode: str
    reads: np.ndarray
    kmers: np.ndarray
    lengths: np.ndarray
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    codons: np.ndarray | None = None
    share: float = 0.7
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.reads)

    def _kmers(self, m: np.ndarray) -> np.ndarray:
        return over_mean(m) if self.centre is None else (m - self.centre) / self.spread

    def batch(self, part, epoch, rng):
        raw, kmers = self.reads[part], self.kmers[part]
        target_reads, target_kmers = over_mean(raw), self._kmers(kmers)
        reads = target_reads if rng is None else over_mean(thinned(raw, self.lengths[part], self.share, rng))
        if self.mode == "reads":
            total = reads.sum(axis=1, keepdims=True)
            return np.concatenate([reads, np.log(np.maximum(total, 1e-9))], axis=1), [target_reads]
        if self.mode == "kmers":
            total = over_mean(kmers).sum(axis=1, keepdims=True)
            return np.concatenate([target_kmers, np.log(np.maximum(total, 1e-9))], axis=1), [target_kmers]
        total = np.log(np.maximum(reads.sum(axis=1, keepdims=True), 1e-9))
        if self.mode == "both":
            return np.concatenate([reads, target_kmers, total], axis=1), [target_reads, target_kmers]
        seen = kmers if rng is None else (self.left if half_of_epoch(epoch) == "left" else self.right)[part]
        codons = over_mean(self.codons[part])
        return np.concatenate([reads, self._kmers(seen), codons, total], axis=1), [target_reads, target_kmers, codons]


def bin_network(samples: int, kmers: int = 256, hidden: int = HIDDEN, latent: int = LATENT, kmer_weight: float = KMER_WEIGHT, seed: int = 1) -> Network:
    """Reads and k-mers in, both out as shares."""
    return Network(samples + kmers + 1, (Head("reads", samples), Head("kmers", kmers, kmer_weight)), hidden, latent, seed)


def contig_network(mode: str, samples: int, kmers: int = 256, codons: int = 64, z_scores: bool = False, hidden: int = HIDDEN, latent: int = LATENT, kmer_weight: float = KMER_WEIGHT, codon_weight: float = CODON_WEIGHT, seed: int = 1) -> Network:
    """A network of one of the four modes; one sample alone has narrower layers."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    reads, words, third = Head("reads", samples), Head("kmers", kmers, kmer_weight if mode != "kmers" else 1.0, z_scores), Head("codons", codons, codon_weight)
    heads = {"reads": (reads,), "kmers": (words,), "both": (reads, words), "threesources": (reads, words, third)}[mode]
    return Network(sum(h.size for h in heads) + 1, heads, hidden if samples > 1 else hidden // 2, latent, seed)


def _matrix(table: pa.Table, name: str) -> np.ndarray | None:
    if name not in table.column_names:
        return None
    column = table.column(name).combine_chunks()
    return column.values.to_numpy(zero_copy_only=False).astype(float)[column.offsets[0].as_py() :][: len(column) * len(column[0])].reshape(len(column), -1)


def _bin_rows(thin: float | None):
    return lambda table: BinRows(_matrix(table, "profile"), _matrix(table, "kmer"), thin)


def fit(profiles: DataFrame, epochs: int = EPOCHS, batch: int = BATCH, thin: float | None = None, worker_rows: int = network.WORKER_ROWS, **shape) -> Network:
    """The bins' network, trained on all rows (contig, profile, kmer)."""
    return fit_with_losses(profiles, epochs, batch, thin, worker_rows, **shape)[0]


def fit_with_losses(profiles: DataFrame, epochs: int = EPOCHS, batch: int = BATCH, thin: float | None = None, worker_rows: int = network.WORKER_ROWS, **shape) -> tuple[Network, list[list[float]]]:
    """The network and its losses by epoch and head."""
    rows = profiles.select("contig", "profile", "kmer")
    one = rows.select(F.size("profile").alias("p"), F.size("kmer").alias("k")).first()
    net = bin_network(one["p"], one["k"], **shape)
    return net, network.train(rows, "contig", net, _bin_rows(thin), epochs, batch, DOUBLE_AT, worker_rows)


def kmer_moments(profiles: DataFrame, name: str = "kmer") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each k-mer's counts, 1 where there is none."""
    long = profiles.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = sorted(long.collect(), key=lambda r: r["i"])  # a row for each k-mer
    return np.array([r["m"] for r in rows]), np.array([r["s"] or 1.0 for r in rows])


def _contig_rows(mode: str, share: float, moments: tuple | None):
    centre, spread = moments or (None, None)

    def made(table: pa.Table) -> ContigRows:
        lengths = table.column("length").to_numpy().astype(float)
        return ContigRows(mode, _matrix(table, "profile"), _matrix(table, "kmer"), lengths, _matrix(table, "left"), _matrix(table, "right"), _matrix(table, "codon"), share, centre, spread)

    return made


@dataclass
class ContigModel:
    """A trained network of contigs, with what its inputs need, and its losses."""

    mode: str
    net: Network
    moments: tuple | None
    history: list[list[float]]
    validation: dict[str, float]
    tested: dict[str, float]


def fit_contigs(
    profiles: DataFrame, mode: str = "both", epochs: int = EPOCHS, batch: int = BATCH, share: float = 0.7, z_scores: bool = False, worker_rows: int = network.WORKER_ROWS, **shape
) -> ContigModel:
    """The contigs' network, trained on eight tenths of all rows, validated and tested on a tenth each.

    Rows have contig, length, profile and kmer, and for "threesources" left and right (k-mers of the halves) and
    codon.  Training thins the reads of long contigs, reads k-mers of the left or the right half by turns where
    there are codons, and doubles batches at epochs 50 and 100.
    """
    names = ["contig", "length", "profile", "kmer", *(["left", "right", "codon"] if mode == "threesources" else [])]
    rows = cut(profiles.select(*names))
    one = rows.select(*[F.size(c).alias(c) for c in names[2:]]).first()
    moments = kmer_moments(rows) if z_scores else None
    net = contig_network(mode, one["profile"], one["kmer"], one["codon"] if mode == "threesources" else 0, z_scores, **shape)
    train, validate, test = network.shares(rows, "contig", net.seed)
    made = _contig_rows(mode, share, moments)
    history = network.train(train, "contig", net, made, epochs, batch, CONTIG_DOUBLE_AT, worker_rows)
    return ContigModel(mode, net, moments, history, network.test(validate, net, made), network.test(test, net, made))


def contig_latent(profiles: DataFrame, model: ContigModel) -> DataFrame:
    """(contig, latent) of every row, nothing drawn."""
    kind = profiles.schema["contig"].dataType.simpleString()
    held, made = profiles.sparkSession.sparkContext.broadcast(model.net), _contig_rows(model.mode, 1.0, model.moments)
    names = [c for c in ("contig", "length", "profile", "kmer", "left", "right", "codon") if c in profiles.columns]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, _ = made(pa.Table.from_batches([b])).batch(np.arange(b.num_rows), 0, None)
                yield pa.RecordBatch.from_arrays([b.column("contig"), pa.array(list(held.value.encode(x)), pa.list_(pa.float64()))], ["contig", "latent"])

    return profiles.select(*names).mapInArrow(run, f"contig {kind}, latent array<double>")


def transform(profiles: DataFrame, model: Network) -> DataFrame:
    """(contig, latent) by one pass over (contig, profile, kmer)."""
    kind = profiles.schema["contig"].dataType.simpleString()
    held = profiles.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in batches:
            if len(part):
                z = held.value.encode(inputs(np.stack(part["profile"]).astype(float), np.stack(part["kmer"]).astype(float)))
                yield pd.DataFrame({"contig": part["contig"], "latent": list(z)})

    return profiles.select("contig", "profile", "kmer").mapInPandas(run, f"contig {kind}, latent array<double>")


def principal_components(points: DataFrame, k: int = LATENT, name: str = "embedding") -> DataFrame:
    """(id, latent): the default representation, principal components of arrays."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = points.select("id", array_to_vector(F.transform(name, lambda x: x.cast("double"))).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="z").fit(vectors).transform(vectors).select("id", vector_to_array("z").alias("latent"))


def probe(points: DataFrame, name: str = "embedding", label: str = "label", share: float = 0.8, seed: int = 1, steps: int = 100) -> DataFrame:
    """(id, label, prediction, probability, held_out): multinomial regression on vectors; a hash keeps a fifth out of the fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    held_out = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) >= int(share * 1000)
    rows = points.select("id", F.col(label).cast("int").alias("label"), F.transform(name, lambda x: x.cast("double")).alias("x"), held_out.alias("held_out"))
    fitted = rows.filter("NOT held_out").select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    model = LogisticRegression(family="multinomial", maxIter=steps).fit(fitted)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def run(batches):
        for part in batches:
            if len(part):
                chances = network.softmax(np.stack(part["x"]) @ weights.T + bias)
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "prediction": chances.argmax(axis=1), "probability": list(chances), "held_out": part["held_out"]})

    kind = points.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, label int, prediction int, probability array<double>, held_out boolean")
