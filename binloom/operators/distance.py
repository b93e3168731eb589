"""Bayesian distances between count profiles with a Dirichlet prior.

For profiles x, y with totals X, Y, prior a with sum A:
t1 = sum_n [G(x+a) + G(y+a) - G(x+y+a)] - sum_n G(a),  t2 = G(X+A) + G(Y+A) - G(X+Y+A) - G(A),
d = ln(1 + exp(t1 - t2) (1 - q) / q), G being log-gamma.  What depends on one profile alone is computed
once for each profile.  Two kinds of evidence add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions.numeric import log1p_exp, log_gamma, log_gamma_np
from binloom.storage import cut_counted

#: Prior odds: q is the chance that two profiles are of one genome.
Q = math.exp(-8.0)
#: Contigs of a tile's side at most, at least where there are cores for more tiles, and of a strip of it.
TILE_ROWS, LEAST_TILE_ROWS, STRIP_ROWS = 4096, 16, 256
#: Values of log-gamma in a table at most, and of a piece of a tile's terms.
TABLE_VALUES, PIECE_VALUES = 1 << 20, 500_000
#: Rows of a tile's other side from which terms are looked up a row of the first side at a time.
WIDE_ROWS = 1024
#: Tasks that tiles are dealt to at most.
MOST_TASKS = 20_000


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def log_product(x: Column, y: Column, alpha: Column) -> Column:
    """sum of G(x+a) + G(y+a) - G(x+y+a) over the positions of three arrays."""
    terms = F.zip_with(F.arrays_zip(x.alias("x"), y.alias("y")), alpha, lambda p, a: log_gamma(p["x"] + a) + log_gamma(p["y"] + a) - log_gamma(p["x"] + p["y"] + a))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def profile_distance(x: Column, y: Column, total_x: Column, total_y: Column, alpha: list[float], q: float = Q) -> Column:
    """The distance as an expression over two array columns and their totals."""
    whole = sum(alpha)
    prior = sum(float(v) for v in log_gamma_np(np.array(alpha))) - float(log_gamma_np(np.array([whole]))[0])
    sides = log_gamma(total_x + whole) + log_gamma(total_y + whole) - log_gamma(total_x + total_y + whole)
    return log1p_exp(log_product(x, y, literal_array(alpha)) - sides - prior + math.log((1 - q) / q))


def kmer_distance(x: Column, y: Column, alpha: list[float], q: float = Q) -> Column:
    """The distance of two tetramer arrays, each trimer's four words being a context with a total of its own."""

    def trimers(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(alpha) // 4 - 1)), lambda t: F.aggregate(F.slice(v, t * 4 + 1, 4), F.lit(0.0), lambda acc, n: acc + n))

    context = [sum(alpha[i : i + 4]) for i in range(0, len(alpha), 4)]
    prior = float(log_gamma_np(np.array(alpha)).sum() - log_gamma_np(np.array(context)).sum())
    terms = log_product(x, y, literal_array(alpha)) - log_product(trimers(x), trimers(y), literal_array(context))
    return log1p_exp(terms - prior + math.log((1 - q) / q))


def combined_distance(reads_x: Column, reads_y: Column, total_x: Column, total_y: Column, kmers_x: Column, kmers_y: Column, alpha: list[float], kmer_alpha: list[float], q: float = Q) -> Column:
    """The sum of both distances as an expression over array columns: counts with totals, and 256 tetramers."""
    return profile_distance(reads_x, reads_y, total_x, total_y, alpha, q) + kmer_distance(kmers_x, kmers_y, kmer_alpha, q)


def own_of(x: np.ndarray, alpha: np.ndarray, k: np.ndarray | None = None, kmer_alpha: np.ndarray | None = None, q: float = Q, digits: int | None = None) -> np.ndarray:
    """Each row's distance from itself."""

    def log_odds(m: np.ndarray, prior: np.ndarray, groups: int) -> np.ndarray:
        context = prior.reshape(groups, -1).sum(axis=1)
        total = m.reshape(len(m), groups, -1).sum(axis=2)
        part = lambda v, p: (2 * log_gamma_np(v + p) - log_gamma_np(2 * v + p)).sum(axis=1) - log_gamma_np(p).sum()
        return part(m, prior) - part(total, context)

    d = _softened(log_odds(x, alpha, 1), q)
    d = d if k is None else d + _softened(log_odds(k, kmer_alpha, 64), q)
    return d if digits is None else np.round(d, digits)


def _softened(log_odds: np.ndarray, q: float, tiny: float = 0.0) -> np.ndarray:
    """ln(1 + e^z) of the log odds with the prior ones; those below ``tiny`` may come as 0."""
    z = log_odds + math.log((1 - q) / q)
    if tiny:
        # ln(1 + e^z) < e^z
        out, near = np.zeros_like(z), z >= math.log(tiny)
        out[near] = _softened(log_odds[near], q)
        return out
    top = np.maximum(z, 0.0)
    return np.where(np.abs(z) > 350, top, top + np.log1p(np.exp(-np.abs(z))))


def _rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Distances to so many digits, halves up, as SQL rounds them."""
    scaled = d * 10.0**digits
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10.0**digits


def own_distances(profiles: DataFrame, alpha: list[float], kmer_alpha: list[float] | None = None, q: float = Q) -> DataFrame:
    """(contig, distance): each contig's distance from itself, which bounds how near a leader must be."""
    a, k = np.array(alpha, dtype=float), np.array(kmer_alpha, dtype=float) if kmer_alpha else None

    def run(batches):
        for part in batches:
            if len(part):
                x, y = np.stack(part["profile"]).astype(float), None if k is None else np.stack(part["kmer"]).astype(float)
                yield pd.DataFrame({"contig": part["contig"], "distance": own_of(x, a, y, k, q)})

    kind = profiles.schema["contig"].dataType.simpleString()
    return profiles.select("contig", "profile", *(["kmer"] if kmer_alpha else [])).mapInPandas(run, f"contig {kind}, distance double")


def from_query(profiles: DataFrame, query: DataFrame, alpha: list[float], q: float = Q) -> DataFrame:
    """(contig, distance) of every profile from the one row of ``query``."""
    one = query.select(F.col("total").alias("_t"), F.col("profile").alias("_p")).limit(1)
    return profiles.crossJoin(F.broadcast(one)).select("contig", profile_distance(F.col("profile"), F.col("_p"), F.col("total"), F.col("_t"), alpha, q).alias("distance"))


def _summed_terms(x: np.ndarray, y: np.ndarray, alpha: np.ndarray) -> Callable[[slice], np.ndarray]:
    """Gives for rows of x the sums of G(x + y + alpha) over the positions, with each row of y.

    Counts that are whole numbers look their terms up in a table of the same values, where it is smaller than the work.
    """
    priors, at = np.unique(alpha, return_inverse=True)
    whole = x.size > 0 and y.size > 0 and all((m >= 0).all() and (m == np.floor(m)).all() for m in (x, y))
    size = x.max() + y.max() + 1 if whole else math.inf
    if size * len(priors) <= min(TABLE_VALUES, len(x) * y.size):
        size = int(size)
        values = log_gamma_np(np.arange(size) + priors[:, None]).ravel()
        left, right, term = x.astype(np.int64) + at * size, y.astype(np.int64), values.take
        if len(y) >= WIDE_ROWS:
            # a count of x is a place in the table from which those of y are looked up, so no sums of counts are stored
            sides = np.ascontiguousarray(right.T)

            def by_rows(rows: slice) -> np.ndarray:
                some = left[rows]
                out, held = np.zeros((len(some), len(y))), np.empty(len(y))
                for own, total in zip(some, out, strict=True):
                    for first, side in zip(own, sides, strict=True):
                        total += values[first:].take(side, out=held, mode="clip")
                return out

            return by_rows
    else:
        left, right, term = x, y, lambda total: log_gamma_np(total + alpha)
    columns = max(1, PIECE_VALUES // max(1, x.shape[1]))

    def run(rows: slice) -> np.ndarray:
        some = left[rows]
        out = np.empty((len(some), len(right)))
        for j in range(0, len(right), columns):
            part = right[j : j + columns]
            step = max(1, PIECE_VALUES // max(1, part.size))
            for i in range(0, len(some), step):
                out[i : i + step, j : j + columns] = term(some[i : i + step, None, :] + part[None, :, :]).sum(axis=2)
        return out

    return run


def tile_distances(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, groups: int = 1, q: float = Q, tiny: float = 0.0) -> np.ndarray:
    """Distances of all rows of x from all rows of y; those below ``tiny`` may come as 0.

    ``groups`` > 1: columns come in that many equal contexts, each with a total of its own, as for
    tetramers within trimers.
    """
    width = x.shape[1] // groups
    context = alpha.reshape(groups, width).sum(axis=1)
    tx, ty = x.reshape(len(x), groups, width).sum(axis=2), y.reshape(len(y), groups, width).sum(axis=2)
    own = lambda m, t: log_gamma_np(m + alpha).sum(axis=1) - log_gamma_np(t + context).sum(axis=1)
    prior = log_gamma_np(alpha).sum() - log_gamma_np(context).sum()
    out = own(x, tx)[:, None] + own(y, ty)[None, :] - prior
    both, contexts = _summed_terms(x, y, alpha), _summed_terms(tx, ty, context)
    step = max(1, 4_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        s = slice(i, i + step)
        out[s] -= both(s) - contexts(s)
    return _softened(out, q, tiny)


def combined_tile(x, y, alpha, kx=None, ky=None, kmer_alpha=None, q: float = Q, digits: int | None = None) -> np.ndarray:
    """Distances of all rows of x from all rows of y, by both kinds of evidence where there are tetramers."""
    d = tile_distances(x, y, alpha, 1, q)
    if kmer_alpha is not None:
        d = d + tile_distances(kx, ky, kmer_alpha, 64, q)
    return d if digits is None else np.round(d, digits)


def blocks_of(frame: DataFrame, count: int, most_rows: int = TILE_ROWS) -> int:
    """Blocks that rows are dealt to: tiles of two blocks should be many enough for all cores, and no larger than a task holds."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-count // most_rows), min(math.ceil(math.sqrt(2 * cores)), -(-count // LEAST_TILE_ROWS)))


def met_blocks(frame: DataFrame, key: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of tiles (i, j) with i <= j: rows with i and j, and rows with i_2 and j_2, their columns ending in _2."""
    own = frame.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    left = own.select(*frame.columns, F.col("_block").alias("i"), F.explode(F.sequence("_block", F.lit(blocks - 1))).alias("j"))
    # every column of the second side gets a name of its own: both sides come of one frame
    right = own.select(*[F.col(c).alias(f"{c}_2") for c in frame.columns], F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("i_2"), F.col("_block").alias("j_2"))
    return left, right


def pair_distances(profiles: DataFrame, alpha: list[float], below: float | None = None, kmer_alpha: list[float] | None = None, q: float = Q, tile_rows: int = TILE_ROWS, digits: int | None = None) -> DataFrame:
    """(a, b, distance) of all ordered pairs, a pair with itself included; with ``below`` the nearer ones only.

    ``profiles`` has contig, profile and, for the combined distance, kmer (256 values).  Rows are dealt to
    blocks by hash and each pair of blocks is a task of its own, which works in strips, so the quadratic work is
    spread evenly and only the pairs asked for leave a tile, strip by strip, so that a task never holds those of a
    whole tile.  The distance is symmetric, so a tile gives both orders.  With ``digits`` distances are rounded in
    their tile, after ``below``: a rounding expression would take longer than all else that a pair needs.
    """
    names = ["contig", "profile"] + (["kmer"] if kmer_alpha else [])
    profiles, count = cut_counted(profiles.select(*names))
    blocks = blocks_of(profiles, count, tile_rows)
    left, right = met_blocks(profiles, "contig", blocks)
    tiny = 0.5 * 10.0**-digits if digits is not None and not kmer_alpha and (below is None or below > 10.0**-digits) else 0.0
    a_n, k_n = np.array(alpha, dtype=float), np.array(kmer_alpha, dtype=float) if kmer_alpha else None
    kind = profiles.schema["contig"].dataType.simpleString()

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if one.empty or two.empty:
            return
        x, y = np.stack(one["profile"]).astype(float), np.stack(two["profile"]).astype(float)
        kx, ky = (np.stack(one["kmer"]).astype(float), np.stack(two["kmer"]).astype(float)) if k_n is not None else (None, None)
        ids, others, once = one["contig"].to_numpy(), two["contig"].to_numpy(), one["i"].iloc[0] == one["j"].iloc[0]
        for at in range(0, len(x), STRIP_ROWS):
            d = tile_distances(x[at : at + STRIP_ROWS], y, a_n, 1, q, tiny)
            if k_n is not None:
                d = d + tile_distances(kx[at : at + STRIP_ROWS], ky, k_n, 64, q)
            kept = d < below if below is not None else np.ones_like(d, dtype=bool)
            a, b, value = np.repeat(ids[at : at + STRIP_ROWS], kept.sum(axis=1)), np.broadcast_to(others, d.shape)[kept], d[kept]
            value = value if digits is None else _rounded(value, digits)
            yield pd.DataFrame({"a": a, "b": b, "distance": value})
            if not once:
                yield pd.DataFrame({"a": b, "b": a, "distance": value})

    first = left.select("i", "j", F.lit(0).alias("side"), *names)
    second = right.select(F.col("i_2").alias("i"), F.col("j_2").alias("j"), F.lit(1).alias("side"), *[F.col(f"{c}_2").alias(c) for c in names])
    # a tile is a task: rows of tiles are few beside their pairs, so that Spark would put many tiles into one
    tiles = blocks * (blocks + 1) // 2
    tasks, number = min(tiles, MOST_TASKS), F.col("i") * blocks - F.expr("i * (i - 1) div 2") + F.col("j") - F.col("i")
    dealt = first.unionByName(second).withColumn("task", F.pmod(number, F.lit(tasks)).cast("int")).repartitionById(tasks, "task")
    return dealt.groupBy("task", "i", "j").applyInPandas(tile, f"a {kind}, b {kind}, distance double")


def fold_tiles(profiles: DataFrame, alpha: list[float], kmer_alpha: list[float] | None, extra: list[str], fold: Callable, result: str, q: float = Q, digits: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """What ``fold`` makes of the distances of each tile, so that no table of pairs is made.

    ``fold(d, one, two)`` gets the distances of a strip's rows from a tile's other side, both as frames with contig and the
    ``extra`` columns, and gives a frame of ``result`` for the rows of the strip.  Tiles off the diagonal are folded from both sides.
    """
    names = ["contig", "profile", *(["kmer"] if kmer_alpha else []), *extra]
    left, right = met_blocks(profiles.select(*names), "contig", blocks_of(profiles, profiles.count(), tile_rows))
    a, k = np.array(alpha, dtype=float), np.array(kmer_alpha, dtype=float) if kmer_alpha else None

    def tile(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(one) and len(two):
            sides = [{c: (f[f"{c}{end}"].to_numpy() if c in ("contig", *extra) else np.stack(f[f"{c}{end}"]).astype(float)) for c in names} for f, end in ((one, ""), (two, "_2"))]
            for x, y in [sides] if one["i"].iloc[0] == one["j"].iloc[0] else [sides, sides[::-1]]:
                other = pd.DataFrame({c: y[c] for c in ("contig", *extra)})
                for at in range(0, len(x["contig"]), STRIP_ROWS):
                    s = slice(at, at + STRIP_ROWS)
                    d = combined_tile(x["profile"][s], y["profile"], a, x["kmer"][s] if k is not None else None, y.get("kmer"), k, q, digits)
                    parts.append(fold(d, pd.DataFrame({c: x[c][s] for c in ("contig", *extra)}), other))
        return pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in result.split(", ")})

    return left.groupBy("i", "j").cogroup(right.groupBy("i_2", "j_2")).applyInPandas(tile, result)
