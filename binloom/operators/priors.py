"""Dirichlet priors of count matrices by one-dimensional maximum likelihood.

The prior of a column is e^a times the column's share of all counts.  Only distinct (column, count) and
distinct totals enter the likelihood; their histograms stay distributed, and one job evaluates a whole grid of
exponents for every matrix that is fitted, so that a few jobs bracket the optimum and a parabola ends the search.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.numeric import log_gamma_np
from binloom.storage import cut

#: Where the exponent is sought; data without any overdispersion have their optimum at infinity and end at the bound.
LOWEST, HIGHEST = -20.0, 30.0
#: Exponents of a grid, and the distance between two at which the parabola is laid.
GRID, FINE = 65, 1e-4
_GOLD = (3 - math.sqrt(5)) / 2


def brent(f: Callable[[float], float], low: float = LOWEST, high: float = HIGHEST, tolerance: float = 1e-8) -> float:
    """Minimum of a unimodal function: golden sections, and parabolas where they help."""
    x = w = v = low + _GOLD * (high - low)
    fx = fw = fv = f(x)
    step = before = 0.0
    for _ in range(200):
        middle, tol = (low + high) / 2, tolerance * abs(x) + 1e-10
        if abs(x - middle) <= 2 * tol - (high - low) / 2:
            break
        golden = True
        if abs(before) > tol:
            r, s = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, s = (x - v) * s - (x - w) * r, 2 * (s - r)
            p, s = (-p, s) if s > 0 else (p, -s)
            if s and abs(p) < abs(s * before / 2) and s * (low - x) < p < s * (high - x):
                before, step, golden = step, p / s, False
        if golden:
            before = high - x if x < middle else low - x
            step = _GOLD * before
        u = x + (step if abs(step) >= tol else math.copysign(tol, step))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def minima(f: Callable[[np.ndarray], np.ndarray], size: int, low: float = LOWEST, high: float = HIGHEST) -> np.ndarray:
    """Where each of ``size`` unimodal functions is least; ``f`` takes (size, GRID) places and gives their values."""
    lows, highs = np.full(size, low), np.full(size, high)
    while True:
        places = lows[:, None] + (highs - lows)[:, None] * np.linspace(0, 1, GRID)[None, :]
        values = f(places)
        at = values.argmin(axis=1)
        rows, step = np.arange(size), (highs - lows) / (GRID - 1)
        if step.max(initial=0.0) <= FINE:
            break
        lows, highs = places[rows, np.maximum(at - 1, 0)], places[rows, np.minimum(at + 1, GRID - 1)]
    inner = (at > 0) & (at < GRID - 1)
    mid = np.clip(at, 1, GRID - 2)
    before, here, after = (values[rows, mid + i] for i in (-1, 0, 1))
    bend = before - 2 * here + after
    shift = np.where(inner & (bend > 0), (before - after) / np.where(bend > 0, 2 * bend, 1.0), 0.0)
    return places[rows, at] + np.clip(shift, -1, 1) * step


def _partial(places: np.ndarray, sign: float):
    """(group, place, value): what rows group, share, x, n add to the negative log likelihood of each place."""

    def run(batches):
        sums = np.zeros(places.shape)
        tops = np.exp(places)
        for batch in batches:
            group, share, x, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "share", "x", "n"))
            for i in range(0, len(group), 4096):
                g = group[i : i + 4096]
                values = log_gamma_np(x[i : i + 4096, None] + tops[g] * share[i : i + 4096, None]) * n[i : i + 4096, None]
                np.add.at(sums, g, sign * values)
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums[at])], ["grp", "place", "value"])

    return run


def fit_groups(counts: DataFrame) -> dict[int, tuple[float, dict]]:
    """{group: (sum of the prior, share of each column)} of long counts (grp, row, col, x), one matrix a group.

    Groups are numbered from 0 and, like columns, are few; rows and distinct counts may be many.
    """
    summed = cut(counts.groupBy("grp", "row", "col").agg(F.sum("x").cast("double").alias("x")))
    totals = cut(summed.groupBy("grp", "row").agg(F.sum("x").alias("x")))
    rows = {r["grp"]: r["n"] for r in totals.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = summed.groupBy("grp", "col").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k")).collect()  # a row for each column
    whole = {g: sum(c["s"] for c in columns if c["grp"] == g) for g in rows}
    size = max(rows, default=-1) + 1
    shares: dict[int, dict] = {g: {} for g in rows}
    zeros: list[tuple[int, float, float]] = []
    for c in columns:
        share = shares[c["grp"]][c["col"]] = c["s"] / whole[c["grp"]] if whole[c["grp"]] > 0 else 0.0
        if share > 0 and rows[c["grp"]] > c["k"]:
            zeros.append((c["grp"], share, rows[c["grp"]] - c["k"]))
    known = [(g, c, v) for g, each in shares.items() for c, v in each.items() if v > 0]
    fitted = [g for g in rows if whole[g] > 0]
    if not fitted:
        return {g: (0.0, shares[g]) for g in rows}
    named = counts.sparkSession.createDataFrame(known, f"grp int, col {counts.schema['col'].dataType.simpleString()}, share double")
    one = F.count(F.lit(1)).cast("double").alias("n")
    cells = cut(summed.groupBy("grp", "col", "x").agg(one).join(F.broadcast(named), ["grp", "col"]).select("grp", "share", "x", "n"))
    sides = cut(totals.groupBy("grp", "x").agg(one).select("grp", F.lit(1.0).alias("share"), "x", "n"))

    def values(places: np.ndarray) -> np.ndarray:
        kind = "grp int, place int, value double"
        parts = cells.mapInArrow(_partial(places, -1.0), kind).union(sides.mapInArrow(_partial(places, 1.0), kind))
        out, tops = np.zeros(places.shape), np.exp(places)
        for r in parts.groupBy("grp", "place").agg(F.sum("value").alias("value")).collect():  # groups x places
            out[r["grp"], r["place"]] = r["value"]
        for g, share, n in zeros:
            out[g] -= n * log_gamma_np(tops[g] * share)
        for g in fitted:
            each = np.array([v for v in shares[g].values() if v > 0])
            out[g] -= rows[g] * (log_gamma_np(tops[g]) - log_gamma_np(tops[g][:, None] * each[None, :]).sum(axis=1))
        return out

    tops = np.exp(minima(values, size))
    return {g: (float(tops[g]) if whole[g] > 0 else 0.0, shares[g]) for g in rows}


def dirichlet_prior(counts: DataFrame, name: str = "count") -> tuple[float, dict]:
    """(sum of the prior, prior of each sample) of long counts (contig, sample, count)."""
    long = counts.select(F.lit(0).alias("grp"), F.col("contig").alias("row"), F.col("sample").alias("col"), F.col(name).cast("double").alias("x"))
    top, shares = fit_groups(long).get(0, (0.0, {}))
    return top, {k: top * v for k, v in shares.items()}


def tetramer_priors(counts: DataFrame) -> DataFrame:
    """(kmer, alpha) of long tetramer counts (name, kmer, n): a fit for each of the 64 trimers, all in the same jobs."""
    trimer = F.floor(F.col("kmer") / 4).cast("int")
    found = fit_groups(counts.select(trimer.alias("grp"), F.col("name").alias("row"), F.col("kmer").cast("int").alias("col"), F.col("n").cast("double").alias("x")))
    rows = [(k, top * v) for top, shares in found.values() for k, v in shares.items()]
    return counts.sparkSession.createDataFrame(sorted(rows), "kmer int, alpha double")


def gamma_poisson(rows: list[tuple[float, float]], start: tuple[float, float] = (0.0, 0.0), steps: int = 400) -> tuple[float, float]:
    """(a, b) of a gamma-Poisson mixture for (count, exposure) rows, by simplex search over their logarithms."""
    x, t = (np.array(c, dtype=float) for c in zip(*rows, strict=True))

    def cost(p: np.ndarray) -> float:
        a, b = np.exp(np.clip(p, -30, 30))
        return -float((log_gamma_np(x + a) - log_gamma_np(np.array([a]))[0] + a * np.log(b) - (x + a) * np.log(t + b)).sum())

    points = [np.array(start, float), np.array(start, float) + [0.5, 0], np.array(start, float) + [0, 0.5]]
    values = [cost(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        centre = (points[0] + points[1]) / 2
        mirrored = 2 * centre - points[2]
        value = cost(mirrored)
        if value < values[0]:
            further = 3 * centre - 2 * points[2]
            better = cost(further)
            points[2], values[2] = (further, better) if better < value else (mirrored, value)
        elif value < values[1]:
            points[2], values[2] = mirrored, value
        else:
            inner = (centre + (mirrored if value < values[2] else points[2])) / 2
            best = cost(inner)
            if best < min(value, values[2]):
                points[2], values[2] = inner, best
            else:
                points = [points[0], *((p + points[0]) / 2 for p in points[1:])]
                values = [values[0], *(cost(p) for p in points[1:])]
    a, b = np.exp(points[int(np.argmin(values))])
    return float(a), float(b)


#: Points a side of the grid that one job evaluates, and the narrowest grid.
GRID_SIDE, GRID_END = 13, 1e-6


def fit_gamma_poisson(rows: DataFrame) -> tuple[float, float]:
    """(a, b) of a gamma-Poisson mixture for rows (x, t) of counts and exposures, by jobs over their histogram.

    Likelihoods of a grid over the logarithms of the mean a / b and of a are added up where the distinct pairs lie; the
    grid moves while its best point is at the edge and shrinks around it otherwise.  Nulls and exposures of 0 are left out.
    """
    cells = cut(rows.filter("x IS NOT NULL AND t > 0").select(F.col("x").cast("double").alias("x"), F.col("t").cast("double").alias("t")).groupBy("x", "t").agg(F.count(F.lit(1)).cast("double").alias("n")))
    whole = cells.agg(F.sum(F.col("x") * F.col("n")).alias("x"), F.sum(F.col("t") * F.col("n")).alias("t")).first()
    if not whole["x"]:
        raise ValueError("no counts to fit")

    def likelihoods(mean: np.ndarray, shape: np.ndarray) -> np.ndarray:
        a, b = np.exp(shape), np.exp(shape - mean)

        def run(batches):
            sums = np.zeros(len(a))
            for batch in batches:
                x, t, n = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("x", "t", "n"))
                for i in range(0, len(x), 4096):
                    s = slice(i, i + 4096)
                    sums += (n[s] * (log_gamma_np(x[s] + a) - log_gamma_np(a) - a * np.log1p(t[s] / b) + x[s] * (np.log(t[s]) - np.log(t[s] + b)))).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)), pa.int32()), pa.array(sums)], ["place", "value"])

        found = np.zeros(len(a))
        for r in cells.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # a row a grid point
            found[r["place"]] = r["value"]
        return found

    centre, width = np.array([math.log(whole["x"] / whole["t"]), 0.0]), np.array([2.0, 8.0])
    while width.max() > GRID_END:
        steps = np.linspace(-1, 1, GRID_SIDE)
        mean, shape = (g.ravel() for g in np.meshgrid(centre[0] + width[0] * steps, centre[1] + width[1] * steps, indexing="ij"))
        best = int(np.argmax(likelihoods(mean, shape)))
        at = np.array(divmod(best, GRID_SIDE))
        centre = np.array([mean[best], shape[best]])
        if abs(centre[1]) > 25:
            break  # as good as Poisson, or without any mean
        width = np.where((at == 0) | (at == GRID_SIDE - 1), width, width * 4 / (GRID_SIDE - 1))
    return float(np.exp(centre[1])), float(np.exp(centre[1] - centre[0]))
