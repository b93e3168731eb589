"""Neighbours, densities and density peaks of embedded contigs.

Points are rows (id, embedding, length).  Distances are squared Euclidean, exact, over tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions.numeric import local_density
from binloom.operators import graph
from binloom.operators.distance import blocks_of, met_blocks
from binloom.operators.order import exact_median
from binloom.storage import cut, cut_round

#: Length of neighbours that makes a neighbourhood, contigs below SHORT use SHORT_NEIGHBOURS of them.
ENOUGH_LENGTH, SHORT, SHORT_NEIGHBOURS = 500_000, 8_000, 10
#: Points of a tile's side at most.  Every point is sent to each of its block's tiles and leaves k candidates in each, so few large ones.
TILE_ROWS = 65_536
#: Rows and columns of the distances that a task holds at once.
STRIP_ROWS, STRIP_COLUMNS = 256, 4096


def closest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, names: np.ndarray, k: int, chosen: np.ndarray | None = None, at_y: np.ndarray | None = None) -> list[pd.DataFrame]:
    """(id, neighbour, distance) of the k rows of y nearest to each of x, and of those that tie with the last; a row itself is the first.

    With ``chosen``, a row of x sees those rows of y only whose column in ``chosen``, by ``at_y``, is set.
    """
    keep, parts, width = min(k, len(y)), [], max(STRIP_COLUMNS, k)
    turned, squares = -2 * y.T, (y**2).sum(1)
    own = pd.DataFrame({"id": ids, "row": np.arange(len(x))}).dropna().merge(pd.DataFrame({"id": names, "column": np.arange(len(y))}), "inner", "id")[["row", "column"]].to_numpy()
    for at in range(0, len(x), STRIP_ROWS):
        part, found, bound = x[at : at + STRIP_ROWS], [], None
        square = (part**2).sum(1)
        slack = lambda edge: edge + 1e-9 * np.maximum(edge + square, 1.0)  # noqa: B023, E731  edges lack the row's own square
        mine = own[(own[:, 0] >= at) & (own[:, 0] < at + len(part))]
        for first in range(0, len(y), width):
            d = part @ turned[:, first : first + width]
            d += squares[first : first + width]
            here = mine[(mine[:, 1] >= first) & (mine[:, 1] < first + width)]
            d[here[:, 0] - at, here[:, 1] - first] = -np.inf
            if chosen is not None:
                d[~chosen[at : at + len(part)][:, at_y[first : first + width]]] = np.inf
            if bound is None:
                # the k-th of some columns is no less than the k-th of all, so only what is as near is put in order
                bound = slack(np.nan_to_num(np.partition(d, keep - 1, axis=1)[:, keep - 1], nan=np.inf, posinf=np.inf, neginf=-np.inf))
            i, j = np.divmod(np.flatnonzero(d <= bound[:, None]), d.shape[1])
            found.append((i, j + first, d[i, j]))
        i, j, near = (np.concatenate(c) for c in zip(*found, strict=True))
        i, j, near = (c[near < np.inf] for c in (i, j, near))
        order, count = np.lexsort((near, i)), np.bincount(i, minlength=len(part))
        full, edge = count >= keep, np.full(len(part), np.inf)
        edge[full] = near[order[(np.cumsum(count) - count)[full] + keep - 1]]
        # one more than needed may tie at the edge, so all that tie stay
        held = near <= slack(edge)[i]
        i, j = i[held], j[held]
        exact = ((part[i] - y[j]) ** 2).sum(1)
        parts.append(pd.DataFrame({"id": ids[at + i], "neighbour": names[j], "distance": exact}))
    return parts


def top_ranks(found: DataFrame, k: int) -> DataFrame:
    """Adds rank to (id, neighbour, distance), a point itself first, then by distance, ties by id; keeps k a point."""
    order = Window.partitionBy("id").orderBy((F.col("id") != F.col("neighbour")).cast("int"), "distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def nearest(points: DataFrame, k: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, neighbour, rank, distance): the k nearest points of each, itself at rank 0; ties by id.

    Blocks of points meet in tiles; each tile keeps k candidates a point, and a window keeps k of those.
    """
    # as they are stored: floats are sent as floats, and become doubles in the tiles
    vectors = points.select("id", F.col("embedding").alias("v"))
    left, right = met_blocks(vectors, "id", blocks_of(points, points.count(), tile_rows))

    def tile(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        x, y, ids, names = np.stack(one["v"]).astype(float), np.stack(two["v_2"]).astype(float), one["id"].to_numpy(), two["id_2"].to_numpy()
        parts = closest(x, ids, y, names, k)
        if one["i"].iloc[0] != one["j"].iloc[0]:
            parts += closest(y, names, x, ids, k)
        return pd.concat(parts)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i_2", "j_2")).applyInPandas(tile, "id long, neighbour long, distance double")
    return top_ranks(found, k)


def with_running_length(neighbours: DataFrame, lengths: DataFrame, enough: int = ENOUGH_LENGTH) -> DataFrame:
    """Adds running, the length of the neighbours up to a rank, and cut, the first rank where it exceeds ``enough`` (0 if none)."""
    size = lengths.select(F.col("id").alias("neighbour"), "length")
    along = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = neighbours.join(size, "neighbour").withColumn("running", F.sum("length").over(along)).drop("length")
    return summed.withColumn("cut", F.coalesce(F.min(F.when(F.col("running") > enough, F.col("rank"))).over(Window.partitionBy("id")), F.lit(0)))


def adaptive_neighbours(points: DataFrame, first: int = 4, enough: int = ENOUGH_LENGTH, least_share: float = 0.5, search: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """Nearest neighbours, k growing by half until enough of the points have long enough neighbourhoods.

    At least one more than the neighbours of short contigs are kept, and never more than there are points.  ``search``
    gives the rows of ``nearest`` for a k; one search serves all k up to twice the one that was asked for, so that
    growing k does not measure every distance again.
    """
    total, k, held, known = points.count(), first, None, 0
    search = search or (lambda n: nearest(points, n))
    while True:
        k = min(k, total)
        kept = max(k, min(total, SHORT_NEIGHBOURS + 1))
        if kept > known:
            known = min(total, 2 * kept)
            held = cut(with_running_length(search(known), points.select("id", "length"), enough))
        reached = held.filter((F.col("rank") == k - 1) & (F.col("running") > enough)).count()
        if k == total or reached / max(total, 1) >= least_share:
            # the first rank with enough length counts only where it is among those kept
            return cut(held.filter(F.col("rank") < kept).withColumn("cut", F.when(F.col("cut") < kept, F.col("cut")).otherwise(0)))
        k = int(k * 1.5)


def median_radius(found: DataFrame, lengths: DataFrame, enough: int = ENOUGH_LENGTH) -> DataFrame:
    """One row, radius: the exact median distance at which neighbourhoods are long enough; null if none is."""
    at = found.filter("rank = cut").join(lengths.select("id", "length"), "id").filter((F.col("cut") > 0) | (F.col("length") > enough))
    return found.sparkSession.createDataFrame([(exact_median(cut(at.select("distance")), "distance"),)], "radius double")


def neighbourhoods(found: DataFrame, points: DataFrame, dimensions: int, enough: int = ENOUGH_LENGTH) -> DataFrame:
    """(id, neighbour, rank, density): each point's neighbour list, rank 0 itself, with the density of the point.

    The radius is the distance at the cut, or the median one where that is 0; contigs below 8 kb have the
    distance of rank 10, and ten neighbours.
    """
    radius = median_radius(found, points, enough)
    at = found.groupBy("id").agg(F.max(F.when(F.col("rank") == F.col("cut"), F.col("distance"))).alias("at"), F.max(F.when(F.col("rank") <= SHORT_NEIGHBOURS, F.struct("rank", "distance")))["distance"].alias("tenth"))
    sized = at.join(points.select("id", "length"), "id").crossJoin(F.broadcast(radius))  # one row
    own = F.when(F.col("length") < SHORT, F.col("tenth")).otherwise(F.when(F.col("at") == 0, F.col("radius")).otherwise(F.col("at")))
    dense = sized.select("id", "length", local_density(F.col("length"), own, dimensions).alias("density"))
    kept = found.join(dense, "id").filter(F.when(F.col("length") < SHORT, F.col("rank") < SHORT_NEIGHBOURS).otherwise(F.col("rank") <= F.col("cut")))
    return kept.select("id", "neighbour", "rank", "density")


def density_graph(lists: DataFrame) -> DataFrame:
    """(src, dst, w): edges from a point to its listed neighbours, weighed by the neighbour's density."""
    dense = lists.filter("rank = 0").select(F.col("id").alias("neighbour"), F.col("density").alias("w"))
    return lists.filter("rank > 0").join(dense, "neighbour").select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "w")


def density_peaks(lists: DataFrame) -> DataFrame:
    """(id, peak): every point followed to its densest neighbour, and on, to a point that is its own densest.

    The lowest rank wins among equal densities, so a point that none exceeds stays.
    """
    dense = lists.filter("rank = 0").select(F.col("id").alias("neighbour"), F.col("density").alias("d"))
    best = lists.join(dense, "neighbour").groupBy("id").agg(F.max_by("neighbour", F.struct("d", -F.col("rank"))).alias("next"))
    return graph.follow(best).withColumnRenamed("root", "peak")


def peak_links(lists: DataFrame, peaks: DataFrame, most: float = 0.5) -> DataFrame:
    """(a, b, separability): peaks linked by a widest path; 1 - valley / density of the start is below ``most``."""
    chosen = peaks.select(F.col("peak").alias("id")).distinct()
    dense = lists.filter("rank = 0").select(F.col("id").alias("start"), "density")
    # a narrower path is no link, so none is followed further than that
    least = dense.select(F.col("start").alias("id"), (F.col("density") * (1 - most)).alias("least"), "density")
    # rows are pairs of peaks, which carry the density of their start so that none of them moves
    met = graph.widths_by_hub(cut(density_graph(lists)), chosen.join(least, "id"), chosen)
    linked = met.withColumn("separability", 1 - F.col("width") / F.col("density"))
    return linked.filter(F.col("separability") < most).select(F.col("start").alias("a"), F.col("id").alias("b"), "separability")


def valley_edges(lists: DataFrame, peaks: DataFrame, most: float = 0.5) -> DataFrame:
    """(a, b): pairs of peaks that join the same peaks into clusters as ``peak_links``, without a row for each pair of peaks.

    A peak links to all peaks that it reaches over points dense enough for it.  A point that one peak reaches is reached by no
    peak of higher density unless by that one's path too, so each point needs only the lowest density of a peak that reaches it;
    these spread to a fixed point.  From a point so reached the way to its own peak goes over denser points, so the peak is linked
    as well, and an edge that the lowest peak can take links the peaks of its ends.
    """
    none = F.lit(float("inf"))  # a point without density narrows no path
    own = lists.filter("rank = 0").select("id", "density")
    steps = cut(density_graph(lists).select(F.col("src").alias("id"), "dst", F.coalesce("w", none).alias("w")))
    tops = peaks.select(F.col("peak").alias("id")).distinct().join(own, "id").filter("density IS NOT NULL")
    state = fresh = cut(tops.select("id", F.col("density").alias("low")))
    taken = (1 - F.col("w") / F.col("low")) < most
    while True:
        reached = fresh.join(steps, "id").filter(taken).groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("new"))
        fresh = cut_round(reached.join(state, "id", "left").filter("low IS NULL OR new < low").select("id", F.col("new").alias("low")))
        if fresh.isEmpty():
            break
        state = cut_round(state.union(fresh).groupBy("id").agg(F.min("low").alias("low")))
    one, two = peaks.select("id", F.col("peak").alias("a")), peaks.select(F.col("id").alias("dst"), F.col("peak").alias("b"))
    return state.join(steps, "id").filter(taken).join(one, "id").join(two, "dst").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def peak_clusters(peaks: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): points by the component of their peak."""
    groups = graph.components(links.select("a", "b"), peaks.select(F.col("peak").alias("id")))
    return peaks.join(groups.withColumnRenamed("id", "peak"), "peak").select("id", F.col("comp").alias("cluster"))
