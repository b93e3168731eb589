"""An inverted-file index of embedded points: cells around centres, exact distances inside, and a proof for the rest.

Centres are fitted on a bounded sample; every point is filed under its nearest centre.  A search opens the cells whose
centres are nearest to a query and ranks what they hold by exact distances.  The exact search then opens every further
cell that could hold a nearer point by the triangle inequality: a cell is out of reach when its centre is further away
than its radius and the query's k-th distance together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.operators.embedding import closest, top_ranks
from binloom.storage import cut, cut_counted

#: Points that centres are fitted on at most, centres at most, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 8_192, 8
#: Points, and queries, of one tile at most: whole cells are bundled up to so many points, and a fuller cell is split.
#: Queries of a tile that are ranked at once.  Rows that are measured against all centres at once.
TILE_ROWS, TURN_ROWS, STRIP_ROWS = 32_768, 2048, 256
PROBES = 8


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct points of the sample; a centre that loses all its points stays."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:cells]].astype(float)
    for _ in range(rounds):
        at = nearest_cells(sample, centres, 1)[0][:, 0]
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the nearest centres of each row, nearest first, and their distances."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T, 0.0))
    order = np.argsort(d, axis=1, kind="stable")[:, :probes]
    return order, np.take_along_axis(d, order, axis=1)


@dataclass
class Index:
    """Centres, their cells' radii and sizes, and the filed points (id, v, cell)."""

    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    filed: DataFrame

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(id, neighbour, rank, distance): the k nearest filed points of each query (id, embedding); a point itself has rank 0.

        With ``exact`` the rows are those of ``embedding.nearest``; otherwise of the points in the ``probes`` nearest
        cells.  Ties go by id.
        """
        asked, count = cut_counted(queries.select("id", F.col("embedding").alias("v")))
        found = top_ranks(self._met(self._opened(asked, probes), count, k), k)
        if not exact:
            return found
        found = cut(found)
        last = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        reach = F.when(F.coalesce("n", F.lit(0)) < k, float("inf")).otherwise(F.sqrt("far"))
        further = self._opened(asked.join(last, "id", "left").withColumn("reach", reach), probes, beyond=True)
        return top_ranks(found.select("id", "neighbour", "distance").unionByName(self._met(further, count, k)), k)

    def probes_for(self, wanted: DataFrame, queries: DataFrame, least: float = 0.9) -> int:
        """The fewest cells to open that hold so large a share of the neighbours ``wanted`` (id, neighbour) of some queries.

        ``wanted`` comes of an exact search for them; what comes to the driver is a row a cell.
        """
        centres = self.centres
        asked = queries.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        pairs = wanted.filter("id <> neighbour").join(self.filed.select(F.col("id").alias("neighbour"), "cell"), "neighbour").groupBy("id").agg(F.collect_list("cell").alias("cells"))  # k at most

        def run(batches):
            for part in batches:
                for at in range(0, len(part), STRIP_ROWS):
                    strip = part.iloc[at : at + STRIP_ROWS]
                    order, _ = nearest_cells(np.stack(strip["v"]).astype(float), centres, len(centres))
                    places = np.argsort(order, axis=1)
                    yield pd.DataFrame({"place": np.concatenate([p[c] for p, c in zip(places, strip["cells"], strict=True)])})

        found = pairs.join(asked, "id").select("v", "cells").mapInPandas(run, "place int").groupBy("place").count().collect()
        held, total = 0, sum(r["count"] for r in found)
        for r in sorted(found):
            held += r["count"]
            if held >= least * total:
                return r["place"] + 1
        return 1

    def _bundles(self) -> tuple[np.ndarray, np.ndarray]:
        """The bundle of every cell, and the points of every bundle: neighbours in number, of so many points that there are tiles for all cores."""
        cores = self.filed.sparkSession.sparkContext.defaultParallelism
        most = min(TILE_ROWS, -(-int(self.sizes.sum()) // math.ceil(math.sqrt(2 * cores))))
        bundles, held = np.zeros(len(self.sizes), dtype=np.int64), [0]
        for cell, n in enumerate(self.sizes.tolist()):
            if held[-1] and held[-1] + n > most:
                held.append(0)
            bundles[cell], held[-1] = len(held) - 1, held[-1] + n
        return bundles, np.array(held)

    def _opened(self, asked: DataFrame, probes: int, beyond: bool = False) -> DataFrame:
        """(id, v, bundle, cells): the nearest cells of each query by their bundles, or those ``beyond`` them that its reach doesn't rule out."""
        centres, radii, sizes, bundles = self.centres, self.radii, self.sizes, self._bundles()[0]

        def run(batches):
            for part in batches:
                for at in range(0, len(part), STRIP_ROWS):
                    strip = part.iloc[at : at + STRIP_ROWS]
                    order, d = nearest_cells(np.stack(strip["v"]).astype(float), centres, len(centres))
                    chosen = np.zeros(order.shape, dtype=bool)
                    chosen[:, :probes] = True
                    if beyond:
                        # a little more than the reach, as both sides are rounded
                        chosen = ~chosen & (d - radii[order] <= strip["reach"].to_numpy()[:, None] * (1 + 1e-6) + 1e-9)
                    i, j = np.nonzero(chosen & (sizes[order] > 0))
                    cells = order[i, j]
                    to = np.lexsort((cells, bundles[cells], i))
                    i, cells = i[to], cells[to]
                    first = np.flatnonzero(np.diff(i, prepend=-1) | np.diff(bundles[cells], prepend=-1))
                    if not len(first):
                        continue
                    lists = np.split(cells, first[1:])
                    yield pd.DataFrame({"id": strip["id"].to_numpy()[i[first]], "v": strip["v"].to_numpy()[i[first]], "bundle": bundles[cells[first]], "cells": lists})

        kind = asked.schema["v"].dataType.simpleString()
        return asked.select("id", "v", *(["reach"] if beyond else [])).mapInPandas(run, f"id long, v {kind}, bundle int, cells array<int>")

    def _met(self, opened: DataFrame, asked: int, k: int) -> DataFrame:
        """(id, neighbour, distance): of the cells opened in a bundle the k nearest points of each query, from tiles of bounded size.

        A query is sent once to a bundle, and a point once to every turn of the ``asked`` queries.
        """
        spark, (bundles, held) = opened.sparkSession, self._bundles()
        parts = -(-held // TILE_ROWS)
        least = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
        turns = max(1, -(-asked // TILE_ROWS), min(least, -(-asked // STRIP_ROWS)))
        plan = [(c, int(b), max(1, int(parts[b]))) for c, b in enumerate(bundles)]
        places = F.broadcast(spark.createDataFrame(plan, "cell int, c int, parts int"))  # a row a cell
        split = F.broadcast(spark.createDataFrame(sorted({row[1:] for row in plan}), "bundle int, parts int"))
        part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        filed = self.filed.join(places, "cell").withColumn("p", part(F.col("parts")))
        filed = filed.select(F.col("id").alias("neighbour"), F.col("v").alias("w"), "cell", "c", "p", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("t"))
        posed = opened.join(split, "bundle").select("id", "v", "cells", "bundle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), part(F.lit(turns)).alias("turn"))

        def tile(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            if one.empty or two.empty:
                return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
            x, ids, y, names = np.stack(one["v"]).astype(float), one["id"].to_numpy(), np.stack(two["w"]).astype(float), two["neighbour"].to_numpy()
            cells, at = np.unique(two["cell"].to_numpy(), return_inverse=True)
            members = [np.flatnonzero(at == i) for i in range(len(cells))]
            found = []
            for start in range(0, len(x), TURN_ROWS):
                turn = slice(start, start + TURN_ROWS)
                chosen = np.stack([np.isin(cells, c) for c in one["cells"].iloc[turn]])
                if chosen.mean() > 0.5:  # most cells are open: all at once, without the others
                    parts = closest(x[turn], ids[turn], y, names, k, chosen if not chosen.all() else None, at)
                else:
                    parts = []
                    for i, rows in enumerate(members):
                        who = start + np.flatnonzero(chosen[:, i])
                        parts += closest(x[who], ids[who], y[rows], names[rows], k) if len(who) else []
                if parts:
                    found.append(_first(pd.concat(parts), k))
            return pd.concat(found) if found else pd.DataFrame({"id": [], "neighbour": [], "distance": []})

        return posed.groupBy("bundle", "part", "turn").cogroup(filed.groupBy("c", "p", "t")).applyInPandas(tile, "id long, neighbour long, distance double")


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k first rows of each id, in the order of ``top_ranks``."""
    ids, names, d = (found[c].to_numpy() for c in ("id", "neighbour", "distance"))
    order = np.lexsort((names, d, ids != names, ids))
    new = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1)) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
    return found.iloc[order[rank < k]]


def build(points: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of ``points`` (id, embedding), with about the square root of their number of cells unless told otherwise.

    Centres are fitted on the driver from at most ``sample`` points, those of least hash; every point is filed.
    """
    vectors = points.select("id", F.col("embedding").alias("v"))
    count = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    wanted = cells or min(MOST_CELLS, max(1, round(math.sqrt(count))))
    centres = centres_of(np.stack(chosen).astype(float), wanted) if count else np.zeros((1, 1))

    def file(batches):
        for part in batches:
            for at in range(0, len(part), STRIP_ROWS):
                strip = part.iloc[at : at + STRIP_ROWS]
                order, d = nearest_cells(np.stack(strip["v"]).astype(float), centres, 1)
                yield strip.assign(cell=order[:, 0], d=d[:, 0])[["id", "v", "cell", "d"]]

    filed = cut(vectors.mapInPandas(file, f"id long, v {vectors.schema['v'].dataType.simpleString()}, cell int, d double"))
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in filed.groupBy("cell").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        radii[r["cell"]], sizes[r["cell"]] = r["d"], r["n"]
    return Index(centres, radii, sizes, filed.select("id", "v", "cell"))


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row wanted, met, recall: how many pairs (id, neighbour) of ``wanted`` are in ``found``; those of a point with itself aside."""
    pairs = wanted.filter("id <> neighbour").select("id", "neighbour")
    met = pairs.join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return met.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("met")).withColumn("recall", F.col("met") / F.nullif("wanted", F.lit(0)))
