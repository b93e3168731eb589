"""Clustering of profiles: greedy leaders, their links, and density on cluster profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.operators import distance, graph
from binloom.operators.distance import TILE_ROWS
from binloom.storage import cut

LEADER_DISTANCE = 1.0
#: A centre's separation exceeds the first and density times separation the second.
LEAST_SEPARATION, LEAST_PRODUCT = 1.0, 1000.0


#: Contig b is visited before a: the fuller one first, of equally full ones the one of larger id.
_BEFORE = "(tb > ta OR tb = ta AND b > a)"


def _decided(pairs: DataFrame, d0: float) -> DataFrame:
    """(contig, state) for ``pairs`` (a, b, d, ta, tb, self_b): leader, taken or left.

    A contig is taken if a leader before it is nearer than d0.  If none is, it leads as soon as some contig is
    nearer to it than to all leaders before it, and is left if there is no such contig.  A round decides every
    contig whose answer no undecided one before it can change; the first undecided one is always among them.
    """
    before = Window.partitionBy("b").orderBy(F.col("ta").desc(), F.col("a").desc()).rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit(float("inf"))
    state = cut(pairs.filter("a = b").select(F.col("a").alias("contig"), F.lit("open").alias("state")))
    while True:
        met = pairs.join(state.select(F.col("contig").alias("a"), F.col("state").alias("sa")), "a").join(state.select(F.col("contig").alias("b"), F.col("state").alias("sb")), "b")
        led = F.coalesce(F.min(F.when(F.col("sa") == "leader", F.col("d"))).over(before), far)
        may = F.coalesce(F.min(F.when(F.col("sa") == "open", F.col("d"))).over(before), far)
        # a leader far from itself has joined its own cluster at that distance
        wide = F.expr(_BEFORE) & (F.col("self_b") > d0)
        sure_limit = F.when(wide & (F.col("sb") == "leader"), F.col("self_b")).otherwise(d0)
        open_limit = F.when(wide & F.col("sb").isin("leader", "open"), F.col("self_b")).otherwise(d0)
        takes = met.select(
            "a", "b", "sa", (F.col("d") < F.least(sure_limit, led, may)).alias("sure"), (F.col("d") < F.least(open_limit, led)).alias("possible"),
            ((F.col("a") == F.col("b")) & (led < d0)).alias("hit"), ((F.col("a") == F.col("b")) & (may < d0)).alias("wait"),
        )
        found = takes.filter("sa = 'open'").groupBy("a").agg(*[F.max(c).alias(c) for c in ("sure", "possible", "hit", "wait")])
        new = F.when(F.col("hit"), "taken").when(F.col("wait"), "open").when(F.col("sure"), "leader").when(F.col("possible"), "open").otherwise("left")
        fresh = found.select(F.col("a").alias("contig"), new.alias("new"))
        state = cut(state.join(fresh, "contig", "left").select("contig", F.coalesce("new", "state").alias("state")))
        if state.filter("state = 'open'").isEmpty():
            return state


def leaders(pairs: DataFrame, totals: DataFrame, d0: float = LEADER_DISTANCE) -> DataFrame:
    """(contig, leader, owned) from ``pairs`` (a, b, distance) and ``totals`` (contig, total).

    ``pairs`` must have every ordered pair nearer than max(d0, own distance of b) and all pairs of a contig
    with itself.  Contigs are visited by falling total, then falling id.  One that no leader has taken takes
    every contig that is nearer to it than to its present leader (d0 where it has none); with an own distance
    above d0 it joins its cluster only if it took something.  Who takes nothing and is not taken leads itself.
    Rows with owned give each contig's cluster; the others name every leader within d0.

    The visits are not made one after the other: rounds of joins decide all contigs that depend on nothing
    undecided, and the result is the sequential rule's.
    """
    pairs = cut(pairs)
    own = pairs.filter("a = b").select(F.col("a").alias("b"), F.col("distance").alias("self_b"))
    used = pairs.join(own, "b").filter((F.col("a") == F.col("b")) | (F.col("distance") < F.greatest(F.lit(d0), F.col("self_b"))))
    full = F.col("total").cast("double")
    used = used.join(totals.select(F.col("contig").alias("a"), full.alias("ta")), "a").join(totals.select(F.col("contig").alias("b"), full.alias("tb")), "b")
    used = cut(used.select("a", "b", F.col("distance").alias("d"), "ta", "tb", "self_b"))
    state = _decided(used, d0)
    chosen = state.filter("state = 'leader'").select("contig")
    led = used.join(chosen.withColumnRenamed("contig", "a"), "a", "left_semi").join(chosen.select(F.col("contig").alias("b"), F.lit(True).alias("leads")), "b", "left")
    wide = F.coalesce("leads", F.lit(False)) & (F.col("self_b") > d0)
    takes = F.when(wide, (F.col("a") == F.col("b")) | (F.expr(_BEFORE) & (F.col("d") < F.col("self_b")))).otherwise(F.col("d") < d0)
    led = cut(led.select("a", "b", "d", "ta", takes.alias("takes")))
    # the first of those that are nearest
    owners = led.filter("takes").groupBy("b").agg(F.max_by("a", F.struct(-F.col("d"), F.col("ta"), F.col("a"))).alias("leader"))
    everyone = state.select("contig").join(owners.withColumnRenamed("b", "contig"), "contig", "left")
    owned = everyone.select("contig", F.coalesce("leader", "contig").alias("leader"), F.lit(True).alias("owned"))
    alone = everyone.filter("leader IS NULL").select("contig", F.col("contig").alias("leader"), F.lit(False).alias("owned"))
    notes = led.filter(F.col("d") < d0).select(F.col("b").alias("contig"), F.col("a").alias("leader"), F.lit(False).alias("owned"))
    return owned.union(alone).union(notes)


def bins(found: DataFrame, more_than: int = 5) -> DataFrame:
    """(contig, bin): leaders' clusters merged where leaders share more than so many contigs.

    Leaders that lost all their contigs still link the others.
    """
    found = cut(found)
    links = graph.shared_member_links(found.filter("NOT owned").select("contig", "leader"), more_than)
    groups = graph.components(links.select("a", "b"), found.select(F.col("leader").alias("id")))
    merged = graph.merged_members(found.filter("owned").select("contig", "leader"), groups)
    return merged.select("contig", F.col("comp").alias("bin"))


def cluster_profiles(members: DataFrame, counts: DataFrame, lengths: DataFrame, name: str = "count") -> DataFrame:
    """(cluster, sample, count, length): sums over members (contig, cluster)."""
    sizes = members.join(lengths.select("contig", "length"), "contig").groupBy("cluster").agg(F.sum("length").alias("length"))
    summed = members.join(counts, "contig").groupBy("cluster", "sample").agg(F.sum(name).alias(name))
    return summed.join(sizes, "cluster")


def densities(pairs: DataFrame, lengths: DataFrame, d1: float = 1.0) -> DataFrame:
    """(id, density, separation, nearest) from pairs (a, b, distance) and lengths (id, length).

    Density is the length of all within d1, the cluster itself included whatever its own distance.  The
    nearest of higher density, the least id among equals, gives the separation; without one it is 1e30 and
    the cluster is its own nearest.
    """
    size = lengths.select(F.col("id").alias("b"), "length")
    inside = (F.col("distance") < d1) | (F.col("a") == F.col("b"))
    dense = cut(pairs.join(size, "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.when(inside, F.col("length")).otherwise(0)).alias("density")))
    one, two = dense.select(F.col("id").alias("a"), F.col("density").alias("da")), dense.select(F.col("id").alias("b"), F.col("density").alias("db"))
    higher = pairs.join(one, "a").join(two, "b").filter("db > da").groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m"))
    joined = dense.join(higher.select(F.col("a").alias("id"), "m"), "id", "left")
    return joined.select("id", "density", F.coalesce("m.distance", F.lit(1e30)).alias("separation"), F.coalesce("m.b", "id").alias("nearest"))


def densities_by_tiles(profiles: DataFrame, lengths: DataFrame, alpha: list[float], kmer_alpha: list[float] | None = None, d1: float = 1.0, digits: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The rows of ``densities`` from profiles (contig, profile, and kmer for both kinds of evidence), without a table of pairs.

    Tiles of distances are folded twice: to the length within d1 of each row, then, with densities known, to the nearest
    denser one.  What leaves a tile is one row for each of its rows.
    """
    kind = profiles.schema["contig"].dataType.simpleString()
    sized = cut(profiles.join(lengths.select(F.col("id").alias("contig"), F.col("length").cast("double").alias("length")), "contig"))

    def within(d: np.ndarray, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        inside = (d < d1) | (one["contig"].to_numpy()[:, None] == two["contig"].to_numpy()[None, :])
        return pd.DataFrame({"id": one["contig"].astype(object), "density": inside @ two["length"].to_numpy()})

    def denser(d: np.ndarray, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(two["contig"].to_numpy(), kind="stable")  # the first of those that tie has the least id
        above = np.where(two["density"].to_numpy()[order][None, :] > one["density"].to_numpy()[:, None], d[:, order], np.inf)
        at = above.argmin(axis=1)
        found = np.isfinite(above[np.arange(len(at)), at])
        return pd.DataFrame({"id": one["contig"].astype(object)[found], "distance": above[np.arange(len(at)), at][found], "b": two["contig"].astype(object).to_numpy()[order][at][found]})

    dense = cut(distance.fold_tiles(sized, alpha, kmer_alpha, ["length"], within, f"id {kind}, density double", digits=digits, tile_rows=tile_rows).groupBy("id").agg(F.sum("density").alias("density")))
    known = cut(sized.join(dense.withColumnRenamed("id", "contig"), "contig"))
    higher = distance.fold_tiles(known, alpha, kmer_alpha, ["density"], denser, f"id {kind}, distance double, b {kind}", digits=digits, tile_rows=tile_rows).groupBy("id").agg(F.min(F.struct("distance", "b")).alias("m"))
    joined = dense.join(higher, "id", "left")
    return joined.select("id", "density", F.coalesce("m.distance", F.lit(1e30)).alias("separation"), F.coalesce("m.b", "id").alias("nearest"))


def assign_centres(dense: DataFrame, least_separation: float = LEAST_SEPARATION, least_product: float = LEAST_PRODUCT) -> DataFrame:
    """(id, centre): clusters followed along their nearest to a centre; those that end elsewhere are dropped."""
    centre = (F.col("separation") > least_separation) & (F.col("density") * F.col("separation") > least_product)
    marked = cut(dense.select("id", centre.alias("centre"), F.when(centre, F.col("id")).otherwise(F.col("nearest")).alias("next")))
    roots = graph.follow(marked.select("id", "next"))
    return roots.join(marked.filter("centre").select(F.col("id").alias("root")), "root", "left_semi").select("id", F.col("root").alias("centre"))


def merged_lists(assigned: DataFrame, members: DataFrame) -> DataFrame:
    """(centre, contig): members (contig, cluster) of all clusters (id, centre), repeats kept."""
    return members.join(assigned.withColumnRenamed("id", "cluster"), "cluster").select("centre", "contig")
