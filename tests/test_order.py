"""Whole-table ranks, order statistics, spanning forests and bounded paths against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from binloom.operators import graph, order
from binloom.storage import cut


def test_ranks_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(2000)]
    got = order.ranked(spark.createDataFrame(rows, "x int, i int").repartition(5), F.col("x").desc(), "i").collect()
    wanted = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert {r["rank"]: (r["x"], r["i"]) for r in got} == dict(enumerate(wanted))
    assert order.ranked(spark.createDataFrame([], "x int"), "x").collect() == []


@pytest.mark.parametrize(("kind", "last"), [("spread", 50), ("ties", 50), ("wide", 20), ("even", 10_000), ("one", 5), ("two", 0)])
def test_median_is_exact(spark, monkeypatch, kind, last):
    monkeypatch.setattr(order, "LAST_VALUES", last)
    rng = random.Random(kind)
    values = {
        "spread": [rng.gauss(0, 1) for _ in range(4001)], "ties": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(3000)], "wide": [10 ** rng.uniform(-200, 200) for _ in range(2500)],
        "even": [float(i) for i in range(1000)], "one": [3.0], "two": [1.0, 4.0],
    }[kind]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    assert order.exact_median(rows, "v") == statistics.median(values)
    ranks = [0, len(values) - 1, len(values) // 3]
    assert order.order_statistics(rows, "v", ranks) == [sorted(values)[r] for r in ranks]


def test_median_of_nothing(spark):
    assert order.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None


@pytest.mark.parametrize("seed", range(4))
def test_forest_widths_equal_widest_paths(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 9))) for _ in range(60 if seed % 2 else 35)]
    edges += [(100 + i, 101 + i, float(rng.randrange(1, 9))) for i in range(20)]
    table = spark.createDataFrame(edges, "a long, b long, w double")
    forest = graph.spanning_forest(table)
    both = table.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(table.filter("a <> b").select("b", "a", "w"))
    ids = both.select(F.col("src").alias("id")).distinct()
    wanted = {(r["start"], r["id"]): r["width"] for r in graph.widest_paths(both, ids).collect() if r["start"] != r["id"]}
    pairs = ids.select(F.col("id").alias("start")).crossJoin(ids).filter("start <> id")
    got = {(r["start"], r["id"]): r["width"] for r in graph.forest_widths(forest, pairs).collect()}
    assert got == wanted
    nodes = {x for e in edges if e[0] != e[1] for x in e[:2]}
    trees = graph.components(table.filter("a <> b").select("a", "b")).select("comp").distinct().count()
    assert forest.count() == len(nodes) - trees


def test_bounded_paths_are_the_wider_ones(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(25), rng.randrange(25), rng.random()) for _ in range(80)], "src long, dst long, w double")
    starts = spark.createDataFrame([(i, 0.1 * (i % 7)) for i in range(25)], "id long, least double")
    least = {r["id"]: r["least"] for r in starts.collect()}
    plain = {(r["start"], r["id"], r["width"]) for r in graph.widest_paths(edges, starts.select("id")).collect()}
    got = {(r["start"], r["id"], r["width"]) for r in graph.widest_paths(edges, starts).collect()}
    assert got == {p for p in plain if p[2] > least[p[0]]} and len(got) < len(plain)


def test_widths_along_a_deep_tree_take_few_rounds(spark, monkeypatch):
    """A chain of 600 nodes is 599 levels deep; its labels are logarithmic."""
    rng = random.Random(5)
    weights = [float(rng.randrange(1, 1000)) for _ in range(599)]
    chain = spark.createDataFrame([(i, i + 1, w) for i, w in enumerate(weights)], "a long, b long, w double")
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: (cuts.append(1), cut(df))[1])
    pairs = spark.createDataFrame([(i, (i * 37 + 5) % 600) for i in range(0, 600, 3)], "start long, id long").filter("start <> id")
    got = {(r["start"], r["id"]): r["width"] for r in graph.forest_widths(chain, pairs).collect()}
    assert got == {(r["start"], r["id"]): min(weights[min(r) : max(r)]) for r in pairs.collect()}
    assert len(cuts) < 60
    assert graph.path_labels(chain).select(F.max(F.size("path"))).first()[0] <= 11


@pytest.mark.parametrize("tile", [(1000, 1000), (7, 4)])
def test_widths_by_tiles_equal_widest_paths(spark, tile):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.randrange(40), rng.random() if i % 9 else None) for i in range(130)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    starts = spark.createDataFrame([(i, 0.1 * (i % 7) if i else None) for i in range(0, 45, 2)], "id long, least double")
    ends = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "id long")
    wanted = {(r["start"], r["id"], r["width"]) for r in graph.widest_paths(edges, starts).collect() if r["id"] % 3 == 0 and r["id"] < 40 and r["start"] != r["id"]}
    got = [(r["start"], r["id"], r["width"]) for r in graph.widths_between(edges, starts, ends, *tile).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def widest(rows, least, wanted):
    """(start, id, width) of paths from starts to the nodes that are wanted, by relaxation."""
    found = set()
    for start, bound in least.items():
        known, changed = {start: float("inf")}, bound is not None
        while changed:
            changed = False
            for src, dst, w in rows:
                new = min(known.get(src, -1.0), float("inf") if w is None else w)
                if new > bound and new > known.get(dst, -1.0):
                    known[dst], changed = new, True
        found |= {(start, x, width) for x, width in known.items() if bound is not None and x in wanted and x != start}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_widths_by_a_hub_equal_widest_paths(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 30) / 8 if i % 9 else None) for i in range((90, 240, 30)[seed])]
    edges = cut(spark.createDataFrame(rows, "src long, dst long, w double"))
    least = {i: 0.1 * (i % 17) if i else None for i in range(0, 66, 2)}
    starts = spark.createDataFrame([(i, x, i / 4) for i, x in least.items()], "id long, least double, density double")
    ends = spark.createDataFrame([(i,) for i in range(0, 63, 3)] * 2, "id long")
    monkeypatch.setattr(graph, "TASK_STARTS", 9)
    monkeypatch.setattr(graph, "TILE_ENDS", 8)
    searched = []
    monkeypatch.setattr(graph, "widths_between", lambda *a, known=graph.widths_between: (searched.append(a), known(*a))[1])
    got = [tuple(r) for r in graph.widths_by_hub(edges, starts, ends, 0 if seed else 100).collect()]
    assert len(got) == len(set(got)) and set(got) == {(*r, r[0] / 4) for r in widest(rows, least, range(0, 63, 3))}
    # two to choose the hub, one to it and one from it, one each way for what is wider
    assert len(searched) == (6 if seed else 1)


def test_searches_past_a_hub_are_short(spark, monkeypatch):
    """On a ring where every node is as dense as another, nothing is wider than over the hub, so that no start follows the ring."""
    edges = cut(spark.createDataFrame([(i, (i + 1) % 300, 1.0) for i in range(300)], "src long, dst long, w double"))
    nodes = spark.createDataFrame([(i, 0.5) for i in range(300)], "id long, least double")
    asked = []
    monkeypatch.setattr(graph, "widths_between", lambda *a, known=graph.widths_between: (asked.append(a[1]), known(*a))[1])
    got = graph.widths_by_hub(edges, nodes, nodes.select("id"), 0)
    assert got.agg(F.count("id"), F.min("width"), F.max("width")).first()[:] == (300 * 299, 1.0, 1.0)
    assert all(bounds.agg(F.min("least")).first()[0] >= 1.0 for bounds in asked[-2:])
