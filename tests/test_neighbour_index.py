"""The index against all pairs: exact search gives the same rows, the other one a measured share of them."""

import numpy as np
import pytest

from binloom.operators import embedding, neighbour_index


def points_of(spark, seed, n, width, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (12, width))
    x = centres[rng.integers(12, size=n)] + rng.normal(0, 1, (n, width))
    x[: copies] = x[0]
    x = np.round(x, 2)
    rows = [(int(i), [float(v) for v in r], int(rng.integers(1000, 300_000))) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, length long").repartition(3)


def rows_of(found):
    return sorted((r["id"], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in found.collect())


@pytest.mark.parametrize(("n", "width", "copies", "tile"), [(300, 3, 0, 2048), (300, 16, 40, 16), (25, 2, 25, 4), (1, 4, 0, 8)])
def test_exact_search_equals_all_pairs(spark, monkeypatch, n, width, copies, tile):
    monkeypatch.setattr(neighbour_index, "TILE_ROWS", tile)
    rows = points_of(spark, n + width, n, width, copies)
    index = neighbour_index.build(rows)
    wanted = embedding.nearest(rows, 6)
    assert rows_of(index.search(rows, 6, probes=2, exact=True)) == rows_of(wanted)
    assert int(index.sizes.sum()) == n


def test_recall_of_the_opened_cells(spark):
    rows = points_of(spark, 1, 2000, 8)
    index, asked = neighbour_index.build(rows), rows.filter("id % 50 = 0")
    wanted = index.search(asked, 10, exact=True)
    few, more = (neighbour_index.recall(index.search(asked, 10, probes=p), wanted).first() for p in (1, 8))
    assert few["wanted"] == more["wanted"] == 40 * 9
    assert more["recall"] >= 0.9 and more["met"] >= few["met"]
    for least in (0.5, 0.9, 1.0):
        probes = index.probes_for(wanted, asked, least)
        assert neighbour_index.recall(index.search(asked, 10, probes), wanted).first()["recall"] >= least
        assert probes == 1 or neighbour_index.recall(index.search(asked, 10, probes - 1), wanted).first()["recall"] < least


def test_growing_k_searches_once_for_several(spark):
    rows, asked = points_of(spark, 5, 120, 3), []

    def search(k):
        asked.append(k)
        return embedding.nearest(rows, k)

    plain = embedding.adaptive_neighbours(rows, first=4, enough=3_000_000)
    grown = embedding.adaptive_neighbours(rows, first=4, enough=3_000_000, search=search)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, grown.collect()))
    k = grown.agg({"rank": "max"}).first()[0] + 1
    assert k > 11 and len(asked) < 4 and asked[-1] >= k


def test_index_of_nothing(spark):
    rows = points_of(spark, 2, 1, 4).limit(0)
    index = neighbour_index.build(rows)
    assert index.search(rows, 3, exact=True).collect() == []
    assert neighbour_index.recall(index.search(rows, 3), index.search(rows, 3)).first()["recall"] is None


def test_a_query_is_sent_once_to_a_bundle_of_cells(spark, monkeypatch):
    rows = points_of(spark, 7, 900, 3)
    index = neighbour_index.build(rows)
    asked = rows.selectExpr("id", "embedding AS v")
    every = index._opened(asked, len(index.centres))
    assert len(index.centres) == 30 and every.count() <= 4 * 900
    assert every.selectExpr("sum(size(cells))").first()[0] == 900 * int((index.sizes > 0).sum())
    monkeypatch.setattr(neighbour_index, "TURN_ROWS", 7)
    for probes in (1, 5, 25):
        opened = {(r["id"], c) for r in index._opened(asked, probes).collect() for c in r["cells"]}
        cell = {r["id"]: r["cell"] for r in index.filed.collect()}
        found = index.search(rows, 6, probes).collect()
        assert all((r["id"], cell[r["neighbour"]]) in opened for r in found)


def test_tiles_are_few(spark):
    # each point goes to as many tiles as there are blocks, and leaves its nearest in each
    assert embedding.blocks_of(spark.range(1), 600_000, embedding.TILE_ROWS) <= 40
