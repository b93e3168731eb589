"""Densities without pairs, the gamma-Poisson fit by jobs, and drawn communities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import clustering, community, distance, priors


@pytest.mark.parametrize(("n", "tile", "names"), [(60, 4096, False), (60, 9, True), (1, 4096, False)])
def test_densities_by_tiles_equal_those_of_pairs(spark, n, tile, names):
    rng = np.random.default_rng(n + tile)
    x = rng.poisson(rng.dirichlet(np.ones(5), n) * rng.choice([2, 20, 300], (n, 1))).astype(float)
    ids = [f"c{i}" if names else i for i in range(n)]
    kind = "string" if names else "long"
    profiles = spark.createDataFrame([(c, r.tolist()) for c, r in zip(ids, x, strict=True)], f"contig {kind}, profile array<double>")
    lengths = spark.createDataFrame([(c, int(rng.integers(1, 5))) for c in ids], f"id {kind}, length long")
    pairs = distance.pair_distances(profiles, [0.7] * 5).withColumn("distance", F.round("distance", 2))
    wanted = clustering.densities(pairs, lengths, 2.0).collect()
    got = clustering.densities_by_tiles(profiles, lengths, [0.7] * 5, None, 2.0, digits=2, tile_rows=tile).collect()
    key = lambda rows: sorted((str(r["id"]), float(r["density"]), round(r["separation"], 6), str(r["nearest"])) for r in rows)
    assert key(got) == key(wanted)


def test_fit_recovers_its_parameters(spark):
    rng = np.random.default_rng(4)
    t = rng.choice([0.5, 1.0, 4.0], 20_000)
    x = rng.poisson(rng.gamma(2.5, 1 / 0.4, len(t)) * t)
    rows = [(float(a), float(b)) for a, b in zip(x, t, strict=True)]
    a, b = priors.fit_gamma_poisson(spark.createDataFrame([*rows, (None, 1.0), (3.0, None), (3.0, 0.0)], "x double, t double").repartition(3))
    assert a == pytest.approx(2.5, rel=0.05) and b == pytest.approx(0.4, rel=0.05)
    assert (a, b) == pytest.approx(priors.gamma_poisson(rows), rel=1e-3)
    with pytest.raises(ValueError):
        priors.fit_gamma_poisson(spark.createDataFrame([], "x double, t double"))


def test_drawn_numbers_have_their_moments(spark):
    rows = spark.range(40_000).select(community.uniform("id").alias("u"), community.normal("id").alias("z"), community.truncated_geometric(community.uniform("id", seed=5), 8).alias("k"))
    got = rows.agg(F.avg("u").alias("u"), F.avg("z").alias("z"), F.stddev("z").alias("s"), F.min("u").alias("low"), F.max("u").alias("high")).first()
    assert got["u"] == pytest.approx(0.5, abs=0.01) and got["z"] == pytest.approx(0, abs=0.02) and got["s"] == pytest.approx(1, abs=0.02) and 0 < got["low"] < got["high"] < 1
    p, seen = 0.25, {r["k"]: r["count"] / 40_000 for r in rows.groupBy("k").count().collect()}
    whole = 1 - (1 - p) ** 8
    assert set(seen) == set(range(1, 9)) and all(seen[k] == pytest.approx(p * (1 - p) ** (k - 1) / whole, abs=0.01) for k in seen)


def test_community(spark):
    rows = [(g, f"t{g % 30}", 1000 + g) for g in range(600)] + [(None, "t1", 5), (9999, None, 5)]
    genomes = spark.createDataFrame(rows, "genome long, taxon string, size long")
    one = community.community(genomes, 5, 2).collect()
    assert sorted(one) == sorted(community.community(genomes.repartition(7), 5, 2).collect())
    by = {}
    for r in one:
        by.setdefault((r["sample"], r["taxon"]), []).append(r["genome"])
    assert len(by) == 60 and all(1 <= len(v) <= 5 for v in by.values())
    assert all(sorted(by[0, t]) == sorted(by[1, t]) for _, t in by)
    for s in (0, 1):
        mine = [r for r in one if r["sample"] == s]
        assert math.fsum(r["abundance"] for r in mine) == pytest.approx(1) and abs(sum(r["reads"] for r in mine) - 1_000_000) <= len(mine)
    assert community.community(genomes.limit(0), 5).collect() == []
