"""The ordered sweep against the rule applied contig by contig on the full matrix."""

import numpy as np
import pytest

from binloom.operators import clustering, distance, leaders
from tests.test_clusters import sequential


def profiles_of(seed, n=70, width=5):
    rng = np.random.default_rng(seed)
    centres = rng.dirichlet(np.ones(width) * 0.5, 6)
    depth = rng.choice([1, 2, 4, 8, 30, 200, 2000], n)
    return np.array([rng.poisson(centres[rng.integers(6)] * d) for d in depth], dtype=float)


@pytest.mark.parametrize(("seed", "block", "d0", "q"), [(0, 256, 1.0, distance.Q), (1, 5, 1.0, distance.Q), (2, 16, 3.0, distance.Q), (3, 7, 6.0, 0.01), (4, 1, 1.0, 0.2), (5, 12, 4.0, 0.02), (6, 9, 2.0, 0.1)])
def test_sweep_equals_the_sequential_rule(spark, seed, block, d0, q):
    x = profiles_of(seed)
    n, alpha = len(x), np.full(x.shape[1], 0.7)
    d = distance.combined_tile(x, x, alpha, q=q, digits=2)
    assert np.allclose(np.diag(d), distance.own_of(x, alpha, q=q, digits=2))
    rows = [(int(i), float(x[i].sum()), x[i].tolist()) for i in range(n)]
    found = leaders.lead(spark.createDataFrame(rows, "contig long, total double, profile array<double>").repartition(3), alpha.tolist(), d0=d0, q=q, digits=2, block_rows=block).collect()
    owner, notes = sequential(d, sorted(range(n), key=lambda i: (-x[i].sum(), -i)), d0)
    assert {r["contig"]: r["leader"] for r in found if r["owned"]} == dict(enumerate(owner))
    assert sorted((r["contig"], r["leader"]) for r in found if not r["owned"]) == notes


def test_sweep_by_both_kinds_names_and_nothing(spark):
    x, k = profiles_of(8, 40), np.random.default_rng(1).poisson(3, (40, 256)).astype(float)
    alpha, kmer = np.full(5, 0.7), np.full(256, 0.4)
    rows = [(f"c{i}", float(x[i].sum()), x[i].tolist(), k[i].tolist()) for i in range(40)]
    made = spark.createDataFrame(rows, "contig string, total double, profile array<double>, kmer array<double>")
    found = leaders.lead(made, alpha.tolist(), kmer.tolist(), 300.0, block_rows=6).collect()
    pairs = distance.pair_distances(made, alpha.tolist(), None, kmer.tolist())
    wanted = clustering.leaders(pairs, made.select("contig", "total"), 300.0).collect()
    key = lambda rows: sorted((r["contig"], r["leader"], r["owned"]) for r in rows)
    assert key(found) == key(wanted)
    assert leaders.lead(made.limit(0), alpha.tolist(), kmer.tolist()).collect() == []


def test_tasks_of_unsure_leaders_do_not_grow_with_the_table(spark, monkeypatch):
    x = profiles_of(4)
    n, alpha = len(x), np.full(x.shape[1], 0.7)
    rows = [(int(i), float(x[i].sum()), x[i].tolist()) for i in range(n)]
    made = spark.createDataFrame(rows, "contig long, total double, profile array<double>")
    dealt, real = [], type(made).repartition
    monkeypatch.setattr(leaders, "TASK_ROWS", 2, raising=False)
    monkeypatch.setattr(type(made), "repartition", lambda self, parts, *by: dealt.append((parts, by)) or real(self, parts, *by))
    found = leaders.lead(made, alpha.tolist(), d0=1.0, q=0.2, digits=2, block_rows=25).collect()
    owner, _ = sequential(distance.combined_tile(x, x, alpha, q=0.2, digits=2), sorted(range(n), key=lambda i: (-x[i].sum(), -i)), 1.0)
    assert {r["contig"]: r["leader"] for r in found if r["owned"]} == dict(enumerate(owner))
    assert max((parts for parts, by in dealt if by == ("b",)), default=0) > 4  # more than the session's shuffle partitions
