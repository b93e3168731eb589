import math
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binloom.operators import clustering, distance, embedding, graph, latent, network, nmf, priors


def sequential(d, order, d0):
    """The leader rule on a full matrix, one contig after the other."""
    n = len(d)
    owner, best = [-1] * n, [d0] * n
    notes = []
    for c in order:
        if owner[c] >= 0:
            continue
        taken = [j for j in range(n) if d[c][j] < best[j]]
        if taken:
            if d[c][c] > d0 and c not in taken:
                taken.append(c)
            for j in taken:
                best[j], owner[j] = d[c][j], c
            notes += [(j, c) for j in range(n) if d[c][j] < d0]
    for c in range(n):
        if owner[c] < 0:
            owner[c] = c
            notes.append((c, c))
    return owner, sorted(notes)


@pytest.mark.parametrize(("seed", "n"), [(0, 30), (1, 30), (2, 30), (3, 60), (4, 12)])
def test_leaders_equal_the_sequential_rule(spark, seed, n):
    rng = random.Random(seed)
    d = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            d[i][j] = d[j][i] = rng.choice([rng.uniform(0, 1.5), rng.uniform(1, 6), 0.5]) if i != j else rng.choice([0.1, 0.5, 1.4, 3.0])
    totals = [rng.randint(1, 9) for _ in range(n)]
    order = sorted(range(n), key=lambda i: (-totals[i], -i))
    pairs = spark.createDataFrame([(i, j, d[i][j]) for i in range(n) for j in range(n) if i == j or d[i][j] < max(1.0, d[j][j])], "a long, b long, distance double")
    found = clustering.leaders(pairs, spark.createDataFrame(list(enumerate(totals)), "contig long, total long")).collect()
    owner, notes = sequential(d, order, 1.0)
    assert {r["contig"]: r["leader"] for r in found if r["owned"]} == dict(enumerate(owner))
    assert sorted((r["contig"], r["leader"]) for r in found if not r["owned"]) == notes


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    parent = {i: i for e in edges for i in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    nodes = spark.createDataFrame([(i,) for i in [*parent, 999]], "id long")
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()}
    for most in (0, 30):  # by rounds of contraction alone, and with the last edges joined by one task
        assert got == {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), nodes, most).collect()}
    assert got == {i: find(i) for i in parent} | {999: 999}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graph.components(none).count() == 0
    assert [tuple(r) for r in graph.components(none, spark.createDataFrame([(3,)], "id long")).collect()] == [(3, 3)]


def test_links_need_more_than_the_threshold(spark):
    rows = [(c, "x") for c in range(6)] + [(c, "y") for c in range(6)] + [(c, "z") for c in range(5)]
    got = graph.shared_member_links(spark.createDataFrame(rows, "contig int, leader string")).collect()
    assert [tuple(r) for r in got] == [("x", "y", 6)]


def test_distance_is_symmetric_and_falls_for_like_profiles():
    rng = np.random.default_rng(1)
    x = rng.poisson(50, (5, 8)).astype(float)
    alpha = np.full(8, 2.0)
    d = distance.tile_distances(x, x, alpha)
    assert np.allclose(d, d.T)
    far = distance.tile_distances(x[:1], x[:1][:, ::-1] * np.arange(1, 9), alpha)[0, 0]
    assert d[0, 0] < far


def test_tiles_equal_the_expression(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(6)]) for i in range(20)]
    df = spark.createDataFrame(rows, "contig long, profile array<double>").withColumn("total", F.aggregate("profile", F.lit(0.0), lambda a, x: a + x))
    tiles = {(r["a"], r["b"]): r["distance"] for r in distance.pair_distances(df, [0.7] * 6, None, tile_rows=6).collect()}
    assert len(tiles) == 400
    for r in distance.from_query(df, df.filter("contig = 3"), [0.7] * 6).collect():
        assert r["distance"] == pytest.approx(tiles[3, r["contig"]], abs=1e-9)


def test_prior_recovers_the_truth(spark):
    rng = np.random.default_rng(3)
    alpha = np.array([8.0, 2.0, 5.0])
    rows = [(i, str(j), int(x)) for i in range(800) for j, x in enumerate(rng.multinomial(400, rng.dirichlet(alpha)))]
    total, each = priors.dirichlet_prior(spark.createDataFrame(rows, "contig int, sample string, count int"))
    assert total == pytest.approx(15, rel=0.1)
    assert each["0"] / total == pytest.approx(8 / 15, rel=0.1)


def test_priors_equal_a_plain_fit(spark):
    """Several matrices in the same jobs, each as a one-dimensional search over its own cells finds it."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(4):
        x = rng.poisson(rng.gamma(2.0, 3.0, (50, 4)) * [1, 2, 3, 0 if g == 2 else 1]).astype(float) if g != 3 else np.zeros((5, 2))
        share, total = x.sum(axis=0) / max(x.sum(), 1.0), x.sum(axis=1)
        used = share > 0

        def cost(a, x=x[:, used], share=share[used], total=total):
            top = math.exp(a)
            lg = np.vectorize(math.lgamma)
            return float((lg(total + top) - math.lgamma(top)).sum() - (lg(x + top * share) - lg(top * share)).sum())

        want[g] = (math.exp(priors.brent(cost)), share) if used.any() else (0.0, share)
        rows += [(g, i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v or rng.random() < 0.5 or g == 3 or j == 0]
    got = priors.fit_groups(spark.createDataFrame(rows, "grp int, row int, col int, x double"))
    for g, (top, share) in want.items():
        assert got[g][0] == pytest.approx(top, rel=2e-3)
        assert all(got[g][1][j] == pytest.approx(share[j]) for j in got[g][1])
    assert priors.fit_groups(spark.createDataFrame([], "grp int, row int, col int, x double")) == {}


def test_minima_of_several_functions():
    places = np.array([3.3, -7.0, 30.0])
    found = priors.minima(lambda x: np.stack([(x[0] - 3.3) ** 2, np.cosh(x[1] + 7), -x[2]]), 3)
    assert np.allclose(found, places, atol=1e-6)


def test_brent_finds_minima():
    assert priors.brent(lambda x: (x - 3.3) ** 2) == pytest.approx(3.3, abs=1e-5)
    assert priors.brent(lambda x: math.cosh(x + 7)) == pytest.approx(-7, abs=1e-4)


def test_gamma_poisson():
    rng = np.random.default_rng(0)
    rows = [(float(rng.poisson(rng.gamma(4.0) / 2.0)), 1.0) for _ in range(4000)]
    a, b = priors.gamma_poisson(rows)
    assert a / b == pytest.approx(2.0, rel=0.05) and a == pytest.approx(4.0, rel=0.4)


def test_widest_paths(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0), (1, 3, 1.0), (3, 1, 9.0)], "src long, dst long, w double")
    got = {r["id"]: r["width"] for r in graph.widest_paths(edges, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: math.inf, 2: 5.0, 3: 4.0}


def test_a_start_that_is_given_twice_has_one_row_even_without_edges(spark):
    edges = spark.createDataFrame([(1, 2, 5.0)], "src long, dst long, w double")
    got = sorted(tuple(r) for r in graph.widest_paths(edges, spark.createDataFrame([(7,), (7,)], "id long")).collect())
    assert got == [(7, 7, math.inf)]


def test_nearest_is_exact_over_tiles(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, v[i].tolist(), 1000) for i in range(90)], "id long, embedding array<double>, length long")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in embedding.nearest(df, 6, tile_rows=25).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    for i in range(90):
        assert [got[i, k] for k in range(6)] == np.argsort(d[i])[:6].tolist()


def test_tasks_of_merged_members_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    rows = [(i % 40, i % 5) for i in range(200)] + [(None, 1), (None, 1), (3, 99)]
    members = spark.createDataFrame(rows, "contig long, leader long")
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)], "id long, comp long")
    found = graph.merged_members(members, groups)
    comp = dict([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)])
    assert sorted(map(tuple, found.collect()), key=str) == sorted({(comp[b], a) for a, b in rows if b in comp}, key=str)
    assert found.rdd.getNumPartitions() == 21


def test_blocks_of_points_do_not_multiply_with_the_table(spark):
    # each point is sent once for each block, and leaves k candidates for each
    few, many = (embedding.blocks_of(spark.range(1), n, embedding.TILE_ROWS) for n in (60_000, 190_000))
    assert few == many


@pytest.mark.parametrize("columns", [7, 16, 4096])
def test_closest_in_pieces_of_columns(monkeypatch, columns):
    monkeypatch.setattr(embedding, "STRIP_COLUMNS", columns)
    monkeypatch.setattr(embedding, "STRIP_ROWS", 8)
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, size=(60, 3)).astype(float)  # many ties
    ids = rng.permutation(60)
    d = ((v[:, None] - v[None, 20:]) ** 2).sum(2)
    d[ids[:, None] == ids[None, 20:]] = -1.0
    for allowed in (None, rng.random((60, 4)) < 0.4):
        at = rng.integers(0, 4, size=40)
        seen = d if allowed is None else np.where(allowed[:, at], d, np.inf)
        edge = np.sort(seen, axis=1)[:, 5]
        want = {(ids[i], ids[20 + j]) for i in range(60) for j in range(40) if seen[i, j] <= edge[i] and seen[i, j] < np.inf}
        got = pd.concat(embedding.closest(v, ids, v[20:], ids[20:], 6, allowed, at))
        assert set(zip(got["id"], got["neighbour"])) == want and len(got) == len(want)


def test_factors_separate_two_profiles(spark):
    rng = np.random.default_rng(5)
    w = np.array([[0.7, 0.2, 0.1], [0.1, 0.1, 0.8]])
    rows = [(c, f"s{j}", int(x), 1) for c in range(40) for j, x in enumerate(rng.poisson(300 * w[c % 2]))]
    df = spark.createDataFrame(rows, "contig int, sample string, count int, cluster int")
    parts = nmf.deconvolve(df.select("contig", "sample", "count"), df.select("contig", "cluster").distinct(), 3).filter("main").collect()
    groups = {}
    for r in parts:
        groups.setdefault(r["component"], set()).add(r["contig"] % 2)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) >= 2


def _two_kinds(count=200):
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 2, count)
    reads = rng.poisson(np.array([[40, 5, 5], [5, 5, 40]])[kind]).astype(float) + 1
    kmers = rng.poisson(np.where(kind[:, None] == 1, [9, 1, 1, 9], [1, 9, 9, 1])).astype(float) + 1
    return kind, reads, kmers


def _profiles(spark, count=200):
    kind, reads, kmers = _two_kinds(count)
    rows = [(i, 1000 + 40 * i, r.tolist(), k.tolist(), (k / 2).tolist(), (k / 2 + 0.1).tolist(), k[::-1].tolist()) for i, (r, k) in enumerate(zip(reads, kmers, strict=True))]
    return kind, spark.createDataFrame(rows, "contig long, length long, profile array<double>, kmer array<double>, left array<double>, right array<double>, codon array<double>")


@pytest.mark.parametrize("squared", [False, True])
def test_gradients_of_the_network(squared):
    rng = np.random.default_rng(0)
    net = network.Network(5, (network.Head("one", 3), network.Head("two", 2, 0.3, squared)), hidden=6, latent=2)
    x, targets = rng.random((4, 5)), [rng.random((4, 3)), rng.random((4, 2))]
    _, grads = net.gradients(x, targets)
    flat, exact = net.flat(), np.concatenate([g.ravel() for pair in grads for g in pair])
    for i in rng.choice(len(flat), 40, replace=False):
        ends = []
        for sign in (1, -1):
            moved = flat.copy()
            moved[i] += sign * 1e-6
            net.load(moved)
            ends.append(net.weighed(net.losses(net.forward(x)[-1], targets)[0]))
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(exact[i], abs=1e-5)


@pytest.mark.parametrize("worker_rows", [1000, 60])
def test_bins_network_learns_from_all_rows(spark, worker_rows):
    kind, profiles = _profiles(spark)
    net, losses = latent.fit_with_losses(profiles, epochs=30, batch=32, worker_rows=worker_rows, hidden=32, latent=4)
    assert len(losses) == 30 and net.weighed(losses[-1]) < net.weighed(losses[0]) - 0.05
    z = {r["contig"]: r["latent"] for r in latent.transform(profiles, net).collect()}
    z = np.array([z[i] for i in range(len(kind))])
    one, two = z[kind == 0].mean(axis=0), z[kind == 1].mean(axis=0)
    near = (((z - one) ** 2).sum(1) > ((z - two) ** 2).sum(1)).astype(int)
    assert (near == kind).mean() > 0.95
    again = network.from_weights(latent.bin_network(3, 4, hidden=32, latent=4), network.weights_table(spark, net))
    assert np.array_equal(again.flat(), net.flat())


@pytest.mark.parametrize(("mode", "z_scores"), [("reads", False), ("kmers", False), ("kmers", True), ("both", True), ("threesources", False)])
def test_contig_network_in_all_modes(spark, mode, z_scores):
    kind, profiles = _profiles(spark)
    model = latent.fit_contigs(profiles, mode, epochs=25, batch=16, z_scores=z_scores, hidden=32, latent=4)
    assert model.net.weighed(model.history[-1]) < model.net.weighed(model.history[0])
    heads = {"reads": ["reads"], "kmers": ["kmers"], "both": ["reads", "kmers"], "threesources": ["reads", "kmers", "codons"]}[mode]
    assert list(model.tested) == list(model.validation) == [*heads, "loss"] and all(math.isfinite(v) for v in model.tested.values())
    z = {r["contig"]: r["latent"] for r in latent.contig_latent(profiles, model).collect()}
    assert len(z) == 200 and all(len(v) == 4 for v in z.values())
    z = np.array([z[i] for i in range(200)])
    one, two = z[kind == 0].mean(axis=0), z[kind == 1].mean(axis=0)
    assert ((((z - one) ** 2).sum(1) > ((z - two) ** 2).sum(1)).astype(int) == kind).mean() > 0.9


def test_thinning_and_schedule():
    rng = np.random.default_rng(4)
    counts, lengths = np.full((4, 500), 10.5), np.array([3999, 4000, 6999, 7000])
    for share, long in ((0.5, [False, True, True, True]), (0.4, [False, False, False, True])):
        made = latent.thinned(counts, lengths, share, rng)
        assert [bool((m != 10.5).any()) for m in made] == long
        assert all(abs(m.mean() - 10.5 * share) < 0.3 for m, is_long in zip(made, long, strict=True) if is_long)
    assert [latent.half_of_epoch(e) for e in (0, 24, 25, 50, 51, 74, 75, 200)] == ["left", "left", "right", "right", "left", "left", "right", "right"]
    assert [network.batch_size(e, 256, latent.CONTIG_DOUBLE_AT) for e in (0, 49, 50, 99, 100, 299)] == [256, 256, 512, 512, 1024, 1024]
    kept, left = latent.split_counts(counts, 0.5, rng)
    assert (kept + left == np.floor(counts)).all()


def test_networks_without_rows(spark):
    _, profiles = _profiles(spark, 3)
    net = latent.bin_network(3, 4, hidden=4, latent=2)
    assert network.train(profiles.limit(0), "contig", net, latent._bin_rows(None), 2, 8, ()) == []
    assert network.test(profiles.limit(0), net, latent._bin_rows(None)) == {}
    assert latent.transform(profiles.limit(0), net).count() == 0


def test_density_by_hand(spark):
    d = {(0, 0): 0.0, (1, 1): 2.0, (2, 2): 0.0, (0, 1): 0.5, (0, 2): 4.0, (1, 2): 3.0}
    pairs = spark.createDataFrame([(a, b, d[min(a, b), max(a, b)]) for a in range(3) for b in range(3)], "a long, b long, distance double")
    sizes = spark.createDataFrame(pd.DataFrame({"id": [0, 1, 2], "length": [1000, 500, 800]}))
    got = {r["id"]: (r["density"], r["separation"], r["nearest"]) for r in clustering.densities(pairs, sizes).collect()}
    assert got == {0: (1500, 1e30, 0), 1: (1500, 1e30, 1), 2: (800, 3.0, 1)}
    centres = clustering.assign_centres(clustering.densities(pairs, sizes)).collect()
    assert {r["id"]: r["centre"] for r in centres} == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize(("seed", "room", "names"), [(0, 2_000_000, False), (1, 7, False), (2, 50, True), (3, 1, True)])
def test_shared_members_equal_a_count(spark, monkeypatch, seed, room, names):
    monkeypatch.setattr(graph, "ROOM", room)
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.randrange(25)) for _ in range(700)] + [(7, i) for i in range(25)] * 2
    rows = [(c, f"l{x}" if names else x) for c, x in rows] + [(None, "l1" if names else 1)]
    by = {}
    for c, x in set(rows):
        if c is not None:
            by.setdefault(c, []).append(x)
    wanted = {}
    for members in by.values():
        for a in members:
            for b in members:
                if a < b:
                    wanted[a, b] = wanted.get((a, b), 0) + 1
    got = graph.shared_member_links(spark.createDataFrame(rows, f"contig long, leader {'string' if names else 'long'}").repartition(3), 8).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in got} == {k: n for k, n in wanted.items() if n > 8}
    assert len(got) > 3


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_peaks_by_the_lowest_that_reaches(spark, seed):
    rng = random.Random(seed)
    n = 90
    dense = [round(rng.uniform(0.2, 1) ** 3, 2) + 0.01 for _ in range(n)]
    rows = [(i, j, r, dense[i]) for i in range(n) for r, j in enumerate([i, *rng.sample([x for x in range(n) if x != i], rng.randint(0, 3))])]
    lists = spark.createDataFrame(rows, "id long, neighbour long, rank int, density double")
    peaks = embedding.density_peaks(lists).localCheckpoint()
    edges = embedding.valley_edges(lists, peaks, 0.3).localCheckpoint()
    got = {r["id"]: r["cluster"] for r in embedding.peak_clusters(peaks, edges).collect()}
    wanted = {r["id"]: r["cluster"] for r in embedding.peak_clusters(peaks, embedding.peak_links(lists, peaks, 0.3)).collect()}
    assert got == wanted and 1 < len(set(got.values())) < peaks.select("peak").distinct().count()
    # rows for edges between points, not for pairs of peaks
    assert edges.count() <= len(rows) - n


def test_tasks_of_shared_members_do_not_grow_with_the_table(spark, monkeypatch):
    real = graph._counted_pairs

    def watched(kind):
        run = real(kind)

        def counted(batches):
            held = list(batches)
            assert sum(b.num_rows for b in held) <= 400  # a contig's rows stay together
            yield from run(iter(held))

        return counted

    monkeypatch.setattr(graph, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(graph, "_counted_pairs", watched)
    rows = spark.range(3000).selectExpr("id div 6 AS contig", "id % 6 + (id div 600) * 6 AS leader")
    got = graph.shared_member_links(rows, 5).collect()
    assert len(got) == 5 * 15 and {r["shared"] for r in got} == {100}


def test_sums_of_shared_members_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    rows = spark.range(3000).selectExpr("id div 6 AS contig", "id % 6 + (id div 600) * 6 AS leader")
    found = graph.shared_member_links(rows, 5)
    assert len(found.collect()) == 5 * 15
    assert found.rdd.getNumPartitions() == 30  # not the 4 shuffle partitions of the session, however large the table


@pytest.mark.parametrize(("grid", "room"), [(2048, 2_000_000), (128, 2_000_000), (4, 2_000_000), (128, 50)])
def test_pairs_in_a_table_equal_sorted_ones(monkeypatch, grid, room):
    monkeypatch.setattr(graph, "GRID", grid)
    monkeypatch.setattr(graph, "ROOM", room)
    monkeypatch.setattr(graph, "BATCH_ROWS", 100)
    rng = random.Random(grid + room)
    rows = sorted((c, rng.randrange(3 + c)) for c in range(200) for _ in range(8))  # leaders become more and more
    by, wanted, got = {}, {}, {}
    for c, x in sorted(set(rows)):
        for y in by.setdefault(c, []):
            wanted[y, x] = wanted.get((y, x), 0) + 1
        by[c].append(x)
    batches = [pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows[i : i + 90], strict=True)], ["contig", "leader"]) for i in range(0, len(rows), 90)]
    for out in graph._counted_pairs(pa.int64())(iter(batches)):
        assert out.num_rows <= 100
        for a, b, n in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True):
            got[min(a, b), max(a, b)] = got.get((min(a, b), max(a, b)), 0) + n
    assert got == wanted


@pytest.mark.parametrize("groups", [1, 2])
def test_terms_of_whole_counts_are_looked_up(monkeypatch, groups):
    rng = np.random.default_rng(3)
    x, y = rng.poisson(40, (60, 26)).astype(float), rng.poisson(400, (500, 26)).astype(float)
    alpha = np.repeat([0.5, 42.52], 13)
    context = alpha.reshape(groups, -1).sum(axis=1)
    real, seen = distance.log_gamma_np, []
    sides = lambda m, p: real(m + p).sum(axis=1)
    tx, ty = (m.reshape(len(m), groups, -1).sum(axis=2) for m in (x, y))
    odds = sides(x, alpha)[:, None] - sides(tx, context)[:, None] + (sides(y, alpha) - sides(ty, context))[None, :] - (real(alpha).sum() - real(context).sum())
    odds -= real(x[:, None] + y[None] + alpha).sum(axis=2) - real(tx[:, None] + ty[None] + context).sum(axis=2)
    wanted = distance._softened(odds, distance.Q)
    monkeypatch.setattr(distance, "log_gamma_np", lambda v: seen.append(np.size(v)) or real(v))
    found = distance.tile_distances(x, y, alpha, groups)
    assert np.allclose(found, wanted, rtol=0, atol=1e-7)
    assert sum(seen) < x.shape[0] * y.size / 4  # each term was computed before
    monkeypatch.setattr(distance, "TABLE_VALUES", 0)
    monkeypatch.setattr(distance, "PIECE_VALUES", 1000)
    assert (distance.tile_distances(x, y, alpha, groups) == found).all()
    # fractions, and counts too large for a table, are computed
    monkeypatch.undo()
    for a, b in ((x + 0.25, y), (x * 1e9, y), (x[:0], y), (x, y[:0])):
        got = distance.tile_distances(a, b, alpha, groups)
        assert got.shape == (len(a), len(b)) and np.isfinite(got).all()


def test_pairs_leave_a_tile_by_strips(spark):
    made = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(700)], "contig long, profile array<double>")
    pairs = distance.pair_distances(made, [0.7] * 2, None)
    assert "CoGroup" not in pairs._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" in pairs._jdf.queryExecution().toString()
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 700 * 700


def test_each_tile_of_pairs_is_a_task(spark):
    made = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(700)], "contig long, profile array<double>")
    pairs = distance.pair_distances(made, [0.7] * 2, None, tile_rows=100)
    assert pairs.withColumn("task", F.spark_partition_id()).select("task").distinct().count() == pairs.rdd.getNumPartitions() == 7 * 8 // 2


@pytest.mark.parametrize("below", [None, 1.0, 1e-5])
def test_tiles_round_as_sql_does(spark, below):
    rng = np.random.default_rng(5)
    made = spark.createDataFrame([(i, [float(v) for v in rng.poisson(20 + 300 * (i % 3) * (1 + np.arange(26) % 2 * (i % 2)), 26)]) for i in range(90)], "contig long, profile array<double>")
    plain = distance.pair_distances(made, [42.52] * 26, below).toPandas()
    connection = duckdb.connect()
    connection.register("plain", plain)
    wanted = connection.execute("SELECT a, b, round(distance, 4) FROM plain ORDER BY a, b").fetchall()
    got = sorted(tuple(r) for r in distance.pair_distances(made, [42.52] * 26, below, digits=4).collect())
    assert got == wanted
    assert below is None or any(d == 0 for _, _, d in got)
    ties = pd.DataFrame({"d": [0.0, 0.00005, 0.00015, 0.12345, 0.49995, 7.0]})
    connection.register("ties", ties)
    assert distance._rounded(ties["d"].to_numpy(), 4).tolist() == [d for (d,) in connection.execute("SELECT round(d, 4) FROM ties").fetchall()]


@pytest.mark.parametrize("groups", [1, 2])
def test_terms_are_looked_up_a_row_at_a_time(monkeypatch, groups):
    rng = np.random.default_rng(4)
    x, y, alpha = rng.poisson(40, (20, 6)).astype(float), rng.poisson(90, (300, 6)).astype(float), np.repeat([0.5, 42.52], 3)
    wanted = distance.tile_distances(x, y, alpha, groups)
    monkeypatch.setattr(distance, "WIDE_ROWS", 300)
    monkeypatch.setattr(distance, "PIECE_VALUES", 0)  # sums of counts are not stored
    assert np.allclose(distance.tile_distances(x, y, alpha, groups), wanted, rtol=0, atol=1e-9)
