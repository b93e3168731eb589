import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.plans import binning, latent, markers, paths, probe


@pytest.fixture(scope="module")
def genomes(spark):
    """Ten contigs each of two genomes that differ in counts and in composition."""
    rng = np.random.default_rng(6)
    letters = [np.array([0.4, 0.1, 0.1, 0.4]), np.array([0.1, 0.4, 0.4, 0.1])]
    means = [np.array([300, 20, 150]), np.array([15, 400, 60])]
    seqs = [(f"g{g}_{i}", "".join(rng.choice(list("ACGT"), 4000, p=letters[g]))) for g in range(2) for i in range(10)]
    table = [(f"s{j}", n, float(x)) for n, _ in seqs for j, x in enumerate(rng.poisson(means[int(n[1])]))]
    return spark.createDataFrame(table, "sample string, contig string, count double"), spark.createDataFrame(seqs, "name string, seq string")


def pure(rows, group, contig):
    by = {}
    for r in rows:
        by.setdefault(r[group], set()).add(str(r[contig])[:2])
    return by and all(len(v) == 1 for v in by.values())


def test_density_bins(genomes):
    rows = paths.density_bins(*genomes).collect()
    assert {r["contig"] for r in rows} == {r["name"] for r in genomes[1].collect()} and pure(rows, "centre", "contig")
    assert len({r["centre"] for r in rows}) <= 20 and len(rows) == len({(r["centre"], r["contig"]) for r in rows})


def test_embedding_bins(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.3, (60, 4)), rng.normal(9, 0.3, (60, 4))])
    points = spark.createDataFrame([(i, v.tolist(), 60_000 + 10 * i) for i, v in enumerate(x)], "id long, embedding array<double>, length long")
    rows = paths.embedding_bins(points, 4).collect()
    assert len(rows) == 120
    by = {}
    for r in rows:
        by.setdefault(r["cluster"], set()).add(r["id"] // 60)
    assert all(len(v) == 1 for v in by.values())
    peaks = paths.peaks_by_length(spark.createDataFrame([(r["id"], r["peak"]) for r in rows], "id long, peak long"), points).collect()
    lengths = [r["length"] for r in sorted(peaks, key=lambda r: r["ordinal"])]
    assert lengths == sorted(lengths, reverse=True) and sum(r["members"] for r in peaks) == 120


def test_deconvolved_bins(spark):
    rng = np.random.default_rng(5)
    w = np.array([[0.7, 0.2, 0.1], [0.1, 0.1, 0.8]])
    rows = [(c, f"s{j}", int(x)) for c in range(40) for j, x in enumerate(rng.poisson(300 * w[c % 2]))]
    counts = spark.createDataFrame(rows, "contig int, sample string, count int")
    # the two genomes lie mixed in two clusters
    members = spark.createDataFrame([(c, c // 20) for c in range(40)], "contig int, cluster int")
    lengths = spark.createDataFrame([(c, 50_000) for c in range(40)], "contig int, length int")
    found, parts = paths.deconvolved_bins(counts, members, lengths, 3)
    listed = {(r["cluster"], r["component"]): (r["bin"], r["members"]) for r in found.collect()}
    assert sorted(c for _, m in listed.values() for c in m) == list(range(40))
    assert all(len({c % 2 for c in m}) == 1 for _, m in listed.values())
    # components of like profiles of different clusters meet in a bin, unlike ones don't
    by = {}
    for bin_, m in listed.values():
        by.setdefault(bin_, set()).update(c % 2 for c in m)
    assert all(len(v) == 1 for v in by.values()) and len(by) <= len(listed)
    small = paths.deconvolved_bins(counts, members, lengths.withColumn("length", F.lit(10)), 3)[0].collect()
    assert len({r["bin"] for r in small}) == len(small)
    assert parts.filter("z <= 0").isEmpty()


SAM = """@HD\tVN:1.0\tSO:unsorted
@SQ\tSN:a\tLN:3000
@SQ\tSN:b\tLN:3000
"""


def test_binning_command(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    (tmp_path / "in").mkdir()
    for sample, share in (("one", 0.9), ("two", 0.1)):
        lines = [f"r{i}\t67\t{'a' if rng.random() < share else 'b'}\t1\t9\t10M\t=\t1\t0\tACGTACGTAC\tIIIIIIIIII\tMD:Z:10" for i in range(400)]
        (tmp_path / "in" / f"{sample}.sam").write_text(SAM + "\n".join(lines) + "\n")
    (tmp_path / "c.fa").write_text("".join(f">{n}\n{''.join(rng.choice(list(p), 3000))}\n" for n, p in (("a", "ACGT"), ("b", "AATT"))))
    binning.main(["-i", str(tmp_path / "in"), "-c", str(tmp_path / "c.fa"), "-d", str(tmp_path / "out"), "-o", "found", "--format", "sam", "--fasta"])
    bins = dict(x.split(",") for f in (tmp_path / "out" / "found").glob("part-*") for x in f.read_text().split())
    assert set(bins) == {"a", "b"}
    counts = {(r["sample"], r["contig"]): r["count"] for r in spark.read.parquet(str(tmp_path / "out" / "counts")).collect()}
    assert counts["one", "a"] > 300 and counts["two", "b"] > 300 and sum(counts.values()) == 800
    assert (tmp_path / "out" / "fasta").is_dir()
    binning.main(["-v"])
    assert "binloom" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        binning.main([])


def test_latent_and_probe_commands(spark, tmp_path):
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 2, 80)
    np.savez(tmp_path / "reads.npz", rng.poisson(np.array([[40, 5, 5], [5, 5, 40]])[kind]) + 1)
    np.save(tmp_path / "kmers.npy", rng.poisson(np.where(kind[:, None] == 1, [9, 1, 1, 9], [1, 9, 9, 1])) + 1)
    out = str(tmp_path / "out")
    latent.main(["--reads_matrix", str(tmp_path / "reads.npz"), "--kmers_matrix", str(tmp_path / "kmers.npy"), "--outdir", out, "--nlatent", "3", "--epochs", "20", "--hidden", "16"])
    rows = {r["contig"]: r["latent"] for r in spark.read.parquet(f"{out}/latent").collect()}
    assert len(rows) == 80 and len(rows[0]) == 3
    assert spark.read.parquet(f"{out}/model/losses").count() == 40
    np.save(tmp_path / "latent.npy", np.array([rows[i] for i in range(80)]))
    (tmp_path / "labels").write_text("".join(f"genome{k}\n" for k in kind))
    (tmp_path / "names").write_text("".join(f"n{i}\n" for i in range(80)))
    probe.main(["--latent", str(tmp_path / "latent.npy"), "--otuids", str(tmp_path / "labels"), "--names", str(tmp_path / "names"), "--outdir", out])
    called = dict(x.split("\t") for f in (tmp_path / "out" / "bins").glob("part-*") for x in f.read_text().splitlines())
    assert np.mean([called[f"n{i}"] == f"genome{kind[i]}" for i in range(80)]) > 0.9
    chances = [float(x.split("\t")[1]) for f in (tmp_path / "out" / "probabilities").glob("part-*") for x in f.read_text().splitlines()]
    assert len(chances) == 80 and all(0.5 <= c <= 1 for c in chances)


def test_marker_command(tmp_path):
    (tmp_path / "hits").write_text("a_1\ta\tCOG0012\t300\na_2\ta\tCOG0012\t250\nb_1\tb\tCOG0012\t300\nb_2\tb\tCOG0016\t300\nc_1\tc\tCOG0012\t20\nx_1\tx\tCOG0012\t400\n")
    (tmp_path / "contigs").write_text("0 a 3000\n1 b 3000\n4 c 3000\n")
    markers.main(["--hits", str(tmp_path / "hits"), "--contigs", str(tmp_path / "contigs"), "--outdir", str(tmp_path / "out")])
    assert "".join(f.read_text() for f in (tmp_path / "out" / "marker_hits").glob("part-*")) == "0\tCOG0012\n"
