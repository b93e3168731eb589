import gzip
import io
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from binloom.operators import composition
from binloom.plans import binning
from binloom.sources import bam, sinks, text

SAM = """@HD\tVN:1.0\tSO:unsorted
@SQ\tSN:short\tLN:10
@SQ\tSN:a\tLN:3000
r1\t67\ta\t1\t9\t10M\t=\t1\t0\tACGTACGTAC\tIIIIIIIIII\tAS:i:0\tMD:Z:10
r1\t131\ta\t1\t9\t10M\t=\t1\t0\tACGTACGTAC\tIIIIIIIIII\tXS:i:0\tNM:i:1\tMD:Z:4A5
r2\t65\tshort\t1\t9\t10M\t=\t1\t0\tACGTACGTAC\tIIIIIIIIII\tMD:Z:10
"""


def test_sam(spark, tmp_path):
    (tmp_path / "one.sam").write_text(SAM)
    records, contigs = text.read_sam(spark, str(tmp_path / "one.sam"))
    assert [(r["ref_id"], r["name"], r["length"]) for r in contigs.collect()] == [(1, "a", 3000)]
    rows = records.orderBy("ord").collect()
    assert [(r["sample"], r["read_id"], r["flag"], r["contig"], r["md"]) for r in rows] == [("one", "r1", 67, "a", "10"), ("one", "r1", 131, "a", "4A5"), ("one", "r2", 65, "short", "10")]
    table = {(r["sample"], r["contig"]): r["count"] for r in binning.read_counts(records, contigs, 90.0).collect()}
    assert table == {("one", "a"): 1.0}


def test_sam_sorted_by_position_is_refused(spark, tmp_path):
    (tmp_path / "two.sam").write_text(SAM.replace("SO:unsorted", "SO:coordinate\tSS:coordinate:x"))
    try:
        text.read_sam(spark, str(tmp_path / "two.sam"))
        raise AssertionError("no error")
    except ValueError:
        pass


def bam_bytes():
    out = io.BytesIO()
    head = b"@HD\tVN:1.0\n"
    out.write(b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 2) + b"a\0" + struct.pack("<i", 3000))
    for name, flag, ops, qual, md in (("r1", 67, [(10, 0)], b"\x28" * 10, b"10"), ("r1", 131, [(2, 4), (8, 0)], b"\xff" * 10, b"8")):
        body = struct.pack("<iiBBHHHiiii", 0, 0, len(name) + 1, 9, 0, len(ops), flag, 10, 0, 0, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + b"\x11" * 5 + qual
        body += b"NMC\1" + b"XBBc" + struct.pack("<i", 2) + b"\1\2" + b"MDZ" + md + b"\0"
        out.write(struct.pack("<i", len(body)) + body)
    return out.getvalue()


def test_bam(spark, tmp_path):
    (tmp_path / "s1.bam").write_bytes(gzip.compress(bam_bytes()))
    bam.register(spark)
    rows = spark.read.format("bam").load(str(tmp_path)).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [("s1", "r1", 0, 67, "a", "10M", "I" * 10, "10"), ("s1", "r1", 1, 131, "a", "2S8M", "*", "8")]
    assert [tuple(r) for r in bam.bam_contigs(spark, str(tmp_path)).collect()] == [(0, "a", 3000)]
    (tmp_path / "s2.bam").write_bytes(gzip.compress(bam_bytes()[:60]) + gzip.compress(bam_bytes()[60:]))  # several members, as BGZF has
    for path, count in ((f"{tmp_path}/s*.bam", 4), (f"{tmp_path}/s2.bam", 2), (f"file://{tmp_path}", 4)):
        assert spark.read.format("bam").load(path).count() == count
    assert {r["sample"] for r in spark.read.format("bam_header").load(str(tmp_path)).collect()} == {"s1", "s2"}


def test_places_tell_the_order_of_lines(spark, tmp_path):
    """However many tasks read a file, places rise along it."""
    lines = [f"r{i // 3}\t67\ta\t{i}\t9\t10M\t=\t1\t0\tACGTACGTAC\tIIIIIIIIII\tMD:Z:10" for i in range(3000)]
    for name in ("x", "y"):
        (tmp_path / f"{name}.sam").write_text("\n".join(lines))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = text._lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 5
        by = {}
        for r in found.orderBy("file", "at").collect():
            by.setdefault(r["file"], []).append(r["value"])
        assert len(by) == 2 and all(v == lines for v in by.values())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_headers_may_hold_marks(spark, tmp_path):
    (tmp_path / "c.fa").write_text(">a from=1>2 x\nAC\nGT\n\n>b\n>c\nTT\n")
    assert {r["name"]: r["seq"] for r in text.read_fasta(spark, str(tmp_path / "c.fa")).collect()} == {"a": "ACGT", "b": "", "c": "TT"}
    frames = text.with_ordinals(text.read_reading_frames(spark, str(tmp_path / "c.fa")), spark.createDataFrame([(3, "a"), (5, "c"), (6, "z")], "ref_id int, name string"))
    assert {r["name"]: r["ref_id"] for r in frames.collect()} == {"a": 3, "c": 5}


def test_fasta_and_bins(spark, tmp_path):
    (tmp_path / "c.fa").write_text(">c_1 note one\nACGT\nACGT\n>c_2\nGGGG\n12x\nCC\n>c_3\r\nTT")
    got = {r["name"]: r["seq"] for r in text.read_fasta(spark, str(tmp_path / "c.fa")).collect()}
    assert got == {"c_1": "ACGTACGT", "c_2": "GGGG12xCC", "c_3": "TT"}
    strict = {r["name"]: r["seq"] for r in text.read_fasta(spark, str(tmp_path / "c.fa"), strict=True).collect()}
    assert strict["c_2"] == "GGGGCC"
    assert {r["contig"] for r in text.read_reading_frames(spark, str(tmp_path / "c.fa")).collect()} == {"c"}
    bins = spark.createDataFrame([("c_1", "1"), ("c_1", "2"), ("c_3", "2")], "contig string, bin string")
    sinks.write_table(bins, str(tmp_path / "bins"), ",")
    assert text.read_bins(spark, str(tmp_path / "bins")).count() == 3
    sinks.write_bin_fasta(text.read_fasta(spark, str(tmp_path / "c.fa")), bins, str(tmp_path / "out"))
    again = text.read_fasta(spark, str(tmp_path / "out" / "bin=2"))
    assert {r["name"]: r["seq"] for r in again.collect()} == {"c_1": "ACGTACGT", "c_3": "TT"}


def test_matrix(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6).reshape(3, 2))
    (tmp_path / "names").write_text("x\ny\nz\n")
    got = {r["name"]: r["values"] for r in text.read_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "names")).collect()}
    assert got == {"x": [0.0, 1.0], "y": [2.0, 3.0], "z": [4.0, 5.0]}
    np.savez(tmp_path / "m.npz", one=np.arange(4).reshape(2, 2), two=np.arange(3))
    every = {(r["array"], r["row"]): r["values"] for r in text.read_arrays(spark, str(tmp_path / "m.npz")).collect()}
    assert every == {("one", 0): [0.0, 1.0], ("one", 1): [2.0, 3.0], ("two", 0): [0.0], ("two", 1): [1.0], ("two", 2): [2.0]}
    assert text.read_matrix(spark, str(tmp_path / "m.npz"), array="two").count() == 3


def test_counts_sink_is_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a", 1.5), ("s2", "a", 0.0)], "sample string, contig string, count double")
    for _ in range(2):
        sinks.write_counts(rows, str(tmp_path / "counts"))
    assert spark.read.parquet(str(tmp_path / "counts")).count() == 2
    assert (tmp_path / "counts" / "sample=s1").is_dir()


def test_both_tetramer_counts_agree(spark):
    rows = spark.createDataFrame([("x", "ACGTNACGTTGACA"), ("y", "ACG"), ("z", "acgtACGTAC")], "name string, seq string")
    one = {tuple(r) for r in composition.long_form(composition.tetramers(rows)).filter("n > 0").collect()}
    assert one == {tuple(r) for r in composition.tetramers_long(rows).collect()}


def test_repeats_are_masked(spark):
    rng = random.Random(1)
    plain = "".join(rng.choice("ACGT") for _ in range(3000))
    rows = spark.createDataFrame([("plain", plain), ("repeat", plain + "A" * 400)], "name string, seq string")
    words = composition.without_repeats(composition.halved(composition.long_form(composition.tetramers(rows))), composition.gc(rows))
    got = {(r["name"], r["kmer"]): r["n"] for r in words.collect()}
    assert got["repeat", 0] == 0 and got["plain", 0] > 0


def test_bins_of_two_genomes(spark):
    rng = np.random.default_rng(6)
    letters = [np.array([0.4, 0.1, 0.1, 0.4]), np.array([0.1, 0.4, 0.4, 0.1])]
    means = [np.array([300, 20, 150]), np.array([15, 400, 60])]
    seqs = [(f"g{g}_{i}", "".join(rng.choice(list("ACGT"), 4000, p=letters[g]))) for g in range(2) for i in range(10)]
    table = [(f"s{j}", n, float(x)) for n, _ in seqs for j, x in enumerate(rng.poisson(means[int(n[1])]))]
    found = binning.bin_contigs(spark.createDataFrame(table, "sample string, contig string, count double"), spark.createDataFrame(seqs, "name string, seq string")).collect()
    assert {r["contig"] for r in found} == {n for n, _ in seqs}
    by_bin = {}
    for r in found:
        by_bin.setdefault(r["bin"], set()).add(r["contig"][:2])
    assert all(len(v) == 1 for v in by_bin.values())


def test_fragments_are_reproducible(spark):
    rows = spark.createDataFrame([("x", "ACGT" * 1000), ("y", "AC")], "name string, seq string")
    one, two = composition.fragments(rows).collect(), composition.fragments(rows).collect()
    assert one == two and len(one) == 1 and len(one[0]["seq"]) >= 2000 and one[0]["seq"] in "ACGT" * 1000


def test_stream_of_files(spark, tmp_path):
    from binloom.streaming import counter

    events = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("k"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = counter.windowed_counts(stream, "ts", "k").writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r[0], r[1]): r[2] for r in events.groupBy(F.window("ts", "1 day").start, "k").count().collect()}
    got = {(r["start"], r["k"]): r["n"] for r in spark.table("w").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_sample_names_of_long_paths_take_no_long_time(spark):
    import time

    paths = {"file:///a/b.c/d.bam": "d", "/a/.bam": ".bam", "/a.b/c": "c", "/a/x..bam": "x.", "/a/b.sam.gz": "b.sam"}
    paths |= {f"/{'a' * 40_000}{i}/s.sam": "s" for i in range(8)}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    began = time.time()
    got = {r["p"]: r["s"] for r in rows.select("p", text.sample_name(F.col("p")).alias("s")).collect()}
    assert got == paths and time.time() - began < 10
