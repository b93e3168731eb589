"""BAM files of many blocks: read in one piece or by splits of any size, and written by samples."""

import random

import pytest

from binloom.sources import bam


def made(seed, n, giant=False):
    rng = random.Random(seed)
    contigs = [(f"contig_{i}", 1000 + i) for i in range(rng.choice([1, 40, 3000]))]
    rows = []
    for i in range(n):
        bases = rng.choice([0, 1, 35, 150]) if not (giant and i % 37 == 5) else 200_000
        cigar = f"{bases}M" if bases and rng.random() < 0.8 else "*"
        qual = "".join(chr(33 + rng.randrange(40)) for _ in range(bases)) or "*"
        rows.append((f"read{rng.randrange(n)}", rng.randrange(4096), rng.randrange(-1, len(contigs)), cigar, qual, rng.choice([None, "35", "3A31", "\x01" * 3])))
    return contigs, rows


def packed(path, contigs, rows, rng):
    data = bam.packed_header(contigs) + b"".join(bam.packed_record(*r) for r in rows)
    with open(path, "wb") as out:
        while data:
            n = rng.choice([1, 100, 5_000, bam.BLOCK_BYTES])
            out.write(bam.packed_block(data[:n]) + (bam.END_BLOCK if rng.random() < 0.1 else b""))
            data = data[n:]
        out.write(bam.END_BLOCK)


@pytest.mark.parametrize(("seed", "n", "giant"), [(0, 3000, False), (1, 400, True), (2, 5, False), (3, 0, False), (4, 2000, False)])
def test_splits_give_the_records_of_one_task(tmp_path, seed, n, giant):
    contigs, rows = made(seed, n, giant)
    path = str(tmp_path / "s.bam")
    packed(path, contigs, rows, random.Random(seed))
    size = (tmp_path / "s.bam").stat().st_size
    whole = list(bam.records(path, 0, size))
    assert [r for _, r in whole] == [(name, flag, contigs[ref][0] if ref >= 0 else "*", cigar, qual, md) for name, flag, ref, cigar, qual, md in rows]
    assert [o for o, _ in whole] == sorted({o for o, _ in whole})
    for split in (size // 3 + 1, 7_001, 65_536):
        parts = [r for at in range(0, size, split) for r in bam.records(path, at, min(size, at + split))]
        assert parts == whole


def test_one_file_read_by_several_tasks(spark, tmp_path):
    contigs, rows = made(5, 4000)
    packed(str(tmp_path / "x.bam"), contigs, rows, random.Random(5))
    bam.register(spark)
    one = spark.read.format("bam").load(str(tmp_path))
    many = spark.read.format("bam").option("split", 20_000).load(str(tmp_path))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    assert [r["read_id"] for r in many.orderBy("ord").collect()] == [r[0] for r in rows]


def test_written_files_hold_reads_together_and_in_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice(["s1", "s.2"]), f"r{rng.randrange(300)}", i, rng.randrange(4096), rng.choice(["a", "b", "gone"]), "3S7M", "I" * 10, str(i)) for i in range(2500)]
    records = spark.createDataFrame(rows, bam.SCHEMA).repartition(5)
    contigs = spark.createDataFrame([(1, "b", 5000), (0, "a", 3000)], "ref_id int, name string, length int")
    files = bam.write(records, contigs, str(tmp_path / "out"), 3).collect()
    assert len(files) == 6 and sum(f["records"] for f in files) == len(rows)
    assert sorted(bam.bam_files(str(tmp_path / "out"))) == sorted(f["path"] for f in files)
    bam.register(spark)
    back = spark.read.format("bam").option("sample", bam.WRITTEN_SAMPLE).option("split", 3000).load(str(tmp_path / "out"))
    got = sorted((tuple(r) for r in back.collect()), key=lambda r: (r[0], r[1], r[2]))
    want = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    assert [(r[0], r[1], *r[3:]) for r in got] == [(r[0], r[1], r[3], r[4] if r[4] != "gone" else "*", *r[5:]) for r in want]
    assert [tuple(r) for r in bam.bam_contigs(spark, str(tmp_path / "out")).orderBy("ref_id").collect()] == [(0, "a", 3000), (1, "b", 5000)]


def test_stretches_of_a_file_share_its_header(tmp_path, monkeypatch):
    contigs, rows = made(6, 500)
    path, read = str(tmp_path / "h.bam"), []
    packed(path, contigs, rows, random.Random(6))
    size, header = (tmp_path / "h.bam").stat().st_size, bam._header
    monkeypatch.setattr(bam, "_header", lambda take: read.append(1) or header(take))
    for at in range(0, size, 5_000):
        list(bam.records(path, at, min(size, at + 5_000)))
    assert size > 10_000 and len(read) == 1
    # a file that is written anew has its own
    packed(path, [("other", 7)], [("r", 0, 0, "4M", "IIII", None)], random.Random(7))
    assert [r[2] for _, r in bam.records(path, 0, (tmp_path / "h.bam").stat().st_size)] == ["other"]


def test_qualities_out_of_range_are_errors():
    with pytest.raises(ValueError):
        bam.packed_record("r", 0, 0, "1M", " ", None)
    record = bytearray(bam.packed_record("r", 0, 0, "1M", "!", None)[4:])
    record[-1] = 230
    with pytest.raises(ValueError):
        bam._decoded(bytes(record), ["c"])
