import pytest
from pyspark.sql import functions as F

from binloom.operators import counts
from binloom.streaming import counter

SCHEMA = "sample string, read_id string, contig string, ord long, dir int, proper boolean, identity double"


def rows(spark, *records):
    return spark.createDataFrame([("s", *r) for r in records], SCHEMA)


def folded(spark, *records):
    return {r["contig"]: (r["paired"], r["identity"]) for r in counts.fold_contigs(rows(spark, *records)).collect()}


def test_fold_rules(spark):
    assert folded(spark, ("r", "a", 0, 1, False, 98.0)) == {"a": (False, 98.0)}
    assert folded(spark, ("r", "a", 0, 1, False, 98.0), ("r", "a", 1, 2, False, 100.0)) == {"a": (True, 99.0)}
    assert folded(spark, ("r", "a", 0, 1, False, 98.0), ("r", "a", 1, 1, False, 99.0)) == {"a": (False, 99.0)}
    # the first average always counts, later ones only upwards
    assert folded(spark, ("r", "a", 0, 1, False, 98.0), ("r", "a", 1, 2, False, 96.0), ("r", "a", 2, 2, False, 90.0)) == {"a": (True, 97.0)}
    assert folded(spark, ("r", "a", 0, 1, False, 98.0), ("r", "b", 1, 1, True, 90.0)) == {"a": (False, 98.0), "b": (True, 90.0)}


def test_ordered_fold_keeps_out_weaker_contigs(spark):
    made = counts.fold_ordered(rows(spark, ("r", "a", 0, 1, False, 98.0), ("r", "b", 1, 1, False, 97.0), ("r", "c", 2, 1, True, 90.0), ("r", "d", 3, 1, False, 95.0)))
    assert {r["contig"] for r in made.collect()} == {"a", "c", "d"}


@pytest.mark.parametrize("discordant", [1.0, 0.5])
def test_weights(spark, discordant):
    entries = [("p", "a", 1, True, 99.0), ("p", "b", 1, False, 99.0), ("u", "a", 1, False, 98.0), ("u", "b", 1, False, 98.0), ("low", "a", 1, True, 96.9), ("one", "a", 1, False, 97.0), ("one", "b", 1, False, 96.0)]
    df = spark.createDataFrame([("s", *e) for e in entries], "sample string, read_id string, contig string, dir int, paired boolean, identity double")
    got = {(r["read_id"], r["contig"]): r["weight"] for r in counts.read_weights(df, 97.0, discordant).collect()}
    assert got == {("p", "a"): 0.75, ("p", "b"): 0.25, ("u", "a"): discordant / 2, ("u", "b"): discordant / 2, ("one", "a"): discordant}


def test_weights_of_a_read_sum_to_one(spark):
    df = spark.range(2000).select(F.lit("s").alias("sample"), (F.col("id") % 300).cast("string").alias("read_id"), F.xxhash64("id").bitwiseAND(F.lit(7)).cast("string").alias("contig"), F.col("id").alias("ord"), (F.col("id") % 2 + 1).cast("int").alias("dir"), (F.col("id") % 3 == 0).alias("proper"), (96.0 + F.col("id") % 5).alias("identity"))
    sums = counts.read_weights(counts.fold_contigs(df)).groupBy("read_id").agg(F.sum("weight").alias("w")).collect()
    assert sums and all(r["w"] == pytest.approx(1) for r in sums)


def test_streaming_fold_equals_batch(spark):
    records = [(f"r{i % 40}", f"c{i * 7 % 5}", i, i % 2 + 1, i % 3 == 0, 95.0 + i * 13 % 6) for i in range(400)]
    batch = {(r["read_id"], r["contig"]): r["weight"] for r in counts.read_weights(counts.fold_contigs(rows(spark, *records))).collect()}
    stream = {}
    for read in {r[0] for r in records}:
        entries = counter.fold([(r[2], r[1], r[3], r[4], r[5]) for r in records if r[0] == read])
        stream |= {(read, c): w for c, w in counter.weigh(entries, 97.0, 1.0)}
    assert stream == {k: pytest.approx(v) for k, v in batch.items()}


def test_candidates_from_records(spark):
    records = [
        ("s", "r1", 0, 67, "a", "10M", "I" * 10, "10"), ("s", "r1", 1, 131, "a", "10M", "*", "4A5"),
        ("s", "r2", 2, 67, "a", "5M1I4M", "I" * 10, "9"), ("s", "r2", 3, 67, "a", "10M", "I" * 10, "10"),
        ("s", "r3", 4, 67, "short", "10M", "I" * 10, "10"), ("s", "r4", 5, 65, "a", "4S6M", "I" * 10, "6"),
    ]
    df = spark.createDataFrame(records, "sample string, read_id string, ord long, flag int, contig string, cigar string, qual string, md string")
    contigs = spark.createDataFrame([("a", 3000)], "name string, length int")
    got = {(r["read_id"], r["ord"]): (r["dir"], r["proper"], r["identity"]) for r in counts.candidates(df, contigs).collect()}
    assert got == {("r1", 0): (1, True, 100.0), ("r1", 1): (2, True, 90.0), ("r2", 3): (1, True, 100.0)}


def test_zero_rows_and_guard(spark):
    table = spark.createDataFrame([("s", "a", 1.0)], "sample string, contig string, count double")
    contigs = spark.createDataFrame([("a", 1), ("b", 1)], "name string, length int")
    full = counts.with_zero_rows(table, contigs, spark.createDataFrame([("s",)], "sample string"))
    assert sorted((r["contig"], r["count"]) for r in full.collect()) == [("a", 1.0), ("b", 0.0)]
    with pytest.raises(ValueError):
        counts.require_counts(full)


def test_streamed_weights_over_batches_equal_batch(spark, tmp_path):
    records = [(f"r{i % 40}", f"c{i * 7 % 5}", i, i % 2 + 1, i % 3 == 0, 95.0 + i * 13 % 6) for i in range(400)]
    # this read counts after the first batch only: its average falls below the least identity then
    records = [("gone", "c0", 0, 1, False, 97.0), *records, ("gone", "c0", 1000, 2, False, 90.0)]
    for at, part in enumerate((records[:150], records[150:300], records[300:])):
        rows(spark, *part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"batch={at}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/n={number}"))

    stream = counter.weights_stream(source)
    stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).drop("n")
    got = {(r["read_id"], r["contig"]): r["weight"] for r in counter.latest(found).collect()}
    wanted = {(r["read_id"], r["contig"]): r["weight"] for r in counts.read_weights(counts.fold_contigs(rows(spark, *records))).collect()}
    assert got == {k: pytest.approx(v) for k, v in wanted.items()} and "gone" not in {k[0] for k in got}
