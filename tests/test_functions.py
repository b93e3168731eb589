import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binloom import catalog
from binloom.functions import alignment as al
from binloom.functions import numeric as nm
from binloom.functions import sequence as sq
from binloom.operators import composition


def test_log_gamma_error_bound():
    x = np.concatenate([np.linspace(0.2, 50, 5000), np.logspace(0, 6, 2000)])
    true = np.array([math.lgamma(v) for v in x])
    assert np.abs(nm.log_gamma_np(x) - true).max() < 2e-3


def test_columns_agree_with_numpy(spark):
    rows = spark.createDataFrame([(v,) for v in (0.5, 1.0, 7.25, 1e5)], "x double")
    for x, y in rows.select("x", nm.log_gamma(F.col("x"))).collect():
        assert y == pytest.approx(float(nm.log_gamma_np([x])[0]))
    values = rows.select(nm.log1p_exp(F.col("x")), nm.log1p_exp(-F.col("x"))).collect()
    assert values[3][0] == 1e5 and values[3][1] == 0.0
    assert values[1][0] == pytest.approx(math.log1p(math.e))


def test_chi_square_tail():
    assert nm.chi2_sf(0, 3) == 1
    assert nm.chi2_sf(2.0, 2) == pytest.approx(math.exp(-1))
    assert nm.chi2_sf(18.307038, 10) == pytest.approx(0.05, rel=1e-5)


def test_poisson_entropy_is_near_the_sum(spark):
    for mean in (0.5, 3.0, 20.0):
        p = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(200)]
        true = -sum(q * math.log(q) for q in p if q > 0)
        got = spark.range(1).select(nm.poisson_entropy(F.lit(mean))).first()[0]
        assert got == pytest.approx(true, abs=1e-3)


def test_reverse_complement_keeps_tetramers():
    seq = "ACGTTGCAAGGCTTACCA"
    back = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert (sq.tetramer_counts(seq) == sq.tetramer_counts(back)).all()
    assert sq.tetramer_counts("ACG").sum() == 0
    assert sq.tetramer_counts(seq).sum() == 2 * (len(seq) - 3)


@pytest.mark.parametrize(
    ("cigar", "md", "qual", "start", "end", "identity"),
    [
        ("10M", "10", "I" * 10, 0, 10, 100.0),
        ("2S8M", "8", "I" * 10, 2, 10, 100.0),
        ("8M2S", "4A3", "I" * 10, 0, 8, 87.5),
        ("2S6M2S", "0A5", "I" * 10, 2, 8, 100 * 5 / 6),
        ("10M", "4A5", "IIII#IIIII", 0, 10, 100.0),
        ("10M", "10", "#" * 10, 0, 10, None),
    ],
)
def test_alignment_window_and_identity(spark, cigar, md, qual, start, end, identity):
    row = spark.createDataFrame([(cigar, md, qual)], "c string, m string, q string").select(
        al.clipped_start(F.col("c")).alias("s"), al.clipped_end(F.col("c"), F.length("q")).alias("e"), "m", "q"
    )
    s, e, value = row.select("s", "e", al.identity(F.col("m"), F.col("q"), F.col("s"), F.col("e"))).first()
    assert (s, e) == (start, end)
    assert value == (pytest.approx(identity) if identity is not None else None)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    norm, zero, soft = row.select(nm.l2_normalised(F.col("a")), nm.l2_normalised(F.col("b")), nm.softmax(F.col("a"))).first()
    assert norm == pytest.approx([0.6, 0.8]) and zero == [0.0, 0.0]
    assert sum(soft) == pytest.approx(1)


def test_native_tetramers_read_each_sequence_once(spark):
    seqs = ["", "ATG", "ATGC", "AANNTTGGCC\nATGNNN", "x😀yATGCé" * 30, None, "ATGCATGCTTTTAAAA" * 50]
    rows = spark.createDataFrame(list(enumerate(seqs)), "name long, seq string")
    made = composition.tetramers_long(rows)
    wanted = {(r["name"], r["kmer"]): r["n"] for r in composition.long_form(composition.tetramers(rows)).filter("n > 0").collect()}
    assert {(r["name"], r["kmer"]): r["n"] for r in made.collect()} == wanted
    # the other strand's words come of the counted ones, not of a second reading
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + made._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_tetramers_are_counted_in_small_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["ATGCA"] * 1000)], ["name", "seq"])
    for step in (composition._counted, composition._codons_counted):
        parts = list(step(iter([batch])))
        assert max(p.num_rows for p in parts) <= 256 and sum(p.num_rows for p in parts) == 1000


def test_letters_are_counted_from_bytes(spark, monkeypatch, tmp_path):
    texts = [None, "", "Hello World", "\u0130stanbul \u0130I\u0131i", "5 \u212a Kk", "\u00c4\u00e4\u017f\u00df\u0390 \U0001f600zZ", "x" * 70 + "Y\u212a" * 5, "\x00a\nb\tA"] + [chr(97 + i % 26) * (i % 5) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    low = F.lower(F.coalesce("text", F.lit("")))
    each = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in catalog.LETTERS])
    wanted = {r["doc_id"]: r["p"] for r in docs.select("doc_id", each.alias("p")).collect()}
    made = catalog.letter_profiles(spark, str(tmp_path))
    got = made.collect()
    assert {r["contig"]: r["profile"] for r in got} == wanted and len(got) == len(texts)
    assert all(r["total"] == sum(r["profile"]) for r in got)
    plan = made._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "replace(" not in plan  # a text was read 26 times before
    groups = {r["contig"]: r["profile"] for r in catalog.letter_profiles(spark, str(tmp_path), [F.coalesce("source", F.lit(""))]).collect()}
    assert groups == {k: [sum(c) for c in zip(*(wanted[i] for i in wanted if (i % 2 == 1) == (k == "s")), strict=True)] for k in ("", "s")}
    monkeypatch.setattr(composition, "PIECE_BYTES", 3)
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], ["name", "seq"]).slice(1, 300)
        pieces = {k: v for b in composition._letters_counted([batch, batch.slice(0, 0)]) for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert pieces == {i: wanted[i] for i in range(1, 301)}
