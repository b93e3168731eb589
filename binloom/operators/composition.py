"""Composition of sequences: tetramers of both strands, GC share, repeat masking, codons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions import sequence as sq

#: A tetramer that occurs more often than so many times what GC alone lets expect is a repeat.
REPEAT_EXCESS = 3.0
#: Sequences that a task counts at once.
SLICE_ROWS = 256
#: Bytes of a sequence whose letters are counted at once.
PIECE_BYTES = 1 << 20
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _slices(batches):
    """Batches of few rows: Spark puts 10,000 in one, and a task should not hold all their texts twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _counted(batches):
    for batch in _slices(batches):
        rows = [sq.tetramer_counts(x or "") for x in batch.column("seq").to_pylist()]
        values = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 256), values)
        yield pa.RecordBatch.from_arrays([batch.column("name"), lists], ["name", "kmer"])


def tetramers(sequences: DataFrame) -> DataFrame:
    """(name, kmer): 256 counts over both strands for each of ``sequences`` (name, seq), by numpy in Arrow batches."""
    kind = sequences.schema["name"].dataType.simpleString()
    return sequences.select("name", "seq").mapInArrow(_counted, f"name {kind}, kmer array<long>")


def _letters_counted(batches):
    """(name, letters): 26 counts of each lower-cased sequence, from its UTF-8 bytes."""
    code = np.full(256, len(LETTERS), np.uint8)
    for i, letter in enumerate(LETTERS):
        code[ord(letter)] = code[ord(letter.upper())] = i
    # the only other characters whose lower case has one of these letters
    others = {"\u0130": LETTERS.index("i"), "\u212a": LETTERS.index("k")}
    for batch in _slices(batches):
        texts = pc.fill_null(batch.column("seq").cast(pa.large_string()), "")
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        counts = np.zeros((len(texts), len(LETTERS)))
        for row, start, end in zip(counts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            for at in range(start, end, PIECE_BYTES):
                row += np.bincount(code[raw[at : min(at + PIECE_BYTES, end)]], minlength=len(LETTERS) + 1)[:-1]
        for other, i in others.items():
            counts[:, i] += pc.count_substring(texts, other).to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(LETTERS)), pa.array(counts.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("name"), lists], ["name", "letters"])


def letters(sequences: DataFrame) -> DataFrame:
    """(name, letters): how often each of 26 letters, of either case, occurs in each of ``sequences`` (name, seq), null having none."""
    kind = sequences.schema["name"].dataType.simpleString()
    return sequences.select("name", "seq").mapInArrow(_letters_counted, f"name {kind}, letters array<double>")


def tetramers_long(sequences: DataFrame) -> DataFrame:
    """(name, kmer, n) by built-in expressions alone, words that occur only.

    Words are counted as they are read, unknown bases as N; what they and their reverse complements number, and that N is A on
    both strands, is worked out for the distinct words.
    """
    known = sequences.select("name", F.regexp_replace("seq", "(?s)[^ATGC]", "N").alias("s"))
    frames = [F.regexp_extract_all(F.substring("s", i + 1, 2**31 - 1), F.lit("(.{4})"), F.lit(1)) for i in range(sq.WORD)]
    words = known.select("name", F.explode(F.array(*frames)).alias("f")).select("name", F.explode("f").alias("word")).groupBy("name", "word").agg(F.count(F.lit(1)).alias("n"))
    number = lambda w, digits: F.conv(F.translate(w, sq.BASES + "N", digits), 4, 10).cast("int")
    both = F.array(number(F.col("word"), "01230"), number(F.reverse("word"), "10320"))
    return words.select("name", "n", F.explode(both).alias("kmer")).groupBy("name", "kmer").agg(F.sum("n").alias("n"))


def long_form(matrix: DataFrame) -> DataFrame:
    """(name, kmer, n) of arrays of 256."""
    return matrix.select("name", F.posexplode("kmer").alias("kmer", "n"))


def gc(sequences: DataFrame) -> DataFrame:
    return sequences.select("name", F.length("seq").alias("length"), sq.gc_fraction(F.col("seq")).alias("gc"))


def halved(counts: DataFrame) -> DataFrame:
    """Counts over both strands, halved."""
    return counts.withColumn("n", F.col("n") / 2)


def without_repeats(counts: DataFrame, shares: DataFrame, excess: float = REPEAT_EXCESS) -> DataFrame:
    """(name, kmer, n) with all four tetramers of a trimer set to 0 where one of them is a repeat.

    Expected is (length - 3) gc^g (1 - gc)^(4 - g) / 16 for a tetramer with g bases G or C.
    """
    g = sq.gc_of_word(F.col("kmer"))
    expected = (F.col("length") - 3) * F.pow("gc", g) * F.pow(1 - F.col("gc"), 4 - g) / 16
    context = Window.partitionBy("name", F.floor(F.col("kmer") / 4))
    joined = counts.join(shares.select("name", "length", "gc"), "name")
    flagged = joined.withColumn("repeat", F.max(F.when((expected > 0) & (F.col("n") / F.nullif(expected, F.lit(0.0)) > excess), 1).otherwise(0)).over(context))
    return flagged.select("name", "kmer", F.when(F.col("repeat") == 1, F.lit(0).cast("double")).otherwise(F.col("n").cast("double")).alias("n"))


def trimer_totals(counts: DataFrame) -> DataFrame:
    """(name, trimer, total): sums over the four tetramers that share their first three bases."""
    return counts.groupBy("name", F.floor(F.col("kmer") / 4).cast("int").alias("trimer")).agg(F.sum("n").alias("total"))


def tetramer_totals(counts: DataFrame) -> DataFrame:
    """(kmer, total) over all contigs."""
    return counts.groupBy("kmer").agg(F.sum("n").alias("total"))


def _codons_counted(batches):
    """(name, codon): 64 counts for each frame; codons with unknown bases count for nothing."""
    code = np.full(128, 64, np.int64)
    for i, base in enumerate(sq.BASES):
        code[ord(base)] = i
    for batch in _slices(batches):
        rows = []
        for seq in batch.column("seq"):
            points = np.frombuffer((seq.as_py() or "").encode("utf-32-le"), np.uint32)
            digits = code[np.where(points < 128, points, 0)]
            count = len(range(1, len(digits) - 4, 3))
            triples = digits[: 3 * count].reshape(-1, 3)
            numbers = triples @ np.array([16, 4, 1])
            rows.append(np.bincount(numbers[(triples < 4).all(axis=1)], minlength=64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 64), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("name"), lists], ["name", "codon"])


def codon_matrix(sequences: DataFrame) -> DataFrame:
    """(name, codon): 64 counts for each of the reading frames ``sequences`` (name, seq), one row a frame."""
    kind = sequences.schema["name"].dataType.simpleString()
    return sequences.select("name", "seq").mapInArrow(_codons_counted, f"name {kind}, codon array<long>")


def codons(sequences: DataFrame) -> DataFrame:
    """(name, codon, n) of the codons that occur; frames with unknown bases in a codon skip it."""
    return codon_matrix(sequences).select("name", F.posexplode("codon").alias("codon", "n")).filter("n > 0").groupBy("name", "codon").agg(F.sum("n").alias("n"))


def inner_stops(sequences: DataFrame) -> DataFrame:
    """(name, inner_stop): whether a reading frame has a stop codon before its last codon."""
    coded = sequences.select("name", sq.digits(F.col("seq")).alias("d"))
    return coded.select("name", F.exists(sq.codon_numbers(F.col("d")), lambda c: c.isin(*sq.STOP_CODONS)).alias("inner_stop"))


def fragments(sequences: DataFrame, least: int = 2000, seed: int = 1) -> DataFrame:
    """A random stretch of at least ``least`` bases of each sequence that is long enough; ``seed`` fixes it."""
    u = lambda salt: F.abs(F.xxhash64("name", F.lit(seed), F.lit(salt)) % (1 << 40)) / F.lit(float(1 << 40))
    start = F.floor(u(1) * (F.length("seq") - least + 1)).cast("int")
    size = (least + F.floor(u(2) * (F.length("seq") - F.col("start") - least + 1))).cast("int")
    cut = sequences.filter(F.length("seq") >= least).withColumn("start", start).withColumn("size", size)
    return cut.select("name", "start", F.expr("substring(seq, start + 1, size)").alias("seq"))
