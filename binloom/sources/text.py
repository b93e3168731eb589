"""Readers of SAM text, FASTA and delimited tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SELECTED = "ref_id INT, name STRING, length INT"
COUNTS = "ref_id INT, sample STRING, count DOUBLE"
NAMED_COUNTS = "contig STRING, sample STRING, count DOUBLE"
BINS = "contig STRING, bin STRING"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and their place in it: where their stretch of the file starts, and a number that rises within it.

    Stretches of a file may be read by any tasks in any order; the place tells the lines' order all the same.
    """
    raw = spark.read.text(path, wholetext=False)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return raw.select("value", F.col("_metadata.file_path").alias("file"), place.alias("at"))


def sample_name(file: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.substring_index(file, "/", -1), r"(?<=.)\.[A-Za-z0-9]+$", "")


def check_sorted(lines: DataFrame) -> DataFrame:
    """``lines``, unless a @HD line says that the file is sorted otherwise than by read name."""
    bad = lines.filter(F.col("value").startswith("@HD") & ~F.col("value").contains("SO:unsorted") & F.col("value").contains("SS"))
    if not bad.isEmpty():
        raise ValueError("alignments must be unsorted or sorted by read name")
    return lines


def sam_contigs(lines: DataFrame, least: int = 2000) -> DataFrame:
    """(file, ref_id, name, length) of the @SQ lines; numbers count short contigs too."""
    head = lines.filter(F.col("value").startswith("@SQ"))
    found = head.select("file", "at", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("length"))
    numbered = found.withColumn("ref_id", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("int"))
    return numbered.filter(F.col("length") >= least).select("file", "ref_id", "name", "length")


def sam_records(lines: DataFrame) -> DataFrame:
    """(sample, read_id, ord, flag, contig, cigar, qual, md) of the alignment lines; ord is the line's place, MD is found by its tag."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("@") & (F.size(f) >= 11))
    return rows.select(
        sample_name(F.col("file")).alias("sample"), f[0].alias("read_id"), F.col("at").alias("ord"), f[1].cast("int").alias("flag"), f[2].alias("contig"),
        f[5].alias("cigar"), f[10].alias("qual"), F.nullif(F.regexp_extract("value", r"\tMD:Z:([^\t]+)", 1), F.lit("")).alias("md"),
    )


def read_sam(spark: SparkSession, path: str, least: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Records and contigs of SAM files (a folder, a glob or gzip files as well)."""
    lines = check_sorted(_lines(spark, path))
    contigs = sam_contigs(lines, least)
    if contigs.isEmpty() and not sam_records(lines).isEmpty():
        raise ValueError("alignments without usable @SQ header lines")
    return sam_records(lines), contigs


def read_fasta(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(name, seq): names end at white space, body lines are joined; a missing last line feed is no matter.

    ``strict`` skips body lines that hold anything but letters.  Records are split by the reader where a line
    starts with ">", so large files are read in parallel and a ">" inside a header stays.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^\\s*>", "").alias("value")).filter(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\r?\n")
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    body = F.transform(body, lambda x: F.trim(x))
    if strict:
        body = F.filter(body, lambda x: x.rlike("^[A-Za-z]+$"))
    return raw.select(F.regexp_extract(parts[0], r"^(\S+)", 1).alias("name"), F.array_join(body, "").alias("seq"))


def read_reading_frames(spark: SparkSession, path: str) -> DataFrame:
    """(name, contig, seq): coding sequences, whose contig is the name without its last ``_suffix``."""
    return read_fasta(spark, path).select("name", F.regexp_replace("name", r"_[^_]*$", "").alias("contig"), "seq")


def with_ordinals(rows: DataFrame, contigs: DataFrame, name: str = "contig") -> DataFrame:
    """Rows of known contigs with their number: coding sequences or marker hits joined to (ref_id, name)."""
    return rows.join(contigs.select(F.col("name").alias(name), "ref_id"), name)


def selected(sequences: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sequences of selected contigs only."""
    return sequences.join(contigs.select("name"), "name", "left_semi")


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = " ") -> DataFrame:
    """A headerless table with a known schema."""
    return spark.read.schema(schema).csv(path, sep=separator)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bin); a contig may have several."""
    return read_delimited(spark, path, BINS, ",")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, array, row, values) of .npy and .npz files: one array a row of each matrix, "" naming that of a .npy file.

    A file is read whole by one task.
    """
    schema = "file string, array string, row long, values array<double>"

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for part in batches:
            for name, content in zip(part["path"], part["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                for key in found.files if hasattr(found, "files") else [""]:
                    values = np.asarray(found[key] if key else found, dtype=float)
                    matrix = values.reshape(-1, 1) if values.ndim < 2 else values.reshape(len(values), -1)
                    yield pd.DataFrame({"file": name, "array": key, "row": range(len(matrix)), "values": list(matrix)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_matrix(spark: SparkSession, path: str, names: str | None = None, array: str | None = None) -> DataFrame:
    """(row, values) of a .npy file, or of one array of a .npz file; ``names`` is a text file of row names, in order.

    Several files, or several arrays without ``array``, would share row numbers, so read those by ``read_arrays``.
    """
    found = read_arrays(spark, path)
    rows = (found if array is None else found.filter(F.col("array") == array)).select("row", "values")
    if names is None:
        return rows
    lines = spark.read.text(names, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("row", "name"))
    return rows.join(lines.withColumn("row", F.col("row").cast("long")), "row").select("name", "values")


def clusters_as_lists(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, members): numbers of ``names`` (name, row) by cluster (contig, cluster), sorted."""
    joined = clusters.join(names.withColumnRenamed("name", "contig"), "contig")
    return joined.groupBy("cluster").agg(F.sort_array(F.collect_list("row")).alias("members")).orderBy("cluster")
