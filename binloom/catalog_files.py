"""Queries that write driver tables by a sink, read them back by a source, and compare in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.catalog import EVENTS_SQL, ORDER, SEQ_SQL, WEIGHTS_SQL, _weights, event_counts, query, r4, sequences, table
from binloom.operators import composition, counts, hits, network
from binloom.operators.latent import bin_network
from binloom.operators.order import ranked
from binloom.plans import markers
from binloom.sources import bam, sinks, text
from binloom.storage import shared_folder


def _place(spark) -> str:
    """A fresh folder where driver and executors write alike."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- alignments as text


def _sam(spark, sf_dir: str) -> str:
    """A folder of SAM text: suppliers as contigs in the header, order lines as records, a file for each of the table's parts."""
    folder = _place(spark)
    head = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(
        F.format_string("@SQ\tSN:c%d\tLN:%d", "s_suppkey", F.col("s_suppkey") * 937 % 5000 + 1000).alias("value"), F.lit(1).alias("part"), F.col("s_suppkey").alias("at")
    )
    first = spark.createDataFrame([("@HD\tVN:1.6\tSO:unsorted", 0, 0)], "value string, part int, at long")
    lines = table(spark, sf_dir, "lineitem")
    cigar = F.concat(F.col("l_linenumber").cast("string"), F.lit("S20M"))
    record = F.concat_ws(
        "\t", F.concat(F.lit("r"), F.col("l_orderkey")), (F.col("l_partkey") % 256).cast("string"), F.concat(F.lit("c"), F.col("l_suppkey")), F.lit("1"), F.lit("9"), cigar,
        F.lit("="), F.lit("1"), F.lit("0"), F.lit("*"), F.repeat(F.lit("I"), F.col("l_linenumber") + 20), F.lit("AS:i:0"), F.concat(F.lit("MD:Z:"), F.col("l_linenumber").cast("string"), F.lit("A1")),
    )
    sinks.write_lines(first.union(head).orderBy("part", "at").coalesce(1), f"{folder}/head")
    sinks.write_lines(lines.select(record.alias("value")), f"{folder}/lines")
    return folder


@query("""
    SELECT 'r' || l_orderkey AS read_id, (l_partkey % 256)::INT AS flag, 'c' || l_suppkey AS contig, l_linenumber || 'S20M' AS cigar,
           repeat('I', (l_linenumber + 20)::INT) AS qual, l_linenumber || 'A1' AS md FROM lineitem""")
def sam_records(spark, sf_dir):
    lines = text.check_sorted(text._lines(spark, f"{_sam(spark, sf_dir)}/*"))
    return text.sam_records(lines).select("read_id", "flag", "contig", "cigar", "qual", "md")


@query("""
    SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS ref_id, 'c' || s_suppkey AS name, (s_suppkey * 937 % 5000 + 1000)::INT AS length
    FROM supplier QUALIFY length >= 2000""")
def sam_contigs(spark, sf_dir):
    _, contigs = text.read_sam(spark, f"{_sam(spark, sf_dir)}/*")
    return contigs.select("ref_id", "name", "length")


@query("""
    SELECT 'r' || l_orderkey AS read_id, 'c' || l_suppkey AS contig,
           CASE WHEN l_partkey % 256 & 64 <> 0 THEN 1 WHEN l_partkey % 256 & 128 <> 0 THEN 2 ELSE 0 END AS dir, l_partkey % 256 & 2 <> 0 AS proper, 95.0::DOUBLE AS identity
    FROM lineitem WHERE l_suppkey * 937 % 5000 + 1000 >= 2000""")
def sam_candidates(spark, sf_dir):
    """Records of long contigs as candidates: one of twenty bases differs in each."""
    records, contigs = text.read_sam(spark, f"{_sam(spark, sf_dir)}/*")
    return counts.candidates(records, contigs).select("read_id", "contig", "dir", "proper", r4("identity").alias("identity"))


@query(f"""
    SELECT 'r' || l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS place, (l_partkey % 256)::INT AS flag, 'c' || l_suppkey AS contig
    FROM lineitem""")
def sam_order(spark, sf_dir):
    """Records of a read come in the order in which they were written, by the places that they are read with."""
    place = _place(spark)
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey", *[c.strip() for c in ORDER.split(",")])
    fields = [F.concat(F.lit("r"), F.col("l_orderkey")), (F.col("l_partkey") % 256).cast("string"), F.concat(F.lit("c"), F.col("l_suppkey")), *[F.lit(v) for v in ("1", "9", "20M", "=", "1", "0", "*", "*")]]
    sinks.write_lines(lines.select(F.concat_ws("\t", *fields).alias("value")), place)
    found = text.sam_records(text._lines(spark, place))
    order = Window.partitionBy("read_id").orderBy("ord")
    return found.select("read_id", F.row_number().over(order).cast("long").alias("place"), "flag", "contig")


# ---------------------------------------------------------------- alignments, packed

#: So small a stretch that several tasks read each file of the small tables, too.
BAM_SPLIT = 1 << 18
#: Records of the files of one part, so that a task that writes one does not grow with the table.
BAM_PART_RECORDS = 9_000_000


@query(f"""
    SELECT l_returnflag AS sample, 'r' || l_orderkey AS read_id, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY {ORDER}) AS place, (l_partkey % 256)::INT AS flag,
           CASE WHEN l_suppkey % 10 = 0 THEN '*' ELSE 'c' || l_suppkey END AS contig, l_linenumber || 'S20M' AS cigar, repeat('I', (l_linenumber + 20)::INT) AS qual, l_linenumber || 'A1' AS md
    FROM lineitem""")
def bam_records(spark, sf_dir):
    """Order lines written as BAM files of their samples, and read again by splits, with their order in a read; some suppliers are not in the header."""
    place, lines = _place(spark), table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_returnflag", "l_orderkey").orderBy(*[c.strip() for c in ORDER.split(",")])
    made = lines.select(
        F.col("l_returnflag").alias("sample"), F.concat(F.lit("r"), F.col("l_orderkey")).alias("read_id"), F.row_number().over(w).cast("long").alias("ord"), (F.col("l_partkey") % 256).cast("int").alias("flag"),
        F.concat(F.lit("c"), F.col("l_suppkey")).alias("contig"), F.concat(F.col("l_linenumber").cast("string"), F.lit("S20M")).alias("cigar"),
        F.repeat(F.lit("I"), F.col("l_linenumber") + 20).alias("qual"), F.concat(F.col("l_linenumber").cast("string"), F.lit("A1")).alias("md"),
    )
    suppliers = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 0")
    contigs = suppliers.select(F.col("s_suppkey").cast("int").alias("ref_id"), F.concat(F.lit("c"), F.col("s_suppkey")).alias("name"), (F.col("s_suppkey") * 937 % 5000 + 1000).cast("int").alias("length"))
    bam.write(made, contigs, place, max(4, -(-lines.count() // BAM_PART_RECORDS)))
    bam.register(spark)
    found = spark.read.format("bam").option("sample", bam.WRITTEN_SAMPLE).option("split", BAM_SPLIT).load(place)
    order = Window.partitionBy("sample", "read_id").orderBy("ord")
    return found.withColumn("place", F.row_number().over(order).cast("long")).drop("ord")


# ---------------------------------------------------------------- sequences as text


def _fasta(spark, sf_dir: str) -> str:
    folder = _place(spark)
    bins = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("contig"), F.coalesce("source", F.lit("none")).alias("bin"))
    plain = sequences(spark, sf_dir).select(F.concat(F.lit("d_"), F.col("name")).alias("name"), F.regexp_replace("seq", "[^A-Za-z]", "").alias("seq"))
    sinks.write_bin_fasta(plain, bins.withColumn("contig", F.concat(F.lit("d_"), F.col("contig"))), folder)
    return folder


PLAIN_SQL = f"SELECT name, regexp_replace(seq, '[^A-Za-z]', '', 'g') AS seq FROM ({SEQ_SQL})"


@query(f"SELECT 'd_' || name AS name, length(seq) AS length, md5(seq) AS digest FROM ({PLAIN_SQL})")
def fasta_records(spark, sf_dir):
    found = text.read_fasta(spark, f"{_fasta(spark, sf_dir)}/*")
    return found.select("name", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))


@query(f"SELECT 'd_' || name AS name, length(seq) AS length FROM ({PLAIN_SQL}) WHERE name % 3 = 0")
def selected_sequences(spark, sf_dir):
    chosen = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("d_"), F.col("doc_id")).alias("name"))
    found = text.selected(text.read_fasta(spark, f"{_fasta(spark, sf_dir)}/*", strict=True), chosen)
    return found.select("name", F.length("seq").cast("long").alias("length"))


@query("""
    SELECT 'd' || doc_id % 7 || '_' || doc_id AS name, 'd' || doc_id % 7 AS contig, (doc_id % 7 * 2 + 1)::INT AS ref_id FROM documents WHERE doc_id % 7 <> 3""")
def coding_ordinals(spark, sf_dir):
    """Coding sequences joined to the number of their contig, where it has one."""
    place, docs = _place(spark), table(spark, sf_dir, "documents")
    contig = F.concat(F.lit("d"), F.col("doc_id") % 7)
    sinks.write_lines(docs.select(F.concat(F.lit(">"), contig, F.lit("_"), F.col("doc_id"), F.lit("\nACGTACGTACGT")).alias("value")), place)
    contigs = docs.filter("doc_id % 7 <> 3").select((F.col("doc_id") % 7 * 2 + 1).cast("int").alias("ref_id"), contig.alias("name")).distinct()
    return text.with_ordinals(text.read_reading_frames(spark, f"{place}/*"), contigs).select("name", "contig", "ref_id")


@query("SELECT coalesce(source, 'none') AS bin, count(*) AS n FROM documents GROUP BY 1")
def bin_folders(spark, sf_dir):
    """The folders that a FASTA file for each bin makes, as a column."""
    lines = spark.read.text(_fasta(spark, sf_dir)).filter(F.col("value").startswith(">"))
    return lines.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- tables


@query(f"SELECT sample, contig, round(sum(weight), 4) AS count FROM ({WEIGHTS_SQL}) GROUP BY sample, contig")
def stored_counts(spark, sf_dir):
    """Counts by sample, in a folder each."""
    place = _place(spark)
    for _ in range(2):  # the second run replaces the first
        sinks.write_counts(counts.contig_counts(_weights(spark, sf_dir)), place)
    return spark.read.parquet(place).select(F.col("sample").cast("string").alias("sample"), "contig", r4("count").alias("count"))


@query(f"SELECT contig::VARCHAR AS contig, sample, count::DOUBLE AS count FROM ({EVENTS_SQL})")
def delimited_counts(spark, sf_dir):
    place = _place(spark)
    sinks.write_table(event_counts(spark, sf_dir).select("contig", "sample", F.col("count").cast("double")), place)
    return text.read_delimited(spark, place, text.NAMED_COUNTS)


@query("SELECT doc_id::VARCHAR AS contig, source AS bin FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, 'all' FROM documents")
def stored_bins(spark, sf_dir):
    """Bins as a table; a contig may have several."""
    docs, place = table(spark, sf_dir, "documents"), _place(spark)
    own = docs.filter("source IS NOT NULL").select(F.col("doc_id").alias("contig"), F.col("source").alias("bin"))
    sinks.write_table(own.union(docs.select("doc_id", F.lit("all"))), place, ",")
    return text.read_bins(spark, place)


@query(f"SELECT sample, read_id::VARCHAR AS read_id, contig, dir, paired, n, round(weight, 4) AS weight FROM ({WEIGHTS_SQL})")
def stored_audit(spark, sf_dir):
    place = _place(spark)
    sinks.write_table(_weights(spark, sf_dir), place)
    return text.read_delimited(spark, place, "sample STRING, read_id STRING, contig STRING, dir LONG, paired BOOLEAN, n LONG, weight DOUBLE").withColumn("weight", r4("weight"))


@query("SELECT p_partkey AS name, p_size + p_partkey % 3 AS k0, 256 AS n FROM part")
def stored_arrays(spark, sf_dir):
    """Arrays go to columns, and come back as they were."""
    place = _place(spark)
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.col("p_size") + (F.col("p_partkey") + i) % 3).alias("kmer"))
    sinks.write_columns(made, place)
    return spark.read.parquet(place).select("name", F.col("kmer")[0].alias("k0"), F.size("kmer").alias("n"))


@query("""
    WITH named AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)
    SELECT lang AS cluster, array_to_string(list(row ORDER BY row), ' ') AS members FROM documents JOIN named USING (doc_id) GROUP BY lang""")
def clusters_as_lists(spark, sf_dir):
    docs, place = table(spark, sf_dir, "documents"), _place(spark)
    sinks.write_table(docs.select("lang", "doc_id"), place, "\t")
    clusters = text.read_delimited(spark, place, "cluster STRING, contig STRING", "\t")
    names = ranked(docs.select("doc_id", F.col("doc_id").cast("string").alias("name")), "doc_id", name="row").select("name", "row")
    return text.clusters_as_lists(clusters, names).select("cluster", F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members"))


_CUTOFFS_SQL = ", ".join(f"('{cog}', {score})" for cog, score in hits.CUTOFFS.items())


@query(f"""
    WITH h AS (SELECT 'c' || l_suppkey AS contig, 'COG0' || lpad((l_partkey % 600)::VARCHAR, 3, '0') AS cog, l_quantity * 10 AS score FROM lineitem),
    k AS (SELECT h.* FROM h JOIN (VALUES {_CUTOFFS_SQL}) AS c(cog, cutoff) ON c.cog = h.cog WHERE score >= cutoff),
    t AS (SELECT contig, cog FROM k QUALIFY score = max(score) OVER (PARTITION BY contig))
    SELECT (s_suppkey - 1)::INT AS ref_id, min(cog) AS cog FROM t JOIN supplier ON 'c' || s_suppkey = contig GROUP BY s_suppkey HAVING count(DISTINCT cog) = 1""")
def marker_ordinals(spark, sf_dir):
    """Hits of a table joined to the numbers of their contigs, written and read again."""
    place, lines = _place(spark), table(spark, sf_dir, "lineitem")
    cog = F.concat(F.lit("COG0"), F.lpad((F.col("l_partkey") % 600).cast("string"), 3, "0"))
    contig = F.concat(F.lit("c"), F.col("l_suppkey"))
    sinks.write_table(lines.select(F.concat(contig, F.lit("_1")).alias("name"), contig.alias("query"), cog.alias("cog"), (F.col("l_quantity") * 10).alias("bitscore")), f"{place}/hits", "\t")
    contigs = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).cast("int").alias("ref_id"), F.concat(F.lit("c"), F.col("s_suppkey")).alias("name"))
    sinks.write_table(markers.marker_rows(text.read_delimited(spark, f"{place}/hits", markers.HITS, "\t"), contigs), f"{place}/out", "\t")
    return text.read_delimited(spark, f"{place}/out", "ref_id INT, cog STRING", "\t")


@query("""
    WITH m AS (SELECT l_linenumber - 1 AS epoch, avg(l_discount) AS reads, avg(l_tax) AS kmers FROM lineitem GROUP BY 1)
    SELECT epoch::INT AS epoch, 'reads' AS head, round(reads, 6) AS loss FROM m UNION ALL SELECT epoch::INT, 'kmers', round(kmers, 6) FROM m""")
def stored_model(spark, sf_dir):
    """A network's weights come back as they were, and so do losses, which are means of a table here."""
    place, net = _place(spark), bin_network(3, 4, hidden=6, latent=2)
    means = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("reads"), F.avg("l_tax").alias("kmers"))
    losses = [[float(r["reads"]), float(r["kmers"])] for r in means.orderBy("l_linenumber").collect()]  # seven rows
    sinks.write_model(net, spark, place, losses)
    again = network.from_weights(bin_network(3, 4, hidden=6, latent=2, seed=9), spark.read.parquet(f"{place}/weights"))
    if (again.flat() != net.flat()).any():
        raise AssertionError("weights differ")
    return spark.read.parquet(f"{place}/losses").withColumn("loss", F.round("loss", 6))


@query(f"""
    SELECT name, length(seq) >= 200 AS long_enough, true AS inside FROM ({SEQ_SQL}) WHERE length(seq) >= 200""")
def fragment_properties(spark, sf_dir):
    """A fragment for each sequence that is long enough, of the least length at least, and found where it says."""
    rows = sequences(spark, sf_dir)
    made = composition.fragments(rows, 200).select("name", "start", F.col("seq").alias("part"))
    inside = F.expr("substring(seq, start + 1, length(part))") == F.col("part")
    return made.join(rows, "name").select("name", (F.length("part") >= 200).alias("long_enough"), inside.alias("inside"))
