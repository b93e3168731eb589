"""Fractional read counts: alignments of each read are folded to one entry a contig, then weighed.

Input rows are (sample, read_id, contig, ord, dir, proper, identity), ``ord`` giving the order of a read's
records, which a DataFrame does not have by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions import alignment as al

READ = ["sample", "read_id"]
#: Samples that a table of counts has at most: one for each alignment file.
MOST_SAMPLES = 100_000


def keep_long(contigs: DataFrame, least: int = 2000) -> DataFrame:
    """Contigs of at least ``least`` bases."""
    return contigs.filter(F.col("length") >= least)


def carried_quality(records: DataFrame) -> DataFrame:
    """A record without quality string takes that of the last record of the same read that had one."""
    window = Window.partitionBy(*READ).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    given = F.when(F.col("qual") != "*", F.col("qual"))
    return records.withColumn("qual", F.last(given, ignorenulls=True).over(window))


def candidates(records: DataFrame, contigs: DataFrame, gaps: bool = False, least_coverage: float = al.LEAST_COVERAGE) -> DataFrame:
    """Alignment candidates of raw records (sample, read_id, ord, flag, contig, cigar, qual, md).

    Records of unknown or short contigs go first, before any string is parsed; then those whose CIGAR has
    gaps (or, with ``gaps``, more than two operations), those covered too little, and those without a
    base of sufficient quality.  A record with a gap that is in a proper pair takes its contig's earlier
    records of the same read with it.
    """
    known = carried_quality(records.join(contigs.select(F.col("name").alias("contig")), "contig", "left_semi"))
    usable = al.simple_shape(F.col("cigar")) if gaps else al.without_gaps(F.col("cigar"))
    spoilt = F.when(~usable & al.has_flag(F.col("flag"), al.PROPER), F.col("ord"))
    later = Window.partitionBy(*READ, "contig")
    known = known.withColumn("free", F.lit(True) if gaps else F.coalesce(F.col("ord") > F.max(spoilt).over(later), F.lit(True)))
    start, length = al.clipped_start(F.col("cigar")), F.length("qual")
    end = al.clipped_end(F.col("cigar"), length)
    measured = known.filter(usable & F.col("free")).withColumns({"start": start, "end": end, "length": length})
    measured = measured.filter(al.coverage(F.col("start"), F.col("end"), F.col("length")) >= least_coverage)
    identity = al.identity(F.col("md"), F.col("qual"), F.col("start"), F.col("end"))
    # a filter would evaluate the identity again for each of its conditions
    usable_identity = F.explode(F.filter(F.array(identity), lambda x: x.isNotNull() & ~F.isnan(x)))
    return measured.select(*READ, "contig", "ord", al.pair_direction(F.col("flag")).alias("dir"), al.has_flag(F.col("flag"), al.PROPER).alias("proper"), usable_identity.alias("identity"))


def _records() -> Column:
    return F.array_sort(F.collect_list(F.struct("ord", "dir", "proper", "identity")))


def folded(records: Column) -> Column:
    """The entry (dir, paired, identity, averaged) that a contig's records in order, structs of dir, proper and identity, fold to."""
    first = records[0]
    start = F.struct(first["dir"].alias("dir"), first["proper"].alias("paired"), first["identity"].cast("double").alias("identity"), F.lit(False).alias("averaged"))

    def step(acc: Column, x: Column) -> Column:
        mean = (acc["identity"] + x["identity"]) / 2
        other = x["dir"] != acc["dir"]
        value = F.when(other, F.when(~acc["averaged"] | (mean > acc["identity"]), mean).otherwise(acc["identity"])).otherwise(F.greatest(acc["identity"], x["identity"].cast("double")))
        return F.struct(acc["dir"].alias("dir"), (acc["paired"] | other).alias("paired"), value.alias("identity"), (acc["averaged"] | other).alias("averaged"))

    return F.aggregate(F.slice(records, 2, F.greatest(F.size(records) - 1, F.lit(0))), start, step)


def fold_contigs(rows: DataFrame) -> DataFrame:
    """One entry (sample, read_id, contig, dir, paired, identity) for each contig of a read.

    The first record opens the entry.  A record of the other mate averages the identity, the first time
    always and later only upwards, and makes the entry paired; one of the same mate raises it.  Entries of
    different contigs don't meet, so the fold runs inside (read, contig) groups.
    """
    grouped = rows.groupBy(*READ, "contig").agg(_records().alias("r"))
    return grouped.select(*READ, "contig", folded(F.col("r")).alias("e")).select(*READ, "contig", "e.dir", "e.paired", "e.identity")


def fold_ordered(rows: DataFrame) -> DataFrame:
    """The stricter fold: entries of a read in order, where a further contig needs a proper pair or an identity not below the last entry's.

    A record of the other mate averages every time.  Whether a contig enters depends on the entries before,
    so a read's records are folded together.
    """
    record = F.struct("ord", "contig", "dir", "proper", "identity")
    grouped = rows.groupBy(*READ).agg(F.array_sort(F.collect_list(record)).alias("r"))
    kind = "array<struct<contig:string,dir:int,paired:boolean,identity:double>>"

    def entry(x: Column) -> Column:
        return F.struct(x["contig"].cast("string").alias("contig"), x["dir"].cast("int").alias("dir"), x["proper"].alias("paired"), x["identity"].cast("double").alias("identity"))

    def step(acc: Column, x: Column) -> Column:
        def update(e: Column) -> Column:
            other = e["dir"] != x["dir"]
            value = F.when(other, (e["identity"] + x["identity"]) / 2).otherwise(F.greatest(e["identity"], x["identity"].cast("double")))
            new = F.struct(e["contig"].alias("contig"), e["dir"].alias("dir"), (e["paired"] | other).alias("paired"), value.alias("identity"))
            return F.when(e["contig"] == x["contig"].cast("string"), new).otherwise(e)

        known = F.exists(acc, lambda e: e["contig"] == x["contig"].cast("string"))
        enters = (F.size(acc) == 0) | x["proper"] | (F.try_element_at(acc, F.lit(-1))["identity"] <= x["identity"])
        return F.when(known, F.transform(acc, update)).when(enters, F.concat(acc, F.array(entry(x)))).otherwise(acc)

    folded = F.aggregate("r", F.array().cast(kind), step)
    return grouped.select(*READ, F.inline(folded))


def read_weights(entries: DataFrame, least_identity: float = al.LEAST_IDENTITY, discordant: float = 1.0) -> DataFrame:
    """(sample, read_id, contig, dir, paired, n, weight): the best entries of each read share its count.

    A read counts if its best identity suffices; entries tied for it stay.  With n of them, p paired, a
    paired entry weighs 1/n and an equal part of what the others leave; an unpaired one 1/(2n).  Without
    any pair each weighs ``discordant``/n: 1 makes a read count once, 0.5 as half.
    """
    w = Window.partitionBy(*READ)
    best = entries.withColumn("best", F.max("identity").over(w)).filter((F.col("best") >= least_identity) & (F.col("identity") == F.col("best")))
    n, p = F.count(F.lit(1)).over(w), F.sum(F.col("paired").cast("int")).over(w)
    counted = best.select(*READ, "contig", "dir", "paired", n.alias("n"), p.alias("p"))
    share, free = F.lit(1.0) / F.col("n"), F.col("n") - F.col("p")
    weight = F.when(F.col("paired"), share + share / 2 * free / F.col("p")).when(F.col("p") > 0, share / 2).otherwise(share * discordant)
    return counted.select(*READ, "contig", "dir", "paired", "n", weight.alias("weight"))


def contig_counts(weights: DataFrame) -> DataFrame:
    """(sample, contig, count)."""
    return weights.groupBy("sample", "contig").agg(F.sum("weight").alias("count"))


def with_zero_rows(counts: DataFrame, contigs: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each contig and sample, 0 where nothing was counted; both lists are dimensions.

    Samples are collected to be put beside each contig, so there may be MOST_SAMPLES of them.
    """
    names = samples.select("sample").distinct().limit(MOST_SAMPLES + 1).collect()
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    each = samples.sparkSession.createDataFrame([(r["sample"],) for r in names], samples.select("sample").schema)
    grid = contigs.select(F.col("name").alias("contig")).crossJoin(F.broadcast(each))  # the output itself
    return grid.join(counts, ["contig", "sample"], "left").select("sample", "contig", F.coalesce("count", F.lit(0.0)).alias("count"))


def contig_links(weights: DataFrame) -> DataFrame:
    """(src, dst, weight): for each pair of contigs the sum over reads kept on both of 1/n; src < dst."""
    a = weights.select(*READ, F.col("contig").alias("src"), "n")
    b = weights.select(*READ, F.col("contig").alias("dst"))
    return a.join(b, READ).filter("src < dst").groupBy("src", "dst").agg(F.sum(1 / F.col("n")).alias("weight"))


def normalised_links(links: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds normalised: the weight over the smaller count (contig, count) of the two, 1 at most."""
    one, two = totals.select(F.col("contig").alias("src"), F.col("count").alias("c1")), totals.select(F.col("contig").alias("dst"), F.col("count").alias("c2"))
    least = F.least("c1", "c2")
    return links.join(one, "src").join(two, "dst").select("src", "dst", "weight", (F.least("weight", least) / least).alias("normalised"))


def totals(counts: DataFrame, name: str = "count") -> DataFrame:
    """Row and column sums at once: (contig, null, sum) and (null, sample, sum)."""
    return counts.groupingSets([["contig"], ["sample"]], "contig", "sample").agg(F.sum(name).alias("total"))


def wide(counts: DataFrame, samples: list[str], name: str = "count") -> DataFrame:
    """A column for each sample, the mean where a pair repeats, null where it is missing."""
    return counts.groupBy("contig").pivot("sample", samples).agg(F.avg(name))


def profiles(counts: DataFrame, name: str = "count") -> DataFrame:
    """(contig, total, profile): counts as an array in the order of all samples, zeros included."""
    summed = counts.groupBy("contig", "sample").agg(F.sum(name).cast("double").alias("x"))
    order = summed.select("sample").distinct().agg(F.sort_array(F.collect_set("sample")).alias("samples"))
    grouped = summed.groupBy("contig").agg(F.map_from_entries(F.collect_list(F.struct("sample", "x"))).alias("m"), F.sum("x").alias("total"))
    filled = F.transform("samples", lambda s: F.coalesce(F.col("m")[s], F.lit(0.0)))
    return grouped.crossJoin(F.broadcast(order)).select("contig", "total", filled.alias("profile"))  # one row


def require_counts(counts: DataFrame, name: str = "count") -> DataFrame:
    """``counts``, after making sure that no contig's counts sum to 0."""
    empty = counts.groupBy("contig").agg(F.sum(name).alias("t")).filter("t = 0")
    if not empty.isEmpty():
        raise ValueError("contigs without any count")
    return counts


def without_empty_samples(counts: DataFrame, name: str = "count") -> DataFrame:
    """Rows of samples that have a count at all; in long form the zeros come back by ``profiles``."""
    full = counts.groupBy("sample").agg(F.sum(name).alias("t")).filter("t > 0")
    return counts.join(full, "sample", "left_semi")
