"""Command line of marker hits: a table of hits to the best group of each contig, by the contig's number."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import hits
from binloom.plans.binning import session
from binloom.sources import sinks, text

HITS = "name STRING, query STRING, cog STRING, bitscore DOUBLE"


def marker_rows(found: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ref_id, cog) from hits (name, query, cog, bitscore) above their cut-offs and contigs (ref_id, name).

    A hit's contig is its query without the number that gene calling puts before it.
    """
    good = hits.above_cutoff(found, hits.cutoff_table(found.sparkSession))
    best = hits.best_hits(good.select("name", "cog", "bitscore", F.col("query")))
    return text.with_ordinals(best.withColumnRenamed("query", "contig"), contigs).select("ref_id", "cog")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Marker groups of contigs from a table of hits")
    parser.add_argument("--hits", required=True, help="tab-separated name, query, cog, bit score")
    parser.add_argument("--contigs", required=True, help="space-separated number, name, length")
    parser.add_argument("--outdir", required=True)
    args = parser.parse_args(argv)
    spark = session()
    rows = marker_rows(text.read_delimited(spark, args.hits, HITS, "\t"), text.read_delimited(spark, args.contigs, text.SELECTED))
    sinks.write_table(rows, f"{args.outdir}/marker_hits", "\t")


if __name__ == "__main__":
    main()
