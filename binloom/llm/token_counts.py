"""Token counts from an exact length histogram.

Documents are encoded once and counted by encoded length, first inside each batch.  Everything else is read
off the histogram, which has a row for each length that occurs: sums over all longer lengths give, for any
context limit, the documents and tokens that stay, are cut, and remain after truncation.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import cut, running_total, text_or_empty
from binloom.llm._tokens import ID_BYTES, default_path, encoder

#: Lengths that one running total goes over at once.
SEGMENT_LENGTHS = 1024


def _counted(path: str):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            found = Counter(len(ids) // ID_BYTES for ids in coder.all_ids(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["length", "n"])

    return run


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows length, docs: how many rows of ``docs`` (text is read) encode to so many tokens.

    ``path`` names the tokenizer file.  A null or empty text has length 0; repeated rows count again; an
    empty table has no rows.
    """
    counted = docs.select(text_or_empty().alias("_text")).mapInArrow(_counted(path or default_path()), "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("docs"))


def limit_curve(histogram: DataFrame) -> DataFrame:
    """One row for each length L that occurs, taken as a context limit.

    context_limit, docs (of exactly L), docs_longer, docs_at_most, tokens_at_most (in documents not longer
    than L), tokens_truncated (if all are cut to L) and share_at_most (L is the quantile of this share and
    of all lower ones above the row before).  Between two rows, counts stay and tokens_truncated grows by
    docs_longer a step, so the rows answer every limit.
    """
    histogram = cut(histogram)  # read three times below; the texts are encoded once
    rows = histogram.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.lit(0).alias("all"))
    rows = rows.withColumn("segment", -F.floor(F.col("length") / SEGMENT_LENGTHS))
    down = [F.col("length").desc()]
    longer = running_total(rows, ["all"], "segment", down, {"docs_longer": "docs", "tokens_longer": "tokens"})
    totals = histogram.agg(F.sum("docs").alias("_docs"), F.sum(F.col("length") * F.col("docs")).alias("_tokens")).withColumn("all", F.lit(0))
    joined = longer.join(F.broadcast(totals), "all")  # one row
    within = F.col("_tokens") - F.col("tokens_longer")
    return joined.select(
        F.col("length").alias("context_limit"), "docs", "docs_longer", (F.col("_docs") - F.col("docs_longer")).alias("docs_at_most"),
        within.alias("tokens_at_most"), (within + F.col("length") * F.col("docs_longer")).alias("tokens_truncated"),
        ((F.col("_docs") - F.col("docs_longer")) / F.col("_docs")).alias("share_at_most"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_at_most, tokens_at_most, tokens_truncated for any limits, in one pass."""
    spread = histogram.withColumn("context_limit", F.explode(F.array(*[F.lit(n).cast("long") for n in limits])))
    fits = F.col("length") <= F.col("context_limit")
    return spread.groupBy("context_limit").agg(
        F.sum(F.when(fits, F.col("docs")).otherwise(0)).alias("docs_at_most"),
        F.sum(F.when(fits, F.col("docs") * F.col("length")).otherwise(0)).alias("tokens_at_most"),
        F.sum(F.col("docs") * F.least("length", "context_limit")).alias("tokens_truncated"),
    )


def quantiles(curve: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that so large a share of the documents does not exceed."""
    spread = curve.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return spread.groupBy("share").agg(F.min(F.when(F.col("share_at_most") >= F.col("share"), F.col("context_limit"))).alias("length"))
