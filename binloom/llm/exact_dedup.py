"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Each text is cut where its own characters say so, chunks get short identifiers, and two documents are
equal when their ordered identifier lists are.  Before lists are compared every identifier is verified:
all chunks that bear it, wherever they are, must agree in their length and in two more hashes, which are
gathered by identifier; one that stands for two chunks makes the whole pass run again with the next seed.
Texts are read and cut into chunks once and never move; grouping and joining see identifier lists alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import cut, text_or_empty

#: A cut follows two letters or digits of these classes and then white space, or an ideographic full stop.
CUT = r"(?:[a-eA-Eio0-4à-ÿ][acegikmoqsuwyACEGIKMOQSUWY13579]\s|[。！？])"
MIN_CHARS, MAX_CHARS, MAX_SEEDS = 256, 4096, 8


def chunks(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """The chunks of a text, in order; joined they give the text again.  An empty text has none."""
    pattern = rf"(?s).{{{low - 3},{high - 3}}}?{CUT}|.{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def digest_id(chunk: Column, seed: int) -> Column:
    """128 bits of SHA-256 over the seed and the chunk."""
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), chunk), 256), 1, 32))


def witness(chunk: Column) -> Column:
    """What two different chunks do not share: 128 bits that have nothing to do with the identifier, and the length."""
    return F.struct(F.xxhash64(F.lit(1), chunk).alias("p"), F.xxhash64(F.lit(2), chunk).alias("q"), F.length(chunk).alias("size"))


def has_collision(listed: DataFrame) -> bool:
    """Whether an identifier of the recipes stands for two different chunks."""
    pairs = listed.select(F.explode(F.arrays_zip("recipe", "witnesses")).alias("c")).select(F.col("c.recipe").alias("id"), "c.witnesses.*")
    ends = [f(c).alias(f"{name}_{c}") for c in ("p", "q", "size") for name, f in (("least", F.min), ("most", F.max))]
    return not pairs.groupBy("id").agg(*ends).filter("least_p < most_p OR least_q < most_q OR least_size < most_size").isEmpty()


def exact_dedup(
    docs: DataFrame,
    identify: Callable[[Column, int], Column] = digest_id,
    low: int = MIN_CHARS,
    high: int = MAX_CHARS,
) -> DataFrame:
    """Rows doc_id, keep_id, group_size, kept, text_sha256, n_chunks, one for each row of ``docs``.

    Needs columns doc_id and text, others are ignored.  A null text counts as empty, and empty texts equal
    each other.  The largest doc_id of a group stays; a row that repeats a doc_id with its text is the same
    document and gets the same values.  A null doc_id never stays beside another; a group of null ids has
    keep_id null and kept true.  An empty table gives an empty result.
    """
    docs = docs.select("doc_id", text_or_empty().alias("_text"))
    for seed in range(MAX_SEEDS):
        cut_up = docs.select("doc_id", chunks(F.col("_text"), low, high).alias("chunks"), F.sha2("_text", 256).alias("text_sha256"))
        recipe = F.transform("chunks", lambda c: identify(c, seed))  # noqa: B023  called at once
        listed = cut(cut_up.select("doc_id", recipe.alias("recipe"), F.transform("chunks", witness).alias("witnesses"), "text_sha256"))
        if not has_collision(listed):
            break
    else:
        raise ValueError("chunk identifiers collide for every seed")
    listed = listed.drop("witnesses")
    # a table of its own, so that Spark can split the tasks of recipes that many rows share
    groups = cut(listed.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    joined = listed.join(groups, "recipe", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )
