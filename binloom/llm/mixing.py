"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

A source is taken in blocks of equal size, as many as its target needs; the last one ends where the target does.
The sources' blocks are laid out one after the other as cumulative weights over 2^m points.  The van der Corput
point of slot k is k with its m bits reversed; the slot belongs to the source whose weights hold that point, or to
none beyond the last, so that every stretch of the schedule gives each source nearly its share of slots, and the
whole gives it exactly its blocks.  A slot's rank among its source's slots is the number of the block it takes from
the source's documents in shuffled order; after the last document the order starts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm._common import WORD, cut, hash_segment, join_small, running_total, text_or_empty

WEIGHTS = (1, 2, 3)
#: No document is taken more often, and no target is larger than so many times its source.
MOST_PASSES = 3
#: Words of a slot; the last of each source may have fewer.
BLOCK_WORDS = 128
SEED = 20240607
#: Rows that one running total goes over at once.
SEGMENT_ROWS = 4096


def bits_reversed(value: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a non-negative long in reverse, by swaps of ever larger groups."""
    out = value
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        out = F.shiftleft(out.bitwiseAND(m), width).bitwiseOR(F.shiftrightunsigned(out, width).bitwiseAND(m))
    out = F.shiftleft(out, 32).bitwiseOR(F.shiftrightunsigned(out, 32))
    return F.shiftrightunsigned(out, 64 - bits) if bits else F.lit(0).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Adds weight and target to rows of source, source_size.

    Sources in the order of their code points, null last, get the weights in turn.  A target stops at
    ``most`` times its source's size; with sources by rising limit a weight unit, the level at which the
    rest fits is the largest that any stopping place would give.  One row a source, no documents.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("double")
    limit = (F.col("source_size") * most).cast("double")
    stops = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward, every = stops.rowsBetween(Window.unboundedPreceding, -1), stops.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    ranked = sources.withColumn("weight", weight).withColumn("limit", limit)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least("limit", F.col("level") * F.col("weight"))
    return levelled.withColumn("target", target).drop("limit", "level")


def blocked(plan: DataFrame, block_words: int) -> DataFrame:
    """Adds words (the target in whole words), blocks, and first (the blocks of the sources before it)."""
    along = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counted = plan.withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    return counted.withColumn("first", F.coalesce(F.sum("blocks").over(along), F.lit(0).cast("long")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a shuffling hash of id and text, computed once."""
    count = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key().alias("skey"), count.alias("size"), shuffled().alias("h")))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def shuffled() -> Column:
    """A row's place in the shuffled order: rows that share an id, or have none, are spread by their texts."""
    return F.xxhash64("doc_id", text_or_empty(), F.lit(SEED))


def schedule(plan: DataFrame, bits: int) -> DataFrame:
    """skey, slot, block: every slot that a source has, and the block of it that the slot takes."""
    spans = plan.filter("blocks > 0").select("skey", F.col("first").alias("lo"), (F.col("first") + F.col("blocks")).alias("hi"))
    parts = spans.select("skey", "hi", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(SEGMENT_ROWS).cast("long"))).alias("at"))
    points = parts.select("skey", F.explode(F.sequence("at", F.least(F.col("at") + SEGMENT_ROWS, F.col("hi")) - 1)).alias("point"))
    slot = points.select("skey", bits_reversed(F.col("point"), bits).alias("slot"), F.lit(1).cast("long").alias("one"))
    segmented = slot.withColumn("segment", (F.col("slot") / SEGMENT_ROWS).cast("long"))
    return running_total(segmented, ["skey"], "segment", ["slot"], {"block": "one"}).select("skey", "slot", "block")


def laid_out(documents: DataFrame, count: int) -> DataFrame:
    """Adds start, the words of the source's shuffled documents before this one; documents without words have no place."""
    segment = hash_segment("h", count)
    unsigned = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    return running_total(documents.filter("size > 0").withColumn("segment", segment), ["skey"], "segment", [unsigned, "doc_id", "size"], {"start": "size"})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as pieces of documents: doc_id, source, skey, h, size, source_size, target, start, pass, slot, taken.

    Every row of ``docs`` (doc_id, text and source are read) comes at least once.  A row with a slot says
    that the slot takes ``taken`` words of the document in that pass over its source; a row with a null slot
    and 0 words stands for the document itself.  start, with source, tells rows of one doc_id apart.
    Only slots that the schedule gives take words.  A source's words are its target, rounded.  A null text is empty, size 0, and never taken; a null source
    is a source of its own, last in order; a null doc_id is one more value.  Repeated rows are documents of
    their own; the order goes by a hash of id and text, then id, then size, so reruns agree whatever the
    order of the rows.  An empty table, or one without any word, takes nothing.
    """
    documents = sized(docs)
    sources = documents.groupBy("source", "skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    plan = cut(blocked(targets(sources, weights, most), block_words))
    count, blocks = plan.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    bits = max(0, (blocks - 1).bit_length())
    named = plan.select("skey", "source_size", "target", "words")
    placed = join_small(laid_out(documents, count), named, ["skey"])
    passes = placed.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(-1, most)])))
    passes = passes.withColumn("from", F.col("pass") * F.col("source_size") + F.col("start"))
    passes = passes.withColumn("to", F.least(F.col("from") + F.col("size"), "words")).filter("pass < 0 OR from < to")
    # block b has the words from b * block_words to the next block's of the order, repeated, as far as the target goes
    of_pass = F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))
    pieces = passes.withColumn("block", F.explode(F.when(F.col("pass") < 0, F.array(-1 - F.col("h").bitwiseAND(F.lit(2**40 - 1)))).otherwise(of_pass)))
    pieces = pieces.withColumn("taken", F.least("to", (F.col("block") + 1) * block_words) - F.greatest("from", F.col("block") * block_words))
    joined = pieces.join(schedule(plan, bits), ["skey", "block"], "left")
    own = F.col("pass") < 0
    out = joined.select(
        "doc_id", "source", "skey", "h", "size", "source_size", "target", "start", F.when(~own, F.col("pass")).alias("pass"), "slot",
        F.when(F.col("slot").isNull(), 0).otherwise(F.col("taken")).cast("long").alias("taken"),
    )
    none = F.lit(None)
    blank = join_small(documents.filter("size = 0"), named, ["skey"]).select(
        "doc_id", "source", "skey", "h", "size", "source_size", "target", none.cast("long").alias("start"), none.cast("int").alias("pass"),
        none.cast("long").alias("slot"), F.lit(0).cast("long").alias("taken"),
    )
    return out.unionByName(blank)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, slots: one row for each row of ``docs``; see ``mix``.

    ``slots`` slots of the schedule take words of the document, ``first_slot`` the earliest (null where none does).
    """
    pieces = mix(docs, **options)
    names = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "slots"]
    blank = pieces.filter("size = 0").withColumns({"first_slot": F.lit(None).cast("long"), "slots": F.lit(0).cast("long")}).select(*names)
    own = ["doc_id", "h", "source", "size", "source_size", "target", "start"]
    whole = pieces.filter("size > 0").groupBy(*own).agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("slots"))
    return whole.select(*names).unionByName(blank)


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, as it is written."""
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), count.cast("int")), "")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in the order of the schedule, with the columns of ``docs``: a row for each pass over a document.

    A row stands where the first slot that takes of it does: rows go by ranges of slots to partitions, in order within
    and between them, so files written from it hold the order.  Every stretch of it has the sources in about their
    shares.  A document that the last slot of its source takes in part is cut after its last word that is taken.
    n_chars, where there is such a column, counts the text as it is then.  Rows that share a doc_id are told
    apart by source and text; where rows repeat all three, any of them stands for the others.
    """
    taken = mix(docs, **options).filter("taken > 0").groupBy("doc_id", "h", "skey", "pass", "start").agg(
        F.sum("taken").cast("long").alias("_taken"), F.max("size").alias("_size"), F.min("slot").alias("_slot")
    )
    taken = cut(taken.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("skey").alias("_skey"), "pass", "_taken", "_size", "_slot"))
    own = docs.withColumns({"_own": shuffled(), "_source": source_key()})
    seen = taken.groupBy("_id", "_h", "_skey", "pass").agg(F.count(F.lit(1)).alias("n"), F.max("_slot").alias("slot")).agg(F.max("n").alias("n"), F.max("slot").alias("slot")).first()
    if (seen["n"] or 0) > 1:
        own = own.dropDuplicates(["doc_id", "_own", "_source"])
    joined = own.join(taken, (own["_own"] == taken["_h"]) & (own["_source"] == taken["_skey"]) & own["doc_id"].eqNullSafe(taken["_id"]))
    text = F.when(F.col("_taken") < F.col("_size"), first_words(F.col("text"), F.col("_taken"))).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = joined.repartitionById(parts, F.floor(F.col("_slot") * parts / ((seen["slot"] or 0) + 1)).cast("int"))
    return placed.sortWithinPartitions("_slot", "pass", "_h").select(*docs.columns)
