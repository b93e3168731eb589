"""I-Match fingerprints over randomised lexicons (DataFrame functions only).

The lexicon holds the terms whose document frequency lies in a band of inverse document frequency.  Chains of
nested random subsets of it, every one half of the one before, are the families' lexicons, the same for all
documents; a document's slot for a family is the hash of all its terms, sorted, in the family's lexicon, or of
all its terms in the band where that lexicon holds none of them.  Documents agree in a slot when these terms are
the same, so a family has nothing to say about the many terms it left out.

The next document is found without a global window: ids are cut into ranges at quantiles, texts move once
to their range, and the first row of each range is also sent to the range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm._common import cut, join_small, text_or_empty

#: Terms are runs of letters and digits in lower case.
TERM = r"[\p{L}\p{N}]+"
#: The band: shares of the documents that a term of the lexicon occurs in, at least and at most.  The lexicon has no more
#: than (mean distinct terms of a document / LEAST_SHARE) terms, whatever the number of documents.
LEAST_SHARE, MOST_SHARE = 1 / 2000, 1 / 20
FAMILIES = 16
#: Rows of a range of ids, until there are MOST_RANGES of them.
RANGE_ROWS, MOST_RANGES = 4096, 16384
#: Lexicons of a chain: the first holds half of the terms, each of the others half of the one before.
LEVELS = 8
#: Chains that the bits of one 64-bit hash serve.
_CHAINS = 64 // LEVELS


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t)))


def lexicon(texts: DataFrame, count: int, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """term: hashes of the terms of column _text whose share of the ``count`` documents lies in the band."""
    found = texts.select(F.explode(terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return found.filter((F.col("n") >= least * count) & (F.col("n") <= most * count)).select("term")


def slots(band: Column, fallback: Column, families: int = FAMILIES) -> Column:
    """One long for each family, from the sorted terms ``band``; all of them ``fallback`` where it holds none."""

    def within(family: int) -> Column:
        chain, level = family // LEVELS, family % LEVELS + 1
        mask = F.lit((1 << level) - 1)  # each level halves the lexicon

        def listed(term: Column) -> Column:
            bits = term if chain < _CHAINS else F.xxhash64(term, F.lit(chain // _CHAINS))
            return F.shiftrightunsigned(bits, chain % _CHAINS * LEVELS).bitwiseAND(mask) == 0

        return F.filter(band, listed)

    each = F.transform(F.array(*map(within, range(families))), lambda kept: F.xxhash64(F.when(F.size(kept) > 0, kept).otherwise(band)))
    return F.when(F.size(band) > 0, each).otherwise(F.array_repeat(fallback, families))


def written(slots_: Column) -> Column:
    """The fingerprint as text: 8 hexadecimal digits for each slot."""
    return F.array_join(F.transform(slots_, lambda s: F.lpad(F.lower(F.hex(F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(one: Column, two: Column, families: int = FAMILIES) -> Column:
    """Share of the families in whose slot two fingerprints agree."""
    return F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda same: same)) / F.lit(float(families))


def ranged(docs: DataFrame, count: int, nulls: int) -> DataFrame:
    """Rows of doc_id, _text and th dealt to ranges: adds bucket and extra, 1 for a copy of the next range's first row.

    Ranges follow one another by falling number, and the last is followed by the first.  ``count`` rows have an id and
    are cut at quantiles of it; the ``nulls`` others come after them, cut by th, the hash of the text.
    """
    ranges = min(MOST_RANGES, max(1, -(-count // RANGE_ROWS)))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges)).alias("q")).first()["q"] or []))
    if cuts:
        bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
        steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
        found = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0),
            lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(bounds, at + step) <= F.col("doc_id")), at + step).otherwise(at),
        )
    else:
        found = F.lit(0)
    bits = (min(MOST_RANGES, -(-nulls // RANGE_ROWS)) - 1).bit_length() if nulls else 0
    part = F.shiftrightunsigned(F.col("th").bitwiseXOR(F.lit(-(2**63))), 64 - bits) if bits else F.lit(0)
    dealt = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), part.cast("int") - (1 << bits)).otherwise(found))
    firsts = {r["bucket"]: r["f"] for r in dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "th")).alias("f")).collect()}  # a row for each range
    order = sorted(firsts, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    pairs = dealt.sparkSession.createDataFrame([(b, firsts[b]["doc_id"], firsts[b]["th"], before[b]) for b in order], "bucket int, first long, first_th long, before int")
    marked = dealt.join(F.broadcast(pairs), "bucket")  # at most twice MOST_RANGES rows
    is_first = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("th") == F.col("first_th"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra"))
    places = F.when(is_first, F.array(own, copy)).otherwise(F.array(own))
    return marked.select("doc_id", "_text", "th", F.explode(places).alias("place")).select("doc_id", "_text", "th", "place.bucket", "place.extra")


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, families: int = FAMILIES) -> DataFrame:
    """Rows doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``.

    Reads doc_id and text.  The edited text has its last third of code points replaced by as many first
    ones (or all) of the next document by falling doc_id; after the last comes the first.  Equal ids go by
    falling 64-bit hash of the text, null ids come last.  A null text is empty.  A text none of whose terms is in the lexicon
    is known by all its distinct terms, or, without any term, by itself; so equal texts have equal
    fingerprints.  A single document is next to itself.  An empty table gives no rows.
    """
    texts = docs.select("doc_id", text_or_empty().alias("_text")).withColumn("th", F.xxhash64("_text"))
    known, nulls = texts.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    words = cut(lexicon(texts, known + nulls, least, most))
    place = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("th").desc(), F.col("_text").desc())
    rows = ranged(texts, known, nulls).withColumn("following", F.lead("_text").over(place)).withColumn("pos", F.row_number().over(place))
    size = F.length("_text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), size - third), F.substring(F.coalesce("following", F.lit("")), F.lit(1), third))
    rows = rows.select("bucket", "pos", "extra", "doc_id", size.cast("long").alias("n_chars"), "_text", "th", edited.alias("edited"))
    rows = rows.select(
        "bucket", "pos", "extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.col("th").alias("own_raw"), F.xxhash64("edited").alias("edited_raw"),
        terms(F.col("_text")).alias("own"), terms(F.col("edited")).alias("new"),
    )
    keys = ["bucket", "pos", "extra", "doc_id", "n_chars", "edited_sha256", "own_all", "edited_all"]
    whole = [F.when(F.size(c) > 0, F.xxhash64(F.sort_array(c))).otherwise(F.col(raw)).alias(n) for c, raw, n in (("own", "own_raw", "own_all"), ("new", "edited_raw", "edited_all"))]
    both = F.concat(F.transform("own", lambda t: F.struct(t.alias("term"), F.lit(0).alias("kind"))), F.transform("new", lambda t: F.struct(t.alias("term"), F.lit(1).alias("kind"))))
    rows = rows.select(*keys[:6], *whole, both.alias("both")).select(*keys, F.explode_outer("both").alias("t")).select(*keys, "t.term", "t.kind")
    known = join_small(rows, words.withColumn("listed", F.lit(True)), ["term"], "left", most_rows=1_000_000)
    banded = known.groupBy("bucket", "pos").agg(
        *[F.first(k).alias(k) for k in keys[2:]],
        *[F.sort_array(F.collect_list(F.when((F.col("kind") == k) & F.col("listed"), F.col("term")))).alias(n) for k, n in enumerate(("own", "new"))],
    )
    made = banded.select("bucket", "pos", "extra", "doc_id", "n_chars", "edited_sha256", slots(F.col("own"), F.col("own_all"), families).alias("a"), slots(F.col("new"), F.col("edited_all"), families).alias("b"))
    following = made.withColumn("c", F.lead("a").over(Window.partitionBy("bucket").orderBy("pos"))).filter("extra = 0")
    return following.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("a")).alias("fingerprint"), written(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), families).alias("near_edited"), likeness(F.col("a"), F.coalesce("c", "a"), families).alias("near_next"),
    )
