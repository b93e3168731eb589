"""A training corpus from raw documents: quality, exact copies, near copies, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but
the last return rows with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binloom.llm import quality
from binloom.llm._common import cut, table
from binloom.llm.exact_dedup import exact_dedup
from binloom.llm.mixing import mixture
from binloom.llm.near_dup import near_duplicates
from binloom.llm.packing import pack

TOP_GRADE = 2
#: Toxic documents go: the grade asked for is then the top one, as toxic texts are of the middle grade.
DROP_TOXIC = True


def _keeping(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id, null or not, is in ``kept``."""
    ids = kept.filter("kept").selectExpr("doc_id AS _id").distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, drop_toxic: bool = DROP_TOXIC) -> DataFrame:
    """Documents that are good with probability one half at least, with all their columns; without ``drop_toxic`` also fair but toxic ones.

    The model is that of the query op1_cumulative_link.  A null, empty or blank text has nothing to judge and goes.  Rows that
    repeat are judged alike; a null doc_id is as good as another.  Without ratings of these documents all others stay; no rows give none.
    """
    model = quality.fit(docs, quality.document_grades(table(spark, sf_dir, "labels")), TOP_GRADE, marking=True)
    return quality.accepted(docs, model, TOP_GRADE, TOP_GRADE if drop_toxic else quality.LEAST_GRADE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of largest doc_id, with all its columns.

    Null texts equal empty ones.  Rows that repeat a doc_id and its text are one, and any of them stays.  A null
    doc_id stays only where its group has no other; no rows give none.
    """
    kept = _keeping(docs, exact_dedup(docs))
    repeated = docs.groupBy("doc_id").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component of near duplicates, with all its columns.

    Empty texts link with nothing and stay, as do rows without doc_id.  Rows that share a doc_id stay or go
    together; no rows give none.
    """
    return _keeping(docs, near_duplicates(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, the last of each source cut where it ends.

    A null source is a source of its own, last in order.  Empty texts are never taken; rows that share a doc_id
    are told apart by source and text, and of rows that repeat all three any stands for the others.  Rows come in the
    order of the schedule, so reruns agree; no rows give none.
    """
    return mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in their places in sequences of 2048 tokens.

    A null or empty text is one piece, its end.  Rows that repeat are packed each for itself, and which of two
    like pieces takes which place is settled by a hash of their ids; no rows give none.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", by_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Word hashes, the classifier and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
