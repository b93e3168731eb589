"""The pipeline against brute force, stage by stage on what the stage before it kept."""

import collections
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_documents import WORD, shingles
from tests.sqlcheck import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds, kept, tables = docs.dtypes, [docs.collect()], [docs]
    for _, stage in pipeline.STAGES:
        tables.append(pipeline.cut(stage(spark, tables[-1], DATA)))
        kept.append(tables[-1].collect())
    assert [t.dtypes for t in tables[1:5]] == [kinds] * 4
    raw, good, exact, near, mix, packed = kept

    table = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    labels, clean = {r["doc_id"]: r["quality"] for r in table}, [r["doc_id"] for r in table if r["quality"] == 1 and not r["toxic"]]
    left = {r["doc_id"] for r in good}
    assert all(i in left for i in clean)
    assert sum(i not in left for i, q in labels.items() if q == 0) >= 0.9 * sum(q == 0 for q in labels.values())

    largest = {}
    for r in good:
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(largest.values())

    sets = {r["doc_id"]: shingles(r["text"]) for r in exact}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r["doc_id"] for r in near) == sorted(i for i in sets if find(i) == i)

    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in near}
    text = {r["doc_id"]: r["text"] for r in near}
    taken = collections.Counter()
    for r in mix:
        n = len(WORD.findall(r["text"]))
        taken[r["doc_id"]] += n
        assert text[r["doc_id"]].startswith(r["text"]) and n > 0 and r["n_chars"] == len(r["text"])
    assert abs(sum(taken.values()) - sum(size.values())) < 300 and all(taken[i] <= 3 * size[i] for i in taken)

    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in mix)
    used = collections.Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_stages_on_odd_tables(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, "a b c d e f g", None, None, None), (1, None, None, "s", 0), (2, "x y", "en", "s", 3), (2, "x y", "en", "s", 3)], schema)
    for start, rows in ((empty, 0), (odd, 2)):
        docs = start
        for _, stage in pipeline.STAGES:
            docs = pipeline.cut(stage(spark, docs, DATA))
        assert docs.agg(F.count_distinct("sequence_id")).first()[0] <= rows
