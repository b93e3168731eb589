"""Sharding, the prefix trie and periodic runs against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.llm import periodic, prefix_trie, sharding

DOCS = "doc_id long, text string, shard string, slot string, runs string, h string"
TURNS = "conv_id long, turn long, role string, text string, pos string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(count=150, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        kind = rng.randrange(6)
        words = [rng.choice("abcde") + "x" * rng.randrange(2) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 90]))]
        if kind == 0:
            words = words[:9] * rng.randrange(2, 12) + words[:4]
        if kind == 1 and rows:
            rows.append((i, rng.choice(rows)[1]))
            continue
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(count, None), (None, ""), (None, "a b a b a b a b"), (7, "é é é é é é\u0085 x"), (7, "same id"), (count + 1, "w " * 5000), (count + 1, "w " * 5000)]
    return [(i, t, "a", None, "b", "c") for i, t in rows]


# ---- sharding


def minimax(sizes, k):
    """Least capacity over all contiguous partitions, by dynamic programming."""
    ends = [0, *itertools.accumulate(sizes)]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [0] + [min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(1, len(ends))]
    return best[-1]


def groups_of(rows):
    sizes = collections.Counter()
    for _, t, *_ in rows:
        raw = (t or "").encode()
        sizes[hashlib.sha256(raw).hexdigest()] += len(raw) + 1
    return dict(sorted(sizes.items()))


def expected_capacity(rows, k):
    sizes, alone = groups_of(rows), 0
    largest = 0
    while alone < k - 1 and sizes:
        h, s = max(sizes.items(), key=lambda e: e[1])
        if s <= sum(sizes.values()) / (k - alone):
            break
        largest = max(largest, sizes.pop(h))
        alone += 1
    return max(largest, minimax(list(sizes.values()), k - alone)) if sizes else largest


@pytest.mark.parametrize(("shards", "step", "seed"), [(8, 10, 3), (8, 2, 4), (3, 1, 5), (1, 10, 6), (8, 60, 7)])
def test_shards(spark, monkeypatch, shards, step, seed):
    monkeypatch.setattr(sharding, "STEP_BITS", step)
    rows = documents(seed=seed)
    got = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(5), shards).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    places, sums = collections.defaultdict(list), collections.Counter()
    for r in got:
        places[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert set(places) <= set(range(shards))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sums.values()) == expected_capacity(rows, shards)
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def test_a_large_group_leaves_the_other_shards_even(spark):
    rows = [(i, "copy " * 20, "", "", "", "") for i in range(500)] + [(1000 + i, f"text number {i} " * 5, "", "", "", "") for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = sorted(r.s for r in got)
    assert len(sizes) == 8 and sizes[-1] == 500 * 101
    assert sizes[-2] - sizes[0] < 600


def test_shards_of_nothing_and_files(spark, tmp_path):
    assert sharding.shard(spark.createDataFrame([], DOCS)).collect() == []
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).drop("shard")
    plan = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows)
    assert back.withColumn("s", F.octet_length(F.coalesce("text", F.lit(""))) + 1).groupBy("shard").agg(F.sum("s").alias("s")).agg(F.max("s")).first()[0] == plan.capacity


# ---- prefix trie


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], prefix_key(t[2], t[3])))] for c, v in convs.items()}
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - c % 20, [])[:h] + convs[c][h:])
    nodes = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = collections.Counter(t[:-1] for t in nodes if t)
    out = []
    for t, members in nodes.items():
        below = [u for u in nodes if u[: len(t)] == t]
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(t))
        out.append((
            min(members), len(t), min(nodes[t[:-1]]) if t else None, len(members), children[t], sum(not children[u] for u in below),
            sum((len(nodes[u]) - 1) * len(WORD.findall(u[-1][1])) for u in below if u), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def prefix_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def conversations(seed, convs=60, alphabet=2, most=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, t, None]) if seed % 2 else t, rng.choice(["user", "assistant", None]) if t > 2 else "user", "word " * rng.randrange(alphabet) or None, "p", "n"))
    return rows


@pytest.mark.parametrize(("seed", "local"), [(1, 4096), (2, 0), (3, 20), (4, 40), (5, 0)])
def test_trie(spark, seed, local):
    rows = conversations(seed) + [(None, 1, "user", "lost", "p", "n"), (6, 1, "user", "again", "p", "n"), (6, 1, "user", "again", "p", "n")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(4), local).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


@pytest.mark.parametrize("local", [0, 30, 4096])
def test_trie_of_copies_long_chains_and_turnless(spark, local):
    rows = [(c, t, "user", f"t{t}", "", "") for c in range(0, 400, 20) for t in range(4)]
    rows += [(c, t, "user", f"t{t}", "", "") for c in (1, 7, 900) for t in range(50 if c != 7 else 9)]
    rows += [(c, 0, "user", "only", "", "") for c in range(401, 440)]  # some keep nothing: their host is absent
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), local).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


def test_trie_of_many_ids_in_several_ranges_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT_BITS", 2)
    rows = [(c, t, "user", "same", "", "") for c in range(0, 300) for t in range(9)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", "")], TURNS)).collect() == []


# ---- periodic runs


def brute_runs(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = [rng.choice("ab" if seed % 2 else "abcd") for _ in range(rng.randrange(60))]
        if seed > 2 and words:
            words = words + words[: rng.randrange(1, 8)] * rng.randrange(9) + words
        assert periodic.find_runs(periodic.numbered(words)) == brute_runs(words)


def test_runs_where_hashes_or_blocks_are_small(monkeypatch):
    monkeypatch.setattr(periodic, "PRIME", 5)
    monkeypatch.setattr(periodic, "BASE", 2)
    monkeypatch.setattr(periodic, "PAIRS", 10)
    test_runs(1)
    test_runs(5)


def test_a_very_long_text():
    words = [f"w{i % 977}" for i in range(200_000)] + [f"v{i}" for i in range(50_000)]
    assert periodic.find_runs(periodic.numbered(words)) == [(0, 200_000, 977)]
    assert periodic.find_runs(np.zeros(100_000, dtype=np.int64)) == [(0, 100_000, 1)]


def edited(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_digests(spark):
    rows = documents(400)
    got = periodic.digests(periodic.periodic_runs(periodic.repeating(spark.createDataFrame(rows, DOCS).repartition(3)))).collect()
    wanted = []
    for i, t, *_ in rows:
        words = edited(i, WORD.findall(t or ""))
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        wanted.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(wanted, key=repr)
    assert any(w[1] for w in wanted) and len({w[0] for w in wanted if w[1]}) > 20
    assert periodic.digests(periodic.periodic_runs(spark.createDataFrame([], DOCS))).collect() == []
