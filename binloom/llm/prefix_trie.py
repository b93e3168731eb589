"""The trie of shared conversation prefixes by partition refinement.

Conversations of equal turns are first merged into one weighted sequence, so that copies cost nothing later.  All
sequences start as one class; a round splits each active class by its members' next turn.  A class of one sequence
retires: its tail is emitted at once as a unary chain.  A class with few turns left is finished by one task in the
same way.  The others go into the next round.  Then the rounds are folded back, from the last to the root, so that
every node has the leaves and savings of its subtree.  Turns travel as a hash and a count of words, never as texts.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import WORD, cut, running_total, text_or_empty
from binloom.storage import cut_round

#: Turns left in a class that one task finishes at most.
LOCAL_TURNS = 4096
#: The first turns of the conversation with the next lower multiple of HOSTED that a conversation may begin with.
HOSTED, MOST_SHARED = 20, 3
#: Turns of one conversation that a running total goes over at once, and ids that are joined to one string.
SEGMENT_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, key, words of every turn of a conversation, by turn, null first, and then by content."""
    role = text_or_empty("role")
    key = F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_or_empty()), "UTF-8"), 256), 1, 32)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
    )
    stretch = F.coalesce(F.shiftright("turn", SEGMENT_BITS), F.lit(-(2**60)))
    placed = running_total(rows.withColumn("segment", stretch), ["conv_id"], "segment", [F.col("turn").asc_nulls_first(), F.col("key")], {"pos": "one"})
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "key", "words")


def own_share(conv: Column) -> Column:
    """How many turns a conversation takes from its host."""
    return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % (MOST_SHARED + 1)


def hosted(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt: the first turns of the host's, as many as ``own_share`` says, then the own ones after as many."""
    host = F.col("conv_id") - F.col("conv_id") % HOSTED
    heads = cut(turns.filter((F.col("pos") < MOST_SHARED) & (F.col("conv_id") == host)))
    ids = turns.select("conv_id").distinct().select("conv_id", host.alias("host"), own_share(F.col("conv_id")).alias("h")).filter("h > 0")
    lent = ids.join(heads.withColumnRenamed("conv_id", "host"), "host").filter("pos < h").select("conv_id", "pos", "key", "words")
    has = heads.groupBy(F.col("conv_id").alias("host")).agg(F.count(F.lit(1)).alias("has"))
    kept = turns.withColumns({"host": host, "h": own_share(F.col("conv_id"))}).filter("pos >= h").join(has, "host", "left")
    own = kept.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("has", F.lit(0)))).alias("pos"), "key", "words")
    return lent.unionByName(own)


def hashed_ends(members: DataFrame) -> DataFrame:
    """len, f, g, n, conv, ends: each distinct sequence of ``members`` (conv_id, len, f, g) with its least id and the hash of all its ids.

    Ids are joined to strings by ranges, where they lie; a task then reads the strings of a sequence in order, one at a
    time, so a sequence may have any number of copies.
    """
    same = ["len", "f", "g"]
    chunks = members.groupBy(*same, F.shiftright("conv_id", SEGMENT_BITS).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")
    )

    def stream(batches):
        held, digest, total, least = None, None, 0, None
        for batch in batches:
            out = []
            for *key, _, ids, n, conv in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                if key != held:
                    if held is not None:
                        out.append((*held, total, least, digest.hexdigest()))
                    held, digest, total, least = key, hashlib.sha256(ids.encode()), n, conv
                else:
                    digest.update(b"," + ids.encode())
                    total += n
            yield _as_batch(out)
        if held is not None:
            yield _as_batch([(*held, total, least, digest.hexdigest())])

    def _as_batch(rows):
        kinds = [pa.int64()] * 5 + [pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["len", "f", "g", "n", "conv", "ends"])

    return chunks.repartition(*same).sortWithinPartitions(*same, "range").mapInArrow(stream, "len long, f long, g long, n long, conv long, ends string")


def merged(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """``hashed_ends`` of ``sequences`` (conv_id, pos, key) and of ``ids`` without any turn."""
    shape = [F.count(F.lit(1)).alias("len"), F.bit_xor(F.xxhash64("pos", "key", F.lit(1))).alias("f"), F.bit_xor(F.xxhash64("pos", "key", F.lit(2))).alias("g")]
    found = ids.join(sequences.groupBy("conv_id").agg(*shape), "conv_id", "left").na.fill(0, ["len", "f", "g"])
    return hashed_ends(found)


def finish(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one class from its top on: rows class, parent, top, top_words, top_ends, and conv, pos, key, words, n, ends of its members' turns after it.

    ``top`` is the class's depth and ``whole`` the conversations in it.
    """
    first = rows.iloc[0]
    turns: dict[int, list] = {}
    for conv, _, key, words, n, ends in rows.sort_values(["conv", "pos"])[["conv", "pos", "key", "words", "n", "ends"]].itertuples(index=False):
        turns.setdefault(conv, []).append((key, words, n, ends))
    # conv_id, depth, parent, n_convs, children, leaves, saved, ends, place of the parent
    nodes = [[first["class"], first["top"], first["parent"], first["whole"], 0, 0, (first["whole"] - 1) * first["top_words"], first["top_ends"], -1]]
    active = [(0, list(turns))]
    at = 0
    while active:
        split = []
        for place, members in active:
            by_turn: dict[str, list] = {}
            for conv in members:
                if at < len(turns[conv]):
                    by_turn.setdefault(turns[conv][at][0], []).append(conv)
            for key, convs in by_turn.items():
                depth, parent = first["top"] + at + 1, nodes[place][0]
                if len(convs) > 1:
                    n = sum(turns[c][at][2] for c in convs)
                    ends = next((turns[c][at][3] for c in convs if isinstance(turns[c][at][3], str)), None)
                    nodes.append([min(convs), depth, parent, n, 0, 0, (n - 1) * turns[convs[0]][at][1], ends, place])
                    split.append((len(nodes) - 1, convs))
                    continue
                above = place
                for key, words, n, ends in turns[convs[0]][at:]:
                    nodes.append([convs[0], depth, parent, n, 0, 0, (n - 1) * words, ends, above])
                    above, depth, parent = len(nodes) - 1, depth + 1, convs[0]
        active, at = split, at + 1
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[8] >= 0:
            up = nodes[node[8]]
            up[4], up[5], up[6] = up[4] + 1, up[5] + node[5], up[6] + node[6]
    out = pd.DataFrame([node[:8] for node in nodes], columns=NODE.replace(" long", "").replace(" string", "").split(", "))
    out["ends_sha256"] = out["ends_sha256"].where(out["ends_sha256"].notna(), NO_ENDS)
    return out


def tails(rows: DataFrame) -> DataFrame:
    """The unary chains of retired sequences: ``rows`` has conv, pos, words, n, ends, parent and top, the depth of the chain's first node."""
    saved = rows.withColumn("saved", (F.col("n") - 1) * F.col("words")).withColumn("segment", -F.shiftright("pos", SEGMENT_BITS))
    summed = running_total(saved, ["conv"], "segment", [F.col("pos").desc()], {"below": "saved"})
    last = F.col("pos") == F.col("len") - 1
    return summed.select(
        F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") + 1 == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        (F.col("saved") + F.col("below")).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def split(active: DataFrame, depth: int) -> DataFrame:
    """``active`` with class replaced by the class of the turns up to position ``depth``, and what that class is like.

    Adds parent, whole (conversations), members (sequences), left (turns after it), top_words and top_ends.
    """
    here = active.filter(F.col("pos") == depth)
    parts = here.groupBy("class", "key").agg(
        F.min("conv").alias("_node"), F.sum("n").alias("whole"), F.count(F.lit(1)).alias("members"), F.sum(F.col("len") - depth - 1).alias("left"),
        F.min("words").alias("top_words"), F.max("ends").alias("top_ends"),
    )
    named = here.select("class", "key", F.col("conv").alias("_conv")).join(parts, ["class", "key"]).drop("key").withColumnRenamed("class", "parent")
    bare = active.drop("class", "parent", "whole", "members", "left", "top_words", "top_ends", "top")
    return bare.join(named, bare["conv"] == named["_conv"]).drop("_conv").withColumnRenamed("_node", "class").withColumn("top", F.lit(depth + 1).cast("long"))


def folded(tops: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of ``tops`` (conv_id, depth, parent_conv_id, n_convs, own, ends_sha256) with the sums over their children in ``below``."""
    sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    joined = tops.join(sums, "conv_id", "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("c", F.lit(0)).cast("long").alias("n_children"), F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("own") + F.coalesce("s", F.lit(0))).cast("long").alias("saved_tokens"), "ends_sha256",
    )


def trie(sequences: DataFrame, ids: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv_id, pos from 0, key, words) and of ``ids`` (conv_id), which may have no turn.

    A node is named by its least member and its depth.  Without any id there is no node, not even a root.
    """
    distinct = cut(merged(sequences, ids))
    whole = distinct.agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(F.when(F.col("len") == 0, F.col("ends"))).alias("ends")).first()
    if whole["n"] is None:
        return sequences.sparkSession.createDataFrame([], NODE)
    reps = distinct.filter("len > 0").select("conv", "n", "len", "ends")
    rows = sequences.withColumnRenamed("conv_id", "conv").join(reps, "conv")
    active = cut(rows.withColumn("ends", F.when(F.col("pos") == F.col("len") - 1, F.col("ends"))).withColumn("class", F.lit(whole["conv"])))
    root = sequences.sparkSession.createDataFrame([(whole["conv"], 0, None, whole["n"], 0, whole["ends"] or NO_ENDS)], "conv_id long, depth long, parent_conv_id long, n_convs long, own long, ends_sha256 string")
    done, rounds, depth = [], [root], 0
    while not active.isEmpty():
        parted = cut(split(active, depth))
        single, local = F.col("members") == 1, F.col("left") <= local_turns
        done.append(tails(parted.filter(single & (F.col("pos") >= depth))))
        small = parted.filter(~single & local)
        # a class whose members all end at its top has but one sequence, so each has turns after it
        done.append(small.filter(F.col("pos") > depth).groupBy("class").applyInPandas(finish, NODE))
        large = parted.filter(~single & ~local)
        tops = large.filter(F.col("pos") == depth).groupBy("class").agg(*[F.first(c).alias(c) for c in ("parent", "whole", "top_words", "top_ends")])
        rounds.append(tops.select(
            F.col("class").alias("conv_id"), F.lit(depth + 1).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("whole").alias("n_convs"),
            ((F.col("whole") - 1) * F.col("top_words")).alias("own"), F.coalesce("top_ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        ))
        active, depth = cut_round(large.filter(F.col("pos") > depth)), depth + 1
    finished = cut(reduce(DataFrame.unionByName, done)) if done else sequences.sparkSession.createDataFrame([], NODE)
    out = [finished]
    below = finished.filter(F.col("depth") == len(rounds))
    for d in range(len(rounds) - 1, -1, -1):
        level = cut_round(folded(rounds[d], below)) if d else folded(rounds[d], below)
        out.append(level)
        below = level.unionByName(finished.filter(F.col("depth") == d))
    return reduce(DataFrame.unionByName, out)


def conversation_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes of the trie of rebuilt ``conversations`` (conv_id, turn, role and text are read).

    Turns go by turn, null first, those of one turn by a hash of role and text; a null role or text is empty.  Turns
    without conv_id belong to no conversation and give no node.  Rows that repeat are turns of their own.  Texts are
    compared whole, by 128 bits of SHA-256; an empty table gives no rows.
    """
    turns = cut(ordered_turns(conversations))
    return trie(cut(hosted(turns)), turns.select("conv_id").distinct(), local_turns)
