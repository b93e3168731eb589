"""The leader rule in an ordered sweep: distances are measured from leaders only.

Contigs are visited by falling total, then falling id.  Each step takes the fullest contigs that no leader has taken
yet, decides that block in the driver from its own small matrix, ships the block's leaders to all contigs, and keeps
the pairs that are near enough to matter.  Work is leaders times contigs, as in the sequential rule; what is kept is
the leaders' neighbours, which are part of the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.operators.clustering import LEADER_DISTANCE
from binloom.operators.distance import Q, combined_tile, own_of
from binloom.operators.graph import TASK_ROWS
from binloom.storage import cut, cut_counted

#: Contigs that a step decides at most; the driver holds their profiles.
BLOCK = 256


def decided(d: np.ndarray, d0: float) -> list[str]:
    """What each contig of a block is, from distances within it, in order: leader, taken, or unsure.

    One is unsure that takes nothing in the block: it leads if it takes something outside.  No other answer within
    the block hangs on that, as it takes nothing here.
    """
    best, taken = np.full(len(d), d0), np.zeros(len(d), dtype=bool)
    found = []
    for c in range(len(d)):
        takes = d[c] < best
        if taken[c]:
            found.append("taken")
        elif takes.any():
            best[takes], taken[takes] = d[c][takes], True
            if d[c, c] > d0:
                best[c], taken[c] = d[c, c], True
            found.append("leader")
        else:
            found.append("unsure")
    return found


def met(profiles: DataFrame, block: pd.DataFrame, alpha: np.ndarray, kmer_alpha: np.ndarray | None, d0: float, q: float, digits: int | None) -> DataFrame:
    """a, b, d, ta, at, self_b: contigs b nearer than d0 to a contig a of ``block``, or nearer than to themselves where b is visited first.

    ``at`` is the place of a in the block.
    """
    kind = profiles.schema["contig"].dataType.simpleString()
    ids, totals = block["contig"].tolist(), block["total"].to_numpy(float)
    x = np.stack(block["profile"]).astype(float)
    k = np.stack(block["kmer"]).astype(float) if kmer_alpha is not None else None
    order = list(zip(totals.tolist(), ids, strict=True))

    def run(batches):
        for part in batches:
            if part.empty:
                continue
            y = np.stack(part["profile"]).astype(float)
            ky = np.stack(part["kmer"]).astype(float) if k is not None else None
            d = combined_tile(x, y, alpha, k, ky, kmer_alpha, q, digits)
            own = own_of(y, alpha, ky, kmer_alpha, q, digits)
            names, full = part["contig"].to_numpy(), part["total"].to_numpy(float)
            near = d < d0
            for j in np.flatnonzero(own > d0):
                first = np.array([(full[j], names[j]) > o for o in order])
                near[:, j] |= first & (d[:, j] < own[j])
            i, j = np.nonzero(near)
            a, b = (pd.Series(v, dtype=object) for v in ([ids[p] for p in i], names[j]))
            yield pd.DataFrame({"a": a, "b": b, "d": d[i, j], "ta": totals[i], "at": i, "self_b": own[j]})

    columns = ["contig", "total", "profile", *(["kmer"] if k is not None else [])]
    return profiles.select(*columns).mapInPandas(run, f"a {kind}, b {kind}, d double, ta double, at int, self_b double")


def settled(found: DataFrame, count: int, state: DataFrame, block: pd.DataFrame, d0: float) -> list[str]:
    """The block's answers with unsure ones decided, as far as the first that another unsure one before it can change.

    ``found`` has ``count`` rows, ``state`` has contig, state and bound.  The first unsure one is always decided.
    """
    answers = block["answer"].tolist()
    unsure = [i for i, a in enumerate(answers) if a == "unsure"]
    spark = found.sparkSession
    kind = found.schema["b"].dataType.simpleString()
    places = spark.createDataFrame([(c, i, a) for i, (c, a) in enumerate(zip(block["contig"].tolist(), answers, strict=True)) if a != "taken"], f"b {kind}, pb int, block_state string")
    wanted = found.filter(F.col("at").isin(unsure)).select("b").distinct()
    # by number, so that tasks, which order a contig's rows, do not grow with the table
    tasks = max(1, -(-count // TASK_ROWS))
    dealt, asked, known = (side.repartition(tasks, "b") for side in (found, wanted, state.select(F.col("contig").alias("b"), "state", "bound")))
    rows = dealt.join(asked, "b", "left_semi").join(known, "b").join(F.broadcast(places), "b", "left")
    before = Window.partitionBy("b").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    far, doubtful = F.lit(float("inf")), F.col("at").isin(unsure)
    led = F.coalesce(F.min(F.when(~doubtful, F.col("d"))).over(before), far)
    may = F.coalesce(F.min(F.when(doubtful, F.col("d"))).over(before), far)
    wide = (F.col("self_b") > d0) & (F.col("pb") < F.col("at"))
    sure_limit = F.when(wide & (F.col("block_state") == "leader"), F.col("self_b")).otherwise(F.col("bound"))
    open_limit = F.when(wide, F.col("self_b")).otherwise(F.col("bound"))
    flags = rows.select("at", (F.col("d") < F.least(sure_limit, led, may)).alias("sure"), (F.col("d") < F.least(open_limit, led)).alias("possible")).filter(doubtful)
    got = {r["at"]: r for r in flags.groupBy("at").agg(F.max("sure").alias("sure"), F.max("possible").alias("possible")).collect()}
    for i in unsure:
        r = got.get(i)
        if r is None or not r["possible"]:
            answers[i] = "left"
        elif r["sure"]:
            answers[i] = "leader"
        else:
            return answers[:i]
    return answers


def lead(
    profiles: DataFrame, alpha: list[float], kmer_alpha: list[float] | None = None, d0: float = LEADER_DISTANCE, q: float = Q, digits: int | None = None, block_rows: int = BLOCK
) -> DataFrame:
    """(contig, leader, owned) of ``profiles`` (contig, total, profile and, for both kinds of evidence, kmer).

    The rule is that of ``clustering.leaders``: rows with owned give each contig's cluster, the others name every
    leader within d0.  ``digits`` rounds distances, so that near ties are ties.  Contigs must be distinct and not
    null; without any there are no rows.
    """
    a, k = np.array(alpha, dtype=float), np.array(kmer_alpha, dtype=float) if kmer_alpha else None
    profiles = cut(profiles.withColumn("total", F.col("total").cast("double")))
    kind = profiles.schema["contig"].dataType.simpleString()
    state = cut(profiles.select("contig", "total", F.lit("open").alias("state"), F.lit(float(d0)).alias("bound"), F.lit(None).cast("double").alias("self")))
    kept: list[DataFrame] = []
    while True:
        head = state.filter("state = 'open'").orderBy(F.col("total").desc(), F.col("contig").desc()).limit(block_rows).select("contig")
        block = profiles.join(F.broadcast(head), "contig", "left_semi").toPandas()
        if block.empty:
            break
        block = block.sort_values(["total", "contig"], ascending=False, ignore_index=True)
        x = np.stack(block["profile"]).astype(float)
        kx = np.stack(block["kmer"]).astype(float) if k is not None else None
        d = combined_tile(x, x, a, kx, kx, k, q, digits)
        block["answer"], block["self"] = decided(d, d0), np.diag(d)
        sent = block[block["answer"] != "taken"].reset_index(drop=True)
        found, count = cut_counted(met(profiles, sent, a, k, d0, q, digits))
        answers = sent["answer"].tolist()
        if "unsure" in answers:
            answers = settled(found, count, state, sent, d0)
        chosen = [i for i, s in enumerate(answers) if s == "leader"]
        told = zip(sent["contig"].tolist(), answers, sent["self"].tolist(), strict=False)
        new = profiles.sparkSession.createDataFrame(list(told), f"contig {kind}, new string, new_self double")
        pairs = found.filter(F.col("at").isin(chosen)) if chosen else found.limit(0)
        kept.append(pairs)
        nearest = pairs.groupBy(F.col("b").alias("contig")).agg(F.min(F.when(F.col("d") < d0, F.col("d"))).alias("near"), F.min("d").alias("any"))
        joined = state.join(F.broadcast(new), "contig", "left").join(nearest, "contig", "left")
        leads = (F.col("state") == "leader") | (F.coalesce("new", F.lit("")) == "leader")
        own = F.when(F.col("new") == "leader", F.when(F.col("new_self") > d0, F.col("new_self")).otherwise(F.lit(float(d0)))).otherwise(F.col("bound"))
        state = cut(joined.select(
            "contig", "total",
            F.when(leads, "leader").when(F.col("new") == "left", "left").when((F.col("state") == "open") & F.col("near").isNotNull(), "taken").otherwise(F.col("state")).alias("state"),
            F.when(leads, F.least(own, F.coalesce("any", own))).otherwise(F.least("bound", F.coalesce("near", F.col("bound")))).alias("bound"),
            F.coalesce("self", F.when(F.col("new") == "leader", F.col("new_self"))).alias("self"),
        ))
    if not kept:
        return profiles.select("contig", F.col("contig").alias("leader"), F.lit(True).alias("owned"))
    pairs = reduce(DataFrame.unionByName, kept)
    wide = state.filter((F.col("state") == "leader") & (F.col("self") > d0))
    far = pairs.filter(F.col("d") >= d0).join(wide.select(F.col("contig").alias("b")), "b", "left_semi")
    near = pairs.filter(F.col("d") < d0)
    takes = near.unionByName(far).select("a", "b", "d", "ta").unionByName(wide.select(F.col("contig").alias("a"), F.col("contig").alias("b"), F.col("self").alias("d"), F.col("total").alias("ta")))
    # the first of those that are nearest
    owners = takes.groupBy(F.col("b").alias("contig")).agg(F.max_by("a", F.struct(-F.col("d"), F.col("ta"), F.col("a"))).alias("leader"))
    everyone = cut(state.select("contig").join(owners, "contig", "left"))
    owned = everyone.select("contig", F.coalesce("leader", "contig").alias("leader"), F.lit(True).alias("owned"))
    alone = everyone.filter("leader IS NULL").select("contig", F.col("contig").alias("leader"), F.lit(False).alias("owned"))
    return owned.union(alone).union(near.select(F.col("b").alias("contig"), F.col("a").alias("leader"), F.lit(False).alias("owned")))
