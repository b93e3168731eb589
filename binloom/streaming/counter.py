"""A streaming counter of fractional reads.

Records of a read come together or in several batches; its state keeps them, and each batch that has
records of a read emits the read's weights anew with a higher version, or a row without contig where none of it
counts.  Consumers take the last version, as ``latest`` does for what a foreachBatch sink has collected.  In streams
without end, a read that no record has come for since ``keep`` milliseconds leaves the state; its weights stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from binloom.operators.counts import folded

OUTPUT = "sample STRING, read_id STRING, contig STRING, weight DOUBLE, version INT"
STATE = "ord ARRAY<LONG>, contig ARRAY<STRING>, dir ARRAY<INT>, proper ARRAY<BOOLEAN>, identity ARRAY<DOUBLE>, version INT"


def fold(records: list[tuple]) -> list[list]:
    """[contig, dir, paired, identity, averaged] of records (ord, contig, dir, proper, identity), in order."""
    entries: dict[str, list] = {}
    for _, contig, direction, proper, value in sorted(records):
        if contig not in entries:
            entries[contig] = [contig, direction, proper, value, False]
            continue
        e = entries[contig]
        if direction != e[1]:
            mean = (e[3] + value) / 2
            if not e[4] or mean > e[3]:
                e[3] = mean
            e[2] = e[4] = True
        else:
            e[3] = max(e[3], value)
    return list(entries.values())


def weigh(entries: list[list], least_identity: float, discordant: float) -> list[tuple[str, float]]:
    best = max((e[3] for e in entries), default=0.0)
    if best < least_identity:
        return []
    kept = [e for e in entries if e[3] == best]
    n, p = len(kept), sum(e[2] for e in kept)
    return [(e[0], 1 / n + (n - p) / (2 * n) / p if e[2] else 1 / (2 * n) if p else discordant / n) for e in kept]


def _weighed(records: DataFrame, least_identity: float, discordant: float) -> DataFrame:
    """The weights of reads by a streaming aggregation; a read's version is the number of its records."""
    reads = records.groupBy("sample", "read_id").agg(F.array_sort(F.collect_list(F.struct("ord", "contig", "dir", "proper", "identity"))).alias("r"))
    names = F.array_distinct(F.transform("r", lambda x: x["contig"]))

    def entry(contig: Column) -> Column:
        e = folded(F.filter("r", lambda x: x["contig"] == contig))
        return F.struct(contig.alias("contig"), e["paired"].alias("paired"), e["identity"].alias("identity"))

    def best(acc: Column, e: Column) -> Column:
        higher, pair = e["identity"] > acc["identity"], e["paired"].cast("int")
        same = (e["identity"] == acc["identity"]).cast("int")
        n, p = F.when(higher, 1).otherwise(acc["n"] + same), F.when(higher, pair).otherwise(acc["p"] + same * pair)
        return F.struct(F.greatest(acc["identity"], e["identity"]).alias("identity"), n.alias("n"), p.alias("p"))

    # entries that tie for the best identity share the read, as in ``weigh``
    none = F.struct(F.lit(0.0).alias("identity"), F.lit(0).alias("n"), F.lit(0).alias("p"))
    entries = reads.select("sample", "read_id", F.size("r").alias("version"), F.transform(names, entry).alias("entries"))
    met = entries.select("*", F.aggregate("entries", none, best).alias("best"))
    kept = F.filter("entries", lambda e: (e["identity"] == F.col("best.identity")) & (e["identity"] >= least_identity))
    each = met.select("sample", "read_id", "version", "best", F.explode_outer(kept).alias("e"))
    n, p = F.col("best.n"), F.col("best.p")
    weight = F.when(F.col("e.paired"), 1 / n + (n - p) / (2 * n) / p).when(p > 0, 1 / (2 * n)).otherwise(F.lit(discordant) / n)
    return each.select("sample", "read_id", "e.contig", F.when(F.col("e").isNotNull(), weight).alias("weight"), "version")


def weights_stream(records: DataFrame, least_identity: float = 97.0, discordant: float = 1.0, keep: int | None = None) -> DataFrame:
    """Weights of a stream of candidates (sample, read_id, contig, ord, dir, proper, identity), in update mode.

    Without ``keep`` the state is an aggregation's, a read's records, and built-in expressions fold and weigh them.
    With ``keep``, records of a read that come so many milliseconds after its last ones start it anew, with version 1;
    such a stream looks for reads to forget for as long as it runs, so one that is to end by itself goes without.
    """
    kinds = {"sample": "string", "read_id": "string", "contig": "string", "ord": "long", "dir": "int", "proper": "boolean", "identity": "double"}
    keyed = records.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    if keep is None:
        return _weighed(keyed, least_identity, discordant)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, version = [], 0
        if state.exists:
            *columns, version = state.get
            known = list(zip(*columns, strict=True))
        for part in batches:
            known += list(part[["ord", "contig", "dir", "proper", "identity"]].itertuples(index=False, name=None))
        version += 1
        columns = [list(c) for c in zip(*known, strict=True)]
        state.update((*columns, version))
        state.setTimeoutDuration(keep)
        rows = weigh(fold(known), least_identity, discordant) or [(None, None)]
        yield pd.DataFrame([(*key, c, w, version) for c, w in rows], columns=["sample", "read_id", "contig", "weight", "version"])

    return keyed.groupBy("sample", "read_id").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest(weights: DataFrame) -> DataFrame:
    """The weights of each read's last version."""
    last = F.max("version").over(Window.partitionBy("sample", "read_id"))
    return weights.withColumn("_last", last).filter("version = _last AND contig IS NOT NULL").drop("_last", "version")


def counts(weights: DataFrame) -> DataFrame:
    """(sample, contig, count) of final weights."""
    return latest(weights).groupBy("sample", "contig").agg(F.sum("weight").alias("count"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window start, key, n) of an event stream in tumbling windows, late rows up to ``late``."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
