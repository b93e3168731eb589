"""Expressions on alignment records: flags, CIGAR and MD strings, identity and coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the alignment flag.
PAIRED, PROPER, FIRST_MATE, SECOND_MATE = 0x1, 0x2, 0x40, 0x80
#: A base counts from this quality character on (Phred 20 with offset 33).
LEAST_QUALITY = 53
LEAST_COVERAGE = 70.0
LEAST_IDENTITY = 97.0


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def pair_direction(flag: Column) -> Column:
    """1 for the first mate, 2 for the second, 0 else."""
    return F.when(has_flag(flag, FIRST_MATE), 1).when(has_flag(flag, SECOND_MATE), 2).otherwise(0)


def cigar_operations(cigar: Column) -> Column:
    return F.regexp_extract_all(cigar, F.lit(r"\d+[A-Z=*]"), F.lit(0))


def simple_shape(cigar: Column) -> Column:
    """Whether a CIGAR has one or two operations."""
    return F.size(cigar_operations(cigar)).between(1, 2)


def without_gaps(cigar: Column) -> Column:
    """Whether a CIGAR has no insertion, deletion, skip or padding."""
    return ~cigar.rlike("[IDNP*]")


def clipped_start(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"^(\d+)S", 1), F.lit("")).cast("int"), F.lit(0))


def clipped_end(cigar: Column, length: Column) -> Column:
    """End of the aligned window: the length less a soft clip at the end."""
    return length - F.coalesce(F.nullif(F.regexp_extract(cigar, r"\D(\d+)S$", 1), F.lit("")).cast("int"), F.lit(0))


def md_mismatches(md: Column) -> Column:
    """Positions of the mismatches of an MD string, from 0 in the aligned window; deletions take no place."""
    tokens = F.regexp_extract_all(md, F.lit(r"(\^[A-Z]+|[A-Z]|[0-9]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        # by the order of characters, digits come before letters and those before "^"
        run = F.when((token < ":") & (F.length(token) <= 9), token.cast("int"))
        mismatch = (token >= "A") & (token < "^")
        at = acc["at"] + F.coalesce(run, F.when(mismatch, 1).otherwise(0))
        return F.struct(at.alias("at"), F.when(mismatch, F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def identity(md: Column, quality: Column, start: Column, end: Column) -> Column:
    """Per cent of matches among the bases of the window whose quality suffices; null if there is none."""
    window = F.substring(quality, start + 1, end - start)
    good = F.length(F.regexp_replace(window, rf"[\x00-\x{LEAST_QUALITY - 1:02x}]", ""))
    bad = F.filter(md_mismatches(md), lambda p: F.ascii(F.substring(window, p + 1, F.lit(1))) >= LEAST_QUALITY)
    return 100.0 * (good - F.size(bad)) / F.nullif(good, F.lit(0))


def coverage(start: Column, end: Column, length: Column) -> Column:
    """Per cent of the read that is aligned."""
    return 100.0 * (end - start) / F.nullif(length, F.lit(0))
