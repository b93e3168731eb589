"""Expressions on nucleotide sequences: words of bases, their complements, GC share, codons.

Bases are numbered A 0, T 1, G 2, C 3, so the complement flips the lowest bit and G and C have the second
bit.  Any other character counts as A; letters are case-sensitive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base order of the word numbers, and the numbers of the two stop codons that are reported.
BASES = "ATGC"
STOP_CODONS = (16, 18)
WORD = 4


def gc_fraction(sequence: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.length(F.regexp_replace(sequence, "[^GC]", "")) / F.nullif(F.length(sequence), F.lit(0)).cast("double")


def digits(sequence: Column) -> Column:
    """The bases' numbers as an array of ints."""
    coded = F.translate(F.regexp_replace(sequence, "(?s)[^ATGC]", "A"), BASES, "0123")
    return F.when(F.length(sequence) > 0, F.transform(F.split(coded, ""), lambda c: c.cast("int"))).otherwise(F.array().cast("array<int>"))


def word_numbers(digits_: Column, width: int = WORD) -> Column:
    """Numbers of all overlapping words of ``width`` bases; none if the sequence is shorter.

    ``digits_`` must be a plain column: an expression would be worked out again for every word.
    """
    count = F.size(digits_) - (width - 1)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def number(i: Column) -> Column:
        total = F.lit(0)
        for k in range(width):
            total = total * 4 + F.element_at(digits_, i + (k + 1))
        return total

    return F.transform(at, number)


def reverse_complement_number(number: Column, width: int = WORD) -> Column:
    """Number of the reverse complement of a word of plain bases: its digits reversed, each lowest bit flipped."""
    out = F.lit(0)
    for k in range(width):
        out = out * 4 + F.shiftright(number, 2 * k).bitwiseAND(F.lit(3)).bitwiseXOR(F.lit(1))
    return out


def gc_of_word(number: Column) -> Column:
    """How many bases of a tetramer are G or C."""
    return F.bit_count(number.bitwiseAND(F.lit(0b10101010)))


_CODE = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(BASES):
    _CODE[ord(_c)] = _i
_REVERSED = np.array([sum(((n >> 2 * k & 3) ^ 1) << 2 * (WORD - 1 - k) for k in range(WORD)) for n in range(4**WORD)])


def tetramer_counts(sequence: str) -> np.ndarray:
    """256 counts over both strands, where the strand read backwards takes unknown bases as A too."""
    raw = np.frombuffer(sequence.encode("latin-1", "replace"), dtype=np.uint8)
    counts = np.zeros(4**WORD, dtype=np.int64)
    if len(raw) < WORD:
        return counts
    code = _CODE[raw]
    known = (code > 0) | (raw == ord("A"))
    back = np.where(known, code ^ 1, 0)
    forward = sum(code[k : len(code) - WORD + 1 + k] << 2 * (WORD - 1 - k) for k in range(WORD))
    reverse = sum(back[k : len(back) - WORD + 1 + k] << 2 * k for k in range(WORD))
    return np.bincount(forward, minlength=4**WORD) + np.bincount(reverse, minlength=4**WORD)


def codon_numbers(digits_: Column) -> Column:
    """Numbers of the codons of a reading frame, each third place, without the last codon; of a plain column as well."""
    last = F.size(digits_) - 6
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.element_at(digits_, i + 1) * 16 + F.element_at(digits_, i + 2) * 4 + F.element_at(digits_, i + 3))
