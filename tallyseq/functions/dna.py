"""DNA column functions; all are built-in expressions, none runs Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def is_dna(s: Column) -> Column:
    """One or more of A, C, G, T and nothing else."""
    return s.rlike("^[ACGT]+$")


def encode(s: Column) -> Column:
    """Packed code, two bits a base, the first base highest; other characters count as A. Up to 31 bases."""
    digit = lambda i: F.greatest(F.instr(F.lit(BASES), F.substring(s, i, F.lit(1))) - 1, F.lit(0)).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0).cast("long"), lambda a, i: F.when(F.length(s) == 0, a).otherwise(a * 4 + digit(i)))


def decode(code: Column, length: int) -> Column:
    """Sequence of ``length`` bases from its packed code."""
    return F.concat(*[F.substring(F.lit(BASES), (F.shiftright(code, 2 * (length - 1 - k)).bitwiseAND(3) + 1).cast("int"), F.lit(1)) for k in range(length)])


def complement(s: Column) -> Column:
    """Complement; other characters stay."""
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def translate_nxt(barcode: Column) -> Column:
    """Complements the bases at 0-based positions 7 and 8 of barcodes of nine bases or more."""
    changed = F.concat(F.substring(barcode, 1, 7), complement(F.substring(barcode, 8, 2)), F.substring(barcode, 10, 1 << 20))
    return F.when(F.length(barcode) >= 9, changed).otherwise(barcode)


def cut_out(s: Column, start: int, length: int) -> Column:
    """Slice by 0-based start, null if the sequence ends before the slice does."""
    return F.when(F.length(s) >= start + length, F.substring(s, start + 1, length))


def kmer(s: Column, offset: int, k: int = 8) -> Column:
    """Upper-case k-mer at a 0-based offset; null if it is cut off or holds other characters."""
    piece = F.upper(F.substring(s, offset + 1, k)) if offset >= 0 else F.lit(None).cast("string")
    return F.when((F.length(piece) == k) & is_dna(piece), piece)


def read_orientation(seq: Column, flag: Column) -> Column:
    """The read as sequenced: alignments with flag 16 store its reverse complement."""
    return F.when(flag.bitwiseAND(16) != 0, reverse_complement(seq)).otherwise(seq)


def pattern_offset(pattern: Column) -> Column:
    """0-based place of (BC) in a pattern, -1 if it has none."""
    return F.instr(pattern, "(BC)") - 1


def hamming_packed(a: Column, b: Column) -> Column:
    """Differing bases of two packed codes."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two strings of equal length, of any length; null if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x))


def mark_differences(reference: Column, query: Column) -> Column:
    """The query with the characters that differ from the reference in lower case."""
    return F.array_join(F.zip_with(F.split(reference, ""), F.split(query, ""), lambda r, c: F.when(r == c, c).otherwise(F.lower(c))), "")


def error_probability(quality: Column) -> Column:
    """Chance of error of a Phred+33 quality character."""
    return F.pow(F.lit(10.0), (F.ascii(quality) - 33) * -0.1)


def n_count(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("N"), F.lit("")))


def within_n_budget(s: Column, max_n: int) -> Column:
    """Only A, C, G, T and N, with fewer than ``max_n`` N."""
    return s.rlike("^[ACGTN]+$") & (n_count(s) < max_n)


def expand_n(s: Column, most: int) -> Column:
    """Array of all sequences with A, C, G, T in the place of up to ``most`` N, in that order; more N remain as they are."""
    first = lambda x: F.when(F.contains(x, F.lit("N")), F.transform(F.array(*[F.lit(b) for b in BASES]), lambda b: F.regexp_replace(x, F.lit("^([^N]*)N"), F.concat(F.lit("$1"), b)))).otherwise(F.array(x))
    return reduce(lambda a, _: F.flatten(F.transform(a, first)), range(most), F.array(s))


def neighbours(s: Column, length: int) -> Column:
    """Array of the 3 * ``length`` sequences at distance one, as struct(sequence, pos from 0). One small expression for all, so that plans compile."""
    shifts = F.array(*[F.lit(x) for x in ("CGTA", "GTAC", "TACG")])

    def changed(k: Column) -> Column:
        pos = F.floor(k / 3).cast("int")
        base = F.substring(F.element_at(shifts, (k % 3 + 1).cast("int")), F.instr(F.lit(BASES), F.substring(s, pos + 1, F.lit(1))), F.lit(1))
        return F.struct(F.concat(F.substring(s, F.lit(1), pos), base, F.substring(s, pos + 2, F.lit(length))).alias("sequence"), pos.alias("pos"))

    return F.transform(F.sequence(F.lit(0), F.lit(3 * length - 1)), changed)


def windows(s: Column, length: Column | int) -> Column:
    """Array of struct(position from 0, window) over all windows of ``length``; empty for shorter sequences."""
    length = F.lit(length) if isinstance(length, int) else length
    made = F.transform(F.sequence(F.lit(0), F.length(s) - length), lambda i: F.struct(i.alias("position"), F.substring(s, i + 1, length).alias("window")))
    return F.when(F.length(s) >= length, made).otherwise(F.array().cast("array<struct<position:int,window:string>>"))


def split_nonempty(s: Column, delimiter: str) -> Column:
    """Parts between delimiters, empty ones left out."""
    return F.filter(F.split(s, delimiter), lambda x: x != "")


def gene_of(tags: Column, tag: str = "GX") -> Column:
    """Value of the gene tag, of GE where it is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(tag)), F.try_element_at(tags, F.lit("GE")))


def hits_of(nh: Column) -> Column:
    """Number of hits, 1 where it is missing or below 1."""
    return F.greatest(F.coalesce(nh, F.lit(1)), F.lit(1))
