"""Column expressions over base strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
ODD_BITS = 0x5555555555555555


def encode_text(text: Column) -> Column:
    """Prose as bases: its letters a-z in turn as C, G, T, A and on; all else is dropped."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, ("CGTA" * 7)[: len(LETTERS)])


def keep_bases(raw: Column) -> Column:
    """Reference text: upper-case A C G T N stay, every other character is dropped."""
    return F.regexp_replace(raw, "[^ACGTN]", "")


def map_read(raw: Column) -> Column:
    """Read: upper-case A C G T stay, every other character becomes N."""
    return F.regexp_replace(raw, "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def dont_care_free(seq: Column) -> Column:
    return ~F.contains(seq, F.lit("N"))


def code(seq: Column) -> Column:
    """Up to 31 bases at two bits each, the first in the highest bits."""
    return F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long")


def uncode(c: Column, n: int) -> Column:
    return F.translate(F.lpad(F.conv(c.cast("string"), 10, 4), n, "0"), "0123", "ACGT")


def quarters(seed: Column, length: int) -> list[Column]:
    q = length // 4
    return [F.substring(seed, i * q + 1, q) for i in range(4)]


def pair_codes(m: list[Column], length: int) -> Column:
    """The six (pair, key) structs of a seed's quarter codes: two quarters together as one number."""
    return F.array(*[F.struct(F.lit(i).alias("pair_idx"), F.shiftleft(m[a], 2 * (length // 4)).bitwiseOR(m[b]).alias("key")) for i, (a, b) in enumerate(PAIRS)])


def differing(a: Column, b: Column) -> Column:
    """How many two-bit symbols of two codes differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ODD_BITS))).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Differing bases of two N-free strings of equal length, 16 at a time."""
    parts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(a), F.lit(1)) - 1) / 16).cast("int"))
    step = lambda acc, i: acc + differing(code(F.substr(a, i * 16 + 1, F.lit(16))), code(F.substr(b, i * 16 + 1, F.lit(16))))
    return F.when(F.length(a) == 0, F.lit(0)).when(a == b, F.lit(0)).otherwise(F.aggregate(parts, F.lit(0), step))
