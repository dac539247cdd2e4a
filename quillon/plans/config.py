"""Options of an alignment, normalised."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class AlignConfig:
    """seed_mismatches s, total_mismatches e, seed_length l and the scoring parameters.

    s is at most 2 and e at most 15 (a negative e counts as 15); l is at most 64, rounded down to a multiple of 4, and at least 4; rates
    are clamped to 0..1, the GC bias to 0 or more, the filter level to 0..4.
    """

    seed_mismatches: int = 2
    total_mismatches: int = 5
    seed_length: int = 32
    unique: bool = True
    scored: bool = True
    quality_offset: int = 0  # 0: detect
    gapped: bool = False  # reads without a hit are looked for with one gap
    rewrite: bool = True  # unique hits are reported by read length, then in input order
    similarity: float = 0.995
    error_rate: float = 0.0
    transitions: float = 0.71
    gc: float = 0.41
    gc_bias: float = 2.0
    filter_level: int = 2

    def __post_init__(self):
        rate = lambda x: min(1.0, max(0.0, x))
        put = lambda k, v: object.__setattr__(self, k, v)
        put("seed_mismatches", min(2, max(0, self.seed_mismatches)))
        put("total_mismatches", 15 if self.total_mismatches < 0 else min(15, self.total_mismatches))
        put("seed_length", min(64, self.seed_length) // 4 * 4)
        if self.seed_length < 4:
            raise ValueError("the seed has at least 4 bases")
        for k in ("similarity", "error_rate", "transitions", "gc"):
            put(k, rate(getattr(self, k)))
        put("gc_bias", max(0.0, self.gc_bias))
        put("filter_level", min(4, max(0, self.filter_level)))

    def epsilon(self, length):
        """How far scores of two loci must differ to tell them apart, for reads of this length (a number or a column)."""
        return length * ({0: 0.0, 1: 0.5, 2: 1.0, 3: 2.0, 4: 3.0}[self.filter_level] * self.total_mismatches / 70.0)

    def with_(self, **changes) -> AlignConfig:
        return replace(self, **changes)
