"""The substitution model: odds of read bases given reference bases, and scores of alignments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.plans.config import AlignConfig

BASES = "ACGT"
# fixed values: the error probability of a quality, to seven decimals
ERROR_OF_QUALITY = [
    1.0000000, 0.7943282, 0.6309573, 0.5011872, 0.3981072, 0.3162278, 0.2511886, 0.1995262, 0.1584893, 0.1258925,
    0.1000000, 0.0794328, 0.0630957, 0.0501187, 0.0398107, 0.0316228, 0.0251189, 0.0199526, 0.0158489, 0.0125893,
    0.0100000, 0.0079433, 0.0063096, 0.0050119, 0.0039811, 0.0031623, 0.0025119, 0.0019953, 0.0015849, 0.0012589,
    0.0010000, 0.0007943, 0.0006310, 0.0005012, 0.0003981, 0.0003162, 0.0002512, 0.0001995, 0.0001585, 0.0001259,
    0.0001000, 0.0000794, 0.0000631, 0.0000501, 0.0000398, 0.0000316, 0.0000251, 0.0000200, 0.0000158, 0.0000126,
    0.0000100, 0.0000079, 0.0000063, 0.0000050, 0.0000040, 0.0000032, 0.0000025, 0.0000020, 0.0000016, 0.0000013,
    0.0000010, 0.0000008, 0.0000006, 0.0000005, 0.0000004,
]
READ_WITHOUT_QUALITY = 30


def odds(config: AlignConfig) -> dict[str, float]:
    """odds[reference base + read base]: probability of the read base over its background frequency.

    A base mutates with probability 1 - similarity, split between its one transition and two transversions; changes away from G and C are
    gc_bias times as likely, corrected for how often they occur.
    """
    frequency = {"A": (1 - config.gc) / 2, "T": (1 - config.gc) / 2, "C": config.gc / 2, "G": config.gc / 2}
    bias = config.gc_bias * (1 - config.gc) / config.gc
    change = 1 - config.similarity
    out = {}
    for x in BASES:
        weight = bias / config.gc if x in "GC" else 1 / (1 - config.gc)
        moved = {}
        for y in BASES:
            if y != x:
                transition = {x, y} in ({"A", "G"}, {"C", "T"})
                moved[y] = change * (config.transitions if transition else (1 - config.transitions) / 2) / (bias + 1) * weight
        moved[x] = 1 - sum(moved.values())
        for y in BASES:
            out[x + y] = moved[y] * (1 - config.error_rate) / frequency[y]
    return out


def log_odds(config: AlignConfig) -> dict[str, float]:
    return {k: math.log2(v) if v > 0 else -math.inf for k, v in odds(config).items()}


def odds_of_probabilities(config: AlignConfig, ref: str, a: float, c: float, g: float, t: float) -> float:
    """Score of a base whose four call probabilities are known."""
    o = odds(config)
    return math.log2(sum(o[ref + y] * p for y, p in zip(BASES, (a, c, g, t))))


def alignment_score(ref: Column, read: Column, qualities: Column | None, config: AlignConfig) -> Column:
    """1 + the sum of log-odds of aligned bases, each weighted by the certainty of its quality. read and qualities are in the strand's direction."""
    table = F.create_map(*[F.lit(x) for kv in log_odds(config).items() for x in kv])
    certain = F.array(*[F.lit(1 - e) for e in ERROR_OF_QUALITY])

    def step(acc, j):
        q = F.lit(READ_WITHOUT_QUALITY) if qualities is None else F.least(F.lit(63), F.greatest(F.lit(0), F.element_at(qualities, j)))
        return acc + F.element_at(table, F.concat(F.substr(ref, j, F.lit(1)), F.substr(read, j, F.lit(1)))) * F.element_at(certain, q + 1)

    return F.lit(1.0) + F.aggregate(F.sequence(F.lit(1), F.length(read)), F.lit(0.0), step)
