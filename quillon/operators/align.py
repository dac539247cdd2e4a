"""Alignment: seeds meet in an equi-join on numbers, survivors fetch their read and are verified.

A seed of four quarters with at most two mismatches has two quarters without any, so an equi-join on (pair of quarters, key) finds every window within
the seed's bound. seeds.py makes the text's side: rows for windows whose key is a read's, with the text around them. Of the pairs that agree the
first alone counts, so that a hit is found once. The seed's distance is counted where both sides meet; what survives is joined with the reads and verified
against the text it carries. Probes are broadcast up to BROADCAST_BYTES of them, so that the text is not shuffled at all; beyond that both sides
shuffle by key, and Spark's adaptive skew join splits the keys of repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.alphabet import hamming, reverse_complement
from quillon.functions.scoring import alignment_score
from quillon.plans.config import AlignConfig

from . import direct
from .reads import usable
from .seeds import Pieces, probes, seed_hits, text_pieces

BROADCAST_BYTES, PROBE_BYTES = 64 << 20, 12 * 100


def seed_matches(text: DataFrame | Pieces, reads: DataFrame, config: AlignConfig) -> DataFrame:
    """Every hit once: read_ord, strand, file_ord, frag_ord, pos, pairs (the quarter pairs that agree), seed_k, k, len, and w, window, q.

    text: fragments, or pieces with as much text around as the longest read needs."""
    n = config.seed_length
    p = probes(reads, n, config.seed_mismatches)
    more = max(n, p.longest) - n
    met = seed_hits(text_pieces(text, more, max(n, p.longest)), p, n, config.seed_mismatches, (more, more), BROADCAST_BYTES // PROBE_BYTES)
    return verified(met, reads, config, p.n * (2 * p.longest + 50) <= BROADCAST_BYTES)


def verified(met: DataFrame, reads: DataFrame, config: AlignConfig, few: bool = False) -> DataFrame:
    """Places near a seed, with the text around, held against their reads; few: the reads' bytes are known to suit a broadcast."""
    n, plus = config.seed_length, F.col("strand") == "+"
    back = F.when(plus, F.lit(0)).otherwise(F.col("len") - n)  # how far before the seed the read begins
    met = met.withColumn("pos", (F.col("at") - back).cast("int")).withColumn("window", F.substr("near", F.col("lead") - back + 1, F.col("len")))
    met = met.filter((F.col("lead") >= back) & (F.length("window") == F.col("len")) & ~F.contains("window", F.lit("N")))
    qual = F.col("qual") if "qual" in reads.columns else F.lit(None).cast("array<int>")
    own = usable(reads, n).select("read_ord", F.col("seq").alias("_seq"), qual.alias("_qual"))
    met = met.join(F.broadcast(own) if few else own, "read_ord")
    met = met.withColumn("w", F.when(plus, F.col("_seq")).otherwise(reverse_complement(F.col("_seq")))).withColumn("q", F.when(plus, F.col("_qual")).otherwise(F.reverse("_qual")))
    met = met.withColumn("k", hamming(F.col("window"), F.col("w"))).filter(F.col("k") <= config.total_mismatches)
    return met.select("read_ord", "strand", "file_ord", "frag_ord", "pos", "pairs", "seed_k", "k", "len", "w", "window", "q")


def events(matches: DataFrame) -> DataFrame:
    """Each hit once for every quarter pair that agrees (pair_idx), as the order-dependent rule counts them."""
    return matches.withColumn("pair_idx", F.explode("pairs")).drop("pairs")


def with_score(matches: DataFrame, config: AlignConfig, qualities: bool) -> DataFrame:
    return matches.withColumn("score", alignment_score(F.col("window"), F.col("w"), F.col("q") if qualities else None, config))


def all_hits(matches: DataFrame) -> DataFrame:
    """Distinct hits; both strands stay apart."""
    return matches.dropDuplicates(["read_ord", "strand", "file_ord", "frag_ord", "pos"])


def distinct_hits(text: DataFrame | Pieces, reads: DataFrame, config: AlignConfig, scored: bool = False, once: bool = False) -> DataFrame:
    """all_hits of the reads: read_ord, strand, file_ord, frag_ord, pos, k and, if asked for, score. Nothing is shuffled if the reads fit a broadcast and
    once says that no two reads and no two fragments share their numbers."""
    found = direct.hits(text, reads, config, scored)
    if found is None:
        met = seed_matches(text, reads, config)
        return all_hits(with_score(met, config, True) if scored else met)
    return found if once else all_hits(found)


def hit_counts(text: DataFrame | Pieces, reads: DataFrame, config: AlignConfig, once: bool = False) -> DataFrame:
    """read_ord, n_hits and least_k of the reads that have hits; once as in distinct_hits."""
    found = direct.counts(text, reads, config) if once else None
    if found is None:
        found = distinct_hits(text, reads, config).groupBy("read_ord").agg(F.count("*").alias("n_hits"), F.min("k").alias("least_k"))
    return found


def telling_hits(text: DataFrame | Pieces, reads: DataFrame, config: AlignConfig, scored: bool = False) -> DataFrame:
    """Hits enough for choose.unique_by_errors or, if scored, choose.unique_by_score."""
    found = direct.best(text, reads, config, scored)
    if found is None:
        met = seed_matches(text, reads, config)
        return with_score(met, config, True) if scored else met
    return found


def telling_events(text: DataFrame | Pieces, reads: DataFrame, config: AlignConfig) -> DataFrame:
    """Scored events enough for choose.unique_by_fold."""
    found = direct.events(text, reads, config)
    return events(with_score(seed_matches(text, reads, config), config, True)) if found is None else found


def ranked(hits: DataFrame) -> DataFrame:
    """Hits in reporting order within their read: mismatches, place, then score and strand. Sorted within the partitions of the reads."""
    keys = ["k", "pos", "file_ord", "frag_ord", *(["score"] if "score" in hits.columns else []), "strand"]
    return hits.repartition("read_ord").sortWithinPartitions("read_ord", *keys)


def matched(reads: DataFrame, hits: DataFrame) -> DataFrame:
    return reads.join(hits.select("read_ord"), "read_ord", "left_semi")


def unmatched(reads: DataFrame, hits: DataFrame) -> DataFrame:
    return reads.join(hits.select("read_ord"), "read_ord", "left_anti")
