"""The one best locus of a read, or none when it is not unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.config import AlignConfig

from . import fold

LOCUS = ["file_ord", "frag_ord", "pos"]


def unique_by_errors(matches: DataFrame) -> DataFrame:
    """Reads with exactly one locus of the fewest mismatches; '+' when both strands hit it."""
    return states_by_errors(matches).filter("loci = 1").drop("loci")


def states_by_errors(matches: DataFrame) -> DataFrame:
    """A row a read: a locus of the fewest mismatches, and how many there are (loci). Two partial aggregations, no window.

    A locus is reduced first, so a read with many hits is pre-aggregated before it meets."""
    locus = matches.groupBy("read_ord", *LOCUS).agg(F.min(F.struct("k", "strand")).alias("b"))
    level = locus.groupBy("read_ord", F.col("b.k").alias("k")).agg(F.count("*").alias("loci"), F.min(F.struct(*LOCUS, F.col("b.strand").alias("strand"))).alias("hit"))
    best = level.groupBy("read_ord").agg(F.min_by(F.struct("k", "loci", "hit"), "k").alias("x"))
    return best.select("read_ord", "x.hit.*", F.col("x.k").alias("k"), "x.loci")


def unique_by_score(matches: DataFrame, config: AlignConfig) -> DataFrame:
    """Order-free rule: the best score, unless another locus has more than it less epsilon (at epsilon 0: as much)."""
    return states_by_score(matches, config).filter("loci = 1").drop("loci")


def states_by_score(matches: DataFrame, config: AlignConfig) -> DataFrame:
    """A row a read: its best locus and how many are as good (loci)."""
    locus = matches.groupBy("read_ord", "len", *LOCUS).agg(F.max(F.struct("score", (F.col("strand") == "+").alias("plus"), (-F.col("k")).alias("nk"))).alias("b"))
    top = locus.groupBy("read_ord", "len").agg(F.max("b.score").alias("best"))
    eps = config.epsilon(F.col("len"))
    near = locus.join(top, ["read_ord", "len"]).filter((F.col("b.score") > F.col("best") - eps) | (F.col("b.score") == F.col("best")))
    one = near.groupBy("read_ord").agg(F.count("*").alias("loci"), F.max(F.struct("b.score", "b.plus", "b.nk", *LOCUS)).alias("h"))
    strand = F.when(F.col("h.plus"), F.lit("+")).otherwise(F.lit("-"))
    return one.select("read_ord", *[F.col(f"h.{c}").alias(c) for c in LOCUS], strand.alias("strand"), (-F.col("h.nk")).alias("k"), F.col("h.score").alias("score"), "loci")


def unique_by_fold(events: DataFrame, config: AlignConfig) -> DataFrame:
    """Order-dependent rule: events fold in the order file, strand, pair, fragment, position, as found (not distinct).

    A better score by more than epsilon replaces the best; one within epsilon at another locus makes the read not unique, which only a
    better one by more than epsilon undoes."""
    return fold.states(events, config).filter("loci = 1").drop("loci")


def report(best: DataFrame, reads: DataFrame, fragments: DataFrame, scored: bool, rewrite: bool = True) -> DataFrame:
    """The eleven columns of an alignment report; ids are joined last.

    Rows come in the order of the reads, by length first when these are rewritten by length (rewrite), and a read's hits by mismatches, place,
    score and strand: a distributed sort of the report alone."""
    from quillon.functions.alphabet import reverse_complement

    ids = reads.select("read_ord", "read_id", F.col("seq").alias("_seq"), "len")
    refs = fragments.select("file_ord", "frag_ord", "ref_id")
    best = best.select("read_ord", "file_ord", "frag_ord", "pos", "strand", "k", *(["score"] if scored else []))
    b = best.join(ids, "read_ord").join(refs, ["file_ord", "frag_ord"])
    b = b.orderBy(*(["len"] if rewrite else []), "read_ord", "k", "pos", "file_ord", "frag_ord", *(["score"] if scored else []), "strand")
    seq = F.when(b["strand"] == "-", reverse_complement(F.col("_seq"))).otherwise(F.col("_seq"))
    return b.select(
        "read_id", seq.alias("seq"), (F.col("score") if scored else F.lit(None).cast("double")).alias("score"), F.lit(1).alias("n_hits"), F.lit("a").alias("pair"),
        F.col("len"), "strand", "ref_id", (F.col("pos") + 1).cast("long").alias("pos"), F.lit("").alias("hit_type"), F.col("k").cast("int").alias("errors"),
    )
