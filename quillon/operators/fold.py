"""The order-dependent rule for a read's best locus, as an operation that parts of its events can be summed up for.

Events come in the order file, strand, pair, fragment, position. A better score by more than epsilon replaces the best; one within epsilon at another locus
makes the read not unique, which only a better one by more than epsilon undoes. What a run of events does to the state that enters it:

- The first event that replaces the entering best is the first whose score is over best + epsilon, and so one that exceeds all before it in the run. For each
  such record the summary holds the state in which the run leaves when it took over (over: its score; best; alone).
- If none replaces it, the run ties with the entering best or not by its highest score at another locus: the highest score (first), and the highest at
  another locus than that one's (second), tell it for any best.

The summary of two neighbouring runs follows from theirs, so a read's events may be cut anywhere and be summed up in different tasks; what meets in the end
is a summary for each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.config import AlignConfig

STRETCH = 65_536  # positions of a fragment to a part, and so at most as many events
HIT = ["file_ord", "frag_ord", "pos", "strand", "k", "score"]


def elsewhere(a, b):
    return (a["file_ord"] != b["file_ord"]) | (a["frag_ord"] != b["frag_ord"]) | (a["pos"] != b["pos"])


def record(over, best, alone):
    return F.struct(over.alias("over"), F.struct(*[best[c].alias(c) for c in HIT]).alias("best"), alone.alias("alone"))


def sums(records, first, second):
    return F.struct(records.alias("records"), F.struct(*[first[c].alias(c) for c in HIT]).alias("first"), second.cast("double").alias("second"))


def single(v):
    """The summary of one event."""
    return sums(F.array(record(v["score"], v, F.lit(True))), v, F.lit(None))


def leaves(best, alone, b, eps):
    """The state (as a record, over: best's score) in which run b leaves when (best, alone) enters."""
    replaced = F.get(F.filter(b["records"], lambda r: r["over"] > best["score"] + eps), F.lit(0))
    highest = F.when(elsewhere(b["first"], best), b["first"]["score"]).otherwise(b["second"])
    stays = record(best["score"], best, alone & ~F.coalesce(highest > best["score"] - eps, F.lit(False)))
    return F.coalesce(replaced, stays)


def combined(a, b, eps):
    """The summary of run a and then run b."""
    kept = F.transform(a["records"], lambda r: r.withField("best", leaves(r["best"], r["alone"], b, eps)["best"]).withField("alone", leaves(r["best"], r["alone"], b, eps)["alone"]))
    more = F.filter(b["records"], lambda r: r["over"] > a["first"]["score"])
    apart = elsewhere(a["first"], b["first"])
    higher = b["first"]["score"] > a["first"]["score"]
    second = F.when(~apart, F.greatest(a["second"], b["second"])).when(higher, F.greatest(a["first"]["score"], b["second"])).otherwise(F.greatest(a["second"], b["first"]["score"]))
    return sums(F.concat(kept, more), F.when(higher, b["first"]).otherwise(a["first"]), second)


def over_all(items, start, step):
    """step folded over an array that is not empty, from its first item's start on."""
    return F.aggregate(F.slice(items, 2, F.greatest(F.lit(1), F.size(items))), start(F.get(items, F.lit(0))), step)


def states(events: DataFrame, config: AlignConfig) -> DataFrame:
    """A row a read: read_ord, file_ord, frag_ord, pos, strand, k, score of its best, and loci: 1, or 2 if it is not unique. events as found, not distinct."""
    rows = events.select("read_ord", config.epsilon(F.col("len")).alias("eps"), "pair_idx", F.struct(*HIT).alias("hit"))
    # neighbours in the order of events share a part; parts are in the order of their keys
    part = [F.col("hit.file_ord").alias("p_file"), F.col("hit.strand").alias("p_strand"), F.col("pair_idx").alias("p_pair"), F.col("hit.frag_ord").alias("p_frag"), F.floor(F.col("hit.pos") / STRETCH).alias("p_stretch")]
    turn = F.struct(F.col("hit.pos").alias("at"), "hit")
    parts = rows.groupBy("read_ord", "eps", *part).agg(F.array_sort(F.collect_list(turn)).alias("e"))
    hits = parts.withColumn("e", F.transform("e", lambda v: v["hit"]))
    runs = hits.withColumn("s", over_all(F.col("e"), single, lambda a, v: combined(a, single(v), F.col("eps"))))
    keys = ["p_file", "p_strand", "p_pair", "p_frag", "p_stretch"]
    met = runs.groupBy("read_ord", "eps").agg(F.sort_array(F.collect_list(F.struct(*keys, "s"))).alias("s"))
    done = met.select("read_ord", over_all(F.transform("s", lambda x: x["s"]), lambda s: s, lambda a, b: combined(a, b, F.col("eps"))).alias("s"))
    end = done.select("read_ord", F.get(F.col("s.records"), F.lit(0)).alias("r"))
    return end.select("read_ord", *[F.col(f"r.best.{c}").alias(c) for c in HIT], F.when(F.col("r.alone"), 1).otherwise(2).cast("long").alias("loci"))
