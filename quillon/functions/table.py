"""align_hits: the alignment as a table function of SQL.

    register(spark, text, reads, config, "meetings")
    SELECT * FROM align_hits(TABLE(meetings) PARTITION BY (pair_idx, key) ORDER BY side, seed_length => 32, seed_mismatches => 2, total_mismatches => 5)

The view holds both sides of the seed join: reads under their keys (side 0, near: the whole read) and places of the text under theirs (side 1, near: text
around the window, which begins after `lead` bases). Spark deals the view by key; a call of the function sees one key, reads first, and holds those reads
alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.reads import usable
from quillon.operators.seeds import Pieces, candidates, cover, probes, text_pieces
from quillon.plans.config import AlignConfig

from .alphabet import PAIRS

HITS = "read_ord bigint, strand string, file_ord int, frag_ord bigint, pos bigint, k int"


class AlignHits:
    """One key: each read that it holds against each place of the text."""

    def __init__(self):
        self.reads = []

    def eval(self, row, seed_length: int, seed_mismatches: int, total_mismatches: int):
        if not row["side"]:
            flip = str.maketrans("ACGT", "TGCA")
            self.reads.append((row["read_ord"], row["strand"], row["near"] if row["strand"] == "+" else row["near"][::-1].translate(flip)))
            return
        n, quarter = seed_length, seed_length // 4
        apart = lambda a, b: sum(x != y for x, y in zip(a, b))
        for read, strand, w in self.reads:
            back = 0 if strand == "+" else len(w) - n
            at = row["lead"] - back
            window = row["near"][at : at + len(w)] if at >= 0 else ""
            if len(window) < len(w) or "N" in window:
                continue
            x, y = window[back : back + n], w[back : back + n]
            k = apart(window, w)
            if k > total_mismatches or apart(x, y) > seed_mismatches:
                continue
            same = [x[i * quarter : (i + 1) * quarter] == y[i * quarter : (i + 1) * quarter] for i in range(4)]
            if next(i for i in cover(seed_mismatches) if same[PAIRS[i][0]] and same[PAIRS[i][1]]) == row["pair_idx"]:  # the first pair that agrees
                yield read, strand, row["file_ord"], row["frag_ord"], row["at"] - back, k


def register(spark: SparkSession, text: DataFrame | Pieces, reads: DataFrame, config: AlignConfig, view: str, name: str = "align_hits") -> None:
    """Make the function known under its name, and the view of reads and text that meet."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(AlignHits, returnType=HITS))
    n, s = config.seed_length, config.seed_mismatches
    p = probes(reads, n, s)
    more = max(n, p.longest) - n
    places = candidates(text_pieces(text, more, max(n, p.longest)), p, n, s, (more, more))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = p.rows.join(usable(reads, n).select("read_ord", F.col("seq").alias("near")), "read_ord")
    left = asked.select("pair_idx", "key", F.lit(0).alias("side"), F.col("read_ord").cast("long").alias("read_ord"), "strand", none("int", "file_ord"), none("long", "frag_ord"), none("long", "at"), none("int", "lead"), "near")
    right = places.select("pair_idx", "key", F.lit(1).alias("side"), none("long", "read_ord"), none("string", "strand"), F.col("file_ord").cast("int"), F.col("frag_ord").cast("long"), "at", "lead", "near")
    left.unionAll(right).createOrReplaceTempView(view)
