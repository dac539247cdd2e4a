"""Reference text: fragments, their windows, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.alphabet import encode_text

SEGMENT = 256


def fragments_of_documents(docs: DataFrame) -> DataFrame:
    """file_ord (rank of the language), frag_ord (doc_id), ref_id, seq, len; a language's rows share a file."""
    files = docs.select("lang").distinct().select(F.col("lang").alias("file"), (F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1).alias("file_ord"))  # one row a language
    seq = docs.select("lang", "doc_id", encode_text(F.col("text")).alias("seq")).filter("length(seq) > 0")
    # rows without an id are no fragments: nothing could name them
    joined = seq.filter("doc_id is not null").join(F.broadcast(files) if files.count() <= 10_000 else files, F.col("lang").eqNullSafe(F.col("file")))
    return joined.select("file_ord", F.col("doc_id").alias("frag_ord"), F.col("doc_id").cast("string").alias("ref_id"), "seq", F.length("seq").alias("len"))


def pieces(fragments: DataFrame, step: int, after: int, before: int = 0) -> DataFrame:
    """Fragments cut every `step` bases, each piece with the `after` bases that follow it and the `before` that precede it: file_ord, frag_ord, no, piece
    (it starts at no * step - before, or at 0).

    A fragment is cut once, in time proportional to its length, so that no later work depends on how long it is."""
    more, less = -(-after // step), -(-before // step)
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    own = fragments.filter("len > 0").select("file_ord", "frag_ord", cut.alias("cut"))

    def whole(x, i):
        joined = lambda at, n: F.array_join(F.slice("cut", at, n), "")
        parts = [F.right(joined(F.greatest(F.lit(1), i + 1 - less), F.least(F.lit(less), i)), F.lit(before))] if before else []
        return F.struct(i.alias("no"), F.concat(*parts, x, F.substring(joined(i + 2, F.lit(more)), 1, after)).alias("piece"))

    return own.select("file_ord", "frag_ord", F.inline(F.transform("cut", whole)))


def windows(fragments: DataFrame, length: int) -> DataFrame:
    """Every N-free window of the length: file_ord, frag_ord, pos (0-based), seed."""
    # pieces are dealt to all tasks before each becomes hundreds of rows, however few files or fragments the text has
    session = fragments.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    cut = pieces(fragments, SEGMENT, length - 1).repartition(tasks, "file_ord", "frag_ord", "no")
    most = F.least(F.lit(SEGMENT), F.length("piece") - (length - 1))
    seeds = F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.struct((F.col("no") * SEGMENT + i).alias("pos"), F.substr("piece", i + 1, F.lit(length)).alias("seed")))
    return cut.filter(most > 0).select("file_ord", "frag_ord", F.inline(seeds)).filter(~F.contains("seed", F.lit("N")))


def fragment_starts(fragments: DataFrame, block: int = 65_536) -> DataFrame:
    """start: where a fragment begins in its file's concatenated text, and the next one's start.

    Lengths are summed over blocks of fragment numbers, then within each block, so a file of many fragments is many groups."""
    own = fragments.select("file_ord", "frag_ord", "len", F.floor(F.col("frag_ord") / block).alias("_block"))
    sums = own.groupBy("file_ord", "_block").agg(F.sum("len").alias("_of"))
    before = Window.partitionBy("file_ord").orderBy("_block")  # one row a block
    sums = sums.select("file_ord", "_block", (F.sum("_of").over(before) - F.col("_of")).alias("_before"))
    inside = Window.partitionBy("file_ord", "_block").orderBy("frag_ord")
    met = own.withColumn("_in", F.sum("len").over(inside) - F.col("len")).join(sums, ["file_ord", "_block"])
    return met.select("file_ord", "frag_ord", "len", (F.col("_before") + F.col("_in")).alias("start")).withColumn("next_start", F.col("start") + F.col("len"))


def locate(positions: DataFrame, starts: DataFrame, step: int = 4096) -> DataFrame:
    """positions(file_ord, p) with the fragment that holds p: a range join as an equi-join on blocks of step bases, then the exact bounds."""
    blocks = starts.filter("len > 0").select("file_ord", "frag_ord", "start", "next_start", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("next_start") - 1) / step))).alias("block"))
    met = positions.withColumn("block", F.floor(F.col("p") / step)).join(blocks, ["file_ord", "block"])
    return met.filter("p >= start and p < next_start").select("file_ord", "p", "frag_ord", (F.col("p") - F.col("start")).alias("pos"))
