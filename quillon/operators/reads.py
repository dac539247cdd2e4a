"""Reads: mapping, buckets, quality offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.alphabet import dont_care_free, map_read


def prepare(reads: DataFrame) -> DataFrame:
    """reads(read_ord, read_id, raw[, qual]) with seq, len and has_n."""
    return reads.withColumn("seq", map_read(F.col("raw"))).withColumn("len", F.length("seq")).withColumn("has_n", ~dont_care_free(F.col("seq")))


def usable(reads: DataFrame, seed_length: int) -> DataFrame:
    """Reads that can be aligned: no N, at least as long as the seed."""
    return reads.filter((F.col("len") >= seed_length) & ~F.col("has_n"))


def rewrite_order(reads: DataFrame, block: int = 65_536) -> DataFrame:
    """new_ord: the place of a read when reads are sorted by length, N-free ones first, then input order.

    Running counts over blocks of read numbers within the (length, has_n) buckets, then a number within each block: no global sort, and a
    bucket of most reads is many groups."""
    own = reads.withColumn("_block", F.floor(F.col("read_ord") / block))
    cells = own.groupBy("len", "has_n", "_block").agg(F.count("*").alias("of"))
    inside = Window.partitionBy("len", "has_n").orderBy("_block")  # one row a block
    buckets = cells.groupBy("len", "has_n").agg(F.sum("of").alias("all"))
    first = Window.orderBy("len", "has_n")  # one row a length
    buckets = buckets.select("len", "has_n", (F.sum("all").over(first) - F.col("all")).alias("_first"))
    starts = cells.withColumn("_before", F.sum("of").over(inside) - F.col("of")).join(buckets, ["len", "has_n"]).select("len", "has_n", "_block", (F.col("_first") + F.col("_before")).alias("_start"))
    number = F.row_number().over(Window.partitionBy("len", "has_n", "_block").orderBy("read_ord")) - 1
    return own.withColumn("_no", number).join(starts, ["len", "has_n", "_block"]).withColumn("new_ord", F.col("_start") + F.col("_no")).drop("_no", "_start", "_block")


def length_buckets(reads: DataFrame) -> DataFrame:
    return reads.groupBy("len", "has_n").agg(F.count("*").alias("n_reads"))


def quality_offset(reads: DataFrame) -> DataFrame:
    """One row, quality_offset: by the first decisive character of the raw quality strings (quality_raw) in read order: up to '6' says 33,
    from '^' on says 64; 0 when none is decisive."""
    decisive = F.regexp_extract("quality_raw", r"^[7-\]]*([\x00-6^-\x7f])", 1)
    first = reads.select("read_ord", decisive.alias("c")).filter("c != ''")
    told = first.agg(F.min_by("c", "read_ord").alias("c"))
    return told.select(F.when(F.col("c").isNull(), 0).when(F.ascii("c") <= 54, 33).otherwise(64).alias("quality_offset"))
