"""Deterministic simulators of reads and of random text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.alphabet import encode_text, reverse_complement


def reads_of_documents(docs: DataFrame, length: int = 40, least: int = 200) -> DataFrame:
    """One read from each document of at least `least` bases: read_ord, read_id (its place, strand and substitutions), raw, qual, truth_pos."""
    # a value that lambdas read many times is generated once (inline), as Catalyst would put its expression into each of them
    once = lambda df, *c: df.select("doc_id", F.inline(F.array(F.struct(*c))))
    seq = once(docs.filter("doc_id is not null"), encode_text(F.col("text")).alias("s")).filter(F.length("s") >= least)
    place = (F.col("doc_id") * 7919 % F.nullif(F.length("s") - length, F.lit(0))).cast("int")  # the filter does not guard the remainder
    at = seq.select("doc_id", "s", place.alias("truth_pos"))
    part = once(at, "truth_pos", F.substring("s", F.col("truth_pos") + 1, F.lit(length)).alias("part"))
    hit = lambda j: (F.col("doc_id") * 31 + j * j * 17) % (7 + F.col("doc_id") % 17) == 0
    base = lambda j: F.substr(F.col("part"), j + 1, F.lit(1))
    places = F.sequence(F.lit(0), F.lit(length - 1))
    new = F.array_join(F.transform(places, lambda j: F.when(hit(j), F.translate(base(j), "ACGT", "CGTA")).otherwise(base(j))), "")
    odd = F.col("doc_id") % 2 == 1
    changes = F.array_join(F.transform(F.filter(places, hit), lambda j: F.concat(F.lit("_"), j.cast("string"), base(j), F.translate(base(j), "ACGT", "CGTA"))), "")
    name = F.concat(F.lit("p"), F.col("truth_pos").cast("string"), F.when(odd, F.lit("_inv")).otherwise(F.lit("")), changes)
    qual = F.transform(places, lambda j: (20 + (F.col("doc_id") * 13 + j * 7) % 20).cast("int"))
    return part.withColumn("new", new).select(F.col("doc_id").alias("read_ord"), name.alias("read_id"), F.when(odd, reverse_complement(F.col("new"))).otherwise(F.col("new")).alias("raw"), qual.alias("qual"), "truth_pos")


def random_text(spark: SparkSession, n: int, width: int = 60, seed: int = 1) -> DataFrame:
    """line_no, line: n bases from an arithmetic generator, width to a line; every base is a function of its place."""
    at = spark.range(n).withColumn("x", F.pmod((F.col("id") + seed) * 1103515245 + 12345, F.lit(2147483648)))
    base = F.substring(F.lit("ACGT"), F.pmod(F.shiftright("x", 16), F.lit(4)).cast("int") + 1, F.lit(1))
    lines = at.select(F.floor(F.col("id") / width).alias("line_no"), F.struct("id", base.alias("b")).alias("p"))
    return lines.groupBy("line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["b"]), "").alias("line"))  # width bases a group
