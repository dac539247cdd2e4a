"""Operator 4: sharding by sampled splitters, native.

Law "bytes": shards of near-equal size. Records are ordered by (hash of the text, doc_id), so equal texts are neighbours:

1. a size-weighted hash sample of the keys (about SAMPLE keys) gives RANGES quantile boundaries;
2. exact bytes and rows per range are summed; a range beyond the target is subdivided into equal key intervals, and a key that alone
   exceeds its share (a hot group of copies) has its rows dealt over sub-ranges of their own by doc_id, and the equal rows of one doc_id
   that alone exceed it, by row (which of them gets which slot makes no difference);
3. running sums over the cells, then within each cell, give every record its exact place in the order; a group of copies goes whole to
   the shard of its first byte, a hot group is cut at the shard boundaries.

Only thin rows (ids, sizes, hashes) are shuffled, each window holds one bounded cell, and what reaches the driver are RANGES - 1
boundaries and one row of totals. DataFrame functions only.

Defined results: a null text has size 1 and the hash of the empty text; a null doc_id sorts first; repeated rows each get a slot; an
empty table gives an empty result; a very long text is one row of one shard; equal sizes and texts are told apart by doc_id; other columns
are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SAMPLE, RANGES, CELL_ROWS, HEAVY = 65_536, 128, 500_000, 512


def thin_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key: all that placing a record needs."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key")
    )


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, size, text_crc32, law, shard (0 to shards - 1), slot (gapless from 0 within its shard)."""
    rows = stash(thin_rows(docs).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # size-weighted sample: a record is drawn with probability size * SAMPLE / all bytes, a larger one counts for as many draws
    draws = F.col("size") * F.lit(float(SAMPLE) / total.b)
    coin = F.pmod(F.xxhash64("doc_id", "key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.withColumn("times", F.when(draws >= 1, F.ceil(draws)).when(coin < draws, F.lit(1)).otherwise(F.lit(0)).cast("long")).filter("times > 0")
    cuts = ", ".join(str(i / RANGES) for i in range(1, RANGES))
    bounds = [int(x) for x in (sample.agg(F.expr(f"percentile(key, array({cuts}), times)").alias("q")).first().q or [0] * (RANGES - 1))]
    lo, hi = [-(1 << 63), *bounds], [*bounds, (1 << 63) - 1]
    edges = F.array(*[F.lit(x) for x in bounds])
    # the weight of a record is the larger of its shares in bytes and rows, so no cell has too much of either
    w = F.col("size") / F.lit(float(total.b)) + F.lit(1.0 / total.n)
    ranged = rows.withColumn("w", w).withColumn("range", F.size(F.filter(edges, lambda e: e < F.col("key"))))
    cells_wanted = max(RANGES, -(-total.n // CELL_ROWS))
    spans = [(r, float(lo[r]), max(1.0, float(hi[r]) - float(lo[r]))) for r in range(RANGES)]
    from .common import local_table

    limits = local_table(rows.sparkSession, spans, "range int, low double, span double")  # RANGES rows
    cut = (
        ranged.groupBy("range").agg(F.sum("w").alias("range_w"))
        .join(limits, "range").select("range", "low", "span", F.greatest(F.lit(1), F.ceil(F.col("range_w") / F.lit(2.0) * cells_wanted * 0.75)).alias("parts"))
    )
    most, few = 2.0 / max(HEAVY, 4 * cells_wanted), cells_wanted <= 65_536
    heavy = ranged.groupBy("range", "key").agg(F.sum("w").alias("key_w")).filter(F.col("key_w") > most)
    hot = stash(heavy.select("key", F.ceil(F.col("key_w") / F.lit(2.0) * cells_wanted).alias("dealt")), "shard-hot")  # at most max(HEAVY, 4 * cells_wanted) rows
    hot = F.broadcast(hot) if few else hot
    twins = ranged.join(hot, "key", "left_semi").groupBy("key", "doc_id").agg(F.sum("w").alias("id_w")).filter(F.col("id_w") > most)
    twins = twins.select(F.col("key").alias("k_"), F.col("doc_id").alias("i_"), F.ceil(F.col("id_w") / F.lit(2.0) * cells_wanted).alias("twins"))  # no more rows than hot has
    placed = (
        ranged.join(F.broadcast(cut), "range")  # RANGES rows
        .join(hot, "key", "left")
        .join(F.broadcast(twins) if few else twins, (F.col("key") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("i_")), "left")
        .withColumn("part", F.least(F.col("parts") - 1, F.greatest(F.lit(0), F.floor((F.col("key").cast("double") - F.col("low")) / F.col("span") * F.col("parts")))).cast("long"))
        # a hot key's rows come as (part, key, 1..dealt); the others of its part before and after it stay whole
        .withColumn("turn", F.when(F.col("dealt").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.col("dealt")) + 1).otherwise(F.lit(0)))
        .withColumn("hot_key", F.when(F.col("dealt").isNotNull(), F.col("key")))
        .withColumn("twin", F.when(F.col("twins").isNotNull(), F.col("doc_id")))
        .withColumn("copy", F.when(F.col("twins").isNotNull(), F.pmod(F.xxhash64("row"), F.col("twins")) + 1).otherwise(F.lit(0)))
        .select("doc_id", "size", "text_crc32", "key", "range", "part", "hot_key", "turn", "twin", "copy")
    )
    placed = stash(placed, "shard-placed")
    cell = ["range", "part", "hot_key", "turn", "twin", "copy"]
    before = Window.orderBy(*[F.col(c).asc_nulls_first() for c in cell]).rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    cells = placed.groupBy(*cell).agg(F.sum("size").alias("cb"), F.count("*").alias("cn"))
    starts = cells.select(*cell, F.coalesce(F.sum("cb").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("cn").over(before), F.lit(0)).alias("n0"))
    starts = starts.select(*[F.col(c).alias(f"{c}_") for c in cell], "b0", "n0")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) if c in ("hot_key", "twin") else F.col(c) == F.col(f"{c}_") for c in cell]
    keyed = placed.join(starts, functools.reduce(lambda x, y: x & y, same))
    order = Window.partitionBy(*cell).orderBy("key", "text_crc32", "doc_id")
    run = keyed.withColumn("at", F.col("b0") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.withColumn("no", F.col("n0") + F.row_number().over(order) - 1)
    group_at = F.min("at").over(Window.partitionBy(*cell, "key", "text_crc32"))
    first_byte = F.when(F.col("hot_key").isNull(), group_at).otherwise(F.col("at"))
    run = run.withColumn("shard", F.least(F.lit(shards - 1), F.floor(first_byte * F.lit(shards) / F.lit(total.b))).cast("int"))
    run = stash(run.select("doc_id", "size", "text_crc32", "shard", "no"), "shard-run")
    base = run.groupBy("shard").agg(F.min("no").alias("base"))  # one row a shard
    return run.join(F.broadcast(base), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("no") - F.col("base")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The records themselves, one Parquet folder a shard, in slot order within each file."""
    placed = shard_by_bytes(docs, shards).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot").dropDuplicates(["_id", "_crc"])
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    joined = docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.crc32(raw) == F.col("_crc"))).drop("_id", "_crc")
    joined.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8).withColumn("grown_shard", F.lit(None).cast("int"))


QUERIES = {"op4_sharding": op4_sharding}
SQL: dict[str, str] = {}
