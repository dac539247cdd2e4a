"""Places of the text whose seed may be near a read's: packed codes, a key filter, and rows for what passes it alone.

The text comes in pieces. A task packs the bases of many pieces to two bits and forms the quarter codes of all windows at once by doubling; each pair of
quarters gives a key. The reads' keys stand in a bitmap of FILTER_BITS a key (and of MOST_BITS at most, beyond which it lets more through), so that all but a few hundredths of the
windows go before any row of them exists; the rest become rows (pair, key) that carry their seed and the text around it, so that the text is never joined.

How many pairs are asked for depends on the allowed mismatches s, as each mismatch spoils one quarter: one pair is complete for s = 0, two disjoint ones
for s = 1, all six for s = 2.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.alphabet import PAIRS, code, quarters, reverse_complement

from .reads import usable
from .text import pieces

FILTER_BITS, MOST_BITS, STEP, FAN_IN = 64, 1 << 28, 4096, 32


def cover(mismatches: int) -> list[int]:
    """Numbers of quarter pairs of which one at least has no mismatch."""
    return {0: [0], 1: [0, 5]}.get(mismatches, list(range(6)))


@dataclass(frozen=True)
class Pieces:
    """Text as rows (file_ord, frag_ord, no, piece): a fragment's bases from no * step - before (at least 0) to (no + 1) * step + after."""

    rows: DataFrame
    step: int
    before: int
    after: int


def text_pieces(text: DataFrame | Pieces, before: int, after: int) -> Pieces:
    """Fragments as pieces with that much text around, dealt to all tasks however few files or fragments they come from; pieces stay as and where they are if
    they have enough."""
    if isinstance(text, Pieces):
        if text.before < before or text.after < after:
            raise ValueError(f"these reads need pieces with {before} bases before and {after} after")
        return text
    step = max(STEP, before, after)
    session = text.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return Pieces(pieces(text, step, after, before).repartition(tasks, "file_ord", "frag_ord", "no"), step, before, after)


@dataclass(frozen=True)
class Probes:
    """rows: each usable read on its strands under the keys of the cover (read_ord, len, strand, r_hi, r_lo, pair_idx, key); n: how many reads."""

    rows: DataFrame
    n: int
    longest: int
    filter: object
    bits: int


def seed_codes(seed, length: int):
    """(hi, lo): two longs of the seed's first and second half, two bits a base."""
    m = [code(x) for x in quarters(seed, length)]
    return F.shiftleft(m[0], length // 2).bitwiseOR(m[1]), F.shiftleft(m[2], length // 2).bitwiseOR(m[3])


def quarter_codes(hi, lo, length: int) -> list:
    low = F.lit((1 << length // 2) - 1)
    return [F.shiftrightunsigned(hi, length // 2), hi.bitwiseAND(low), F.shiftrightunsigned(lo, length // 2), lo.bitwiseAND(low)]


def positions(pair, key, bits: int):
    """Places in the bitmap of (pair, key), numpy arrays or a number and an array."""
    import numpy as np

    # fixed values: odd multipliers that mix the key's bits into the highest ones
    if not bits:
        return np.zeros(len(key), np.uint64)
    return ((key.astype(np.uint64) + np.asarray(pair).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def probe_rows(reads: DataFrame, length: int, mismatches: int, strands: str = "+-") -> DataFrame:
    """Each usable read on its strands under the keys of the cover: read_ord, len, strand, r_hi, r_lo, pair_idx, key."""
    good = usable(reads, length).select("read_ord", "seq", "len")
    flipped = F.substring(reverse_complement(F.col("seq")), F.col("len") - length + 1, F.lit(length))
    seeds = [F.struct(F.lit(s).alias("strand"), x.alias("seed")) for s, x in (("+", F.substring("seq", 1, length)), ("-", flipped)) if s in strands]
    both = good.select("read_ord", "len", F.inline(F.array(*seeds)))
    hi, lo = seed_codes(F.col("seed"), length)
    # inline once more: later columns read the two codes many times
    coded = both.select("read_ord", "len", "strand", F.inline(F.array(F.struct(hi.alias("r_hi"), lo.alias("r_lo")))))
    m = quarter_codes(F.col("r_hi"), F.col("r_lo"), length)
    keys = F.array(*[F.struct(F.lit(i).alias("pair_idx"), F.shiftleft(m[PAIRS[i][0]], length // 2).bitwiseOR(m[PAIRS[i][1]]).alias("key")) for i in cover(mismatches)])
    return coded.select("*", F.inline(keys))


def probes(reads: DataFrame, length: int, mismatches: int, strands: str = "+-") -> Probes:
    """Reads to search for; one pass counts them, one fills the bitmap of their keys."""
    counted = usable(reads, length).agg(F.count("*").alias("n"), F.coalesce(F.max("len"), F.lit(0)).alias("longest")).first()
    rows = probe_rows(reads, length, mismatches, strands)
    entries = counted.n * len(strands) * len(cover(mismatches))
    bits = (min(MOST_BITS, max(1 << 16, FILTER_BITS * entries)) - 1).bit_length()
    return Probes(rows, counted.n, counted.longest, key_filter(rows, bits), bits)


def key_filter(rows: DataFrame, bits: int):
    """The bitmap of 2^bits bits in which the rows' (pair, key) are set; made in the tasks and merged in a tree."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = positions(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(found, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["map"])

    parts = rows.select("pair_idx", "key").mapInArrow(run, "map binary").rdd.map(lambda r: np.frombuffer(r.map, np.uint8))
    both = lambda a, b: b if a is None else a if b is None else a | b
    found = parts.treeAggregate(None, both, both, max(2, math.ceil(math.log(max(2, parts.getNumPartitions()), FAN_IN))))
    return np.zeros((1 << bits) // 8, np.uint8) if found is None else found


def window_codes(flat, q: int):
    """(codes of the q bases from each place on, how many bases are no A, C, G, T before each place) of an array of letters; bases beyond the end count as A."""
    import numpy as np

    letter = np.full(256, 4, np.uint8)
    letter[[ord(c) for c in "ACGT"]] = np.arange(4)
    base = letter[flat]
    unknown = np.concatenate([[0], np.cumsum(base == 4)])
    one = (base & 3).astype(np.uint64)
    ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), np.uint64)])
    total, have, power, width = np.zeros(len(flat), np.uint64), 0, one, 1
    while width <= q:  # codes of 1, 2, 4 ... bases; those that make up q are put together
        if q & width:
            total, have = (total << np.uint64(2 * width)) | ahead(power, have), have + width
        power, width = (power << np.uint64(2 * width)) | ahead(power, width), 2 * width
    return total, unknown


class Windows:
    """Windows of many pieces at once: what passes the filter, with its seed and the text around it."""

    def __init__(self, length: int, pairs: list[int], bitmap, bits: int, step: int, before: int, around: tuple[int, int]):
        self.length, self.pairs, self.bitmap, self.bits, self.step, self.before, self.around = length, pairs, bitmap, bits, step, before, around

    def found(self, column, no):
        """(piece, place in the fragment, pair, key, hi, lo, place of the window in its text, starts and sizes of the texts, letters)."""
        import numpy as np

        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        starts, sizes = ends[:-1], np.diff(ends)
        lead = np.minimum(self.before, no * self.step)
        n, q = self.length, self.length // 4
        quarter, unknown = window_codes(flat, q)
        # windows that begin in the piece's own bases, end in it and hold no unknown base
        own = np.clip(np.minimum(self.step, sizes - lead - (n - 1)), 0, None)
        first = starts + lead
        which = np.repeat(np.arange(len(sizes)), own)
        at = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        good = unknown[at + n] == unknown[at]
        which, at = which[good], at[good]
        m = [quarter[at + j * q] for j in range(4)]
        shift = np.uint64(2 * q)
        out = []
        for i in self.pairs:
            a, b = PAIRS[i]
            key = (m[a] << shift) | m[b]
            bit = positions(i, key, self.bits)
            hit = np.flatnonzero((self.bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
            out.append((hit, np.full(len(hit), i, np.int32), key[hit].view(np.int64)))
        hit, pair, key = (np.concatenate(x) for x in zip(*out))
        hi, lo = ((m[k][hit] << shift) | m[k + 1][hit] for k in (0, 2))
        which, at = which[hit], at[hit]
        left = np.maximum(at - self.around[0], starts[which])
        right = np.minimum(at + n + self.around[1], ends[1:][which])
        place = at - first[which] + no[which] * self.step
        return which, place, pair, key, hi.view(np.int64), lo.view(np.int64), at - left, left, right - left, flat


def slices(batches, size: int = 1 << 20):
    """Batches in parts of about that many bytes of their last column, so that the codes of a part's windows are bounded."""
    for whole in batches:
        n = max(1, size * len(whole) // max(1, whole.column(whole.num_columns - 1).nbytes))
        for i in range(0, len(whole), n):
            yield whole[i : i + n]


def candidates(text: Pieces, p: Probes, length: int, mismatches: int, around: tuple[int, int]) -> DataFrame:
    """Windows whose key is some probe's, as far as the bitmap tells: file_ord, frag_ord, at (of the window), pair_idx, key, hi, lo, lead, near (text from
    `lead` bases before the window on; around: how many bases before and after it)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = text.rows.select("file_ord", "frag_ord", F.col("no").cast("long").alias("no"), "piece")
    spark, kind = rows.sparkSession, dict(rows.dtypes)
    ddl = f"file_ord {kind['file_ord']}, frag_ord {kind['frag_ord']}, at long, pair_idx int, key long, hi long, lo long, lead int, near string"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    given = spark.sparkContext.broadcast((length, cover(mismatches), p.filter, p.bits, text.step, text.before, around))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        windows = Windows(*given.value)
        for b in slices(batches):
            which, place, pair, key, hi, lo, lead, left, size, flat = windows.found(b.column(3).cast(pa.large_string()), b.column(2).to_numpy())
            for i in range(0, len(which), 1 << 14):
                own = slice(i, i + (1 << 14))
                s = size[own]
                ends = np.concatenate([[0], np.cumsum(s)])
                near = flat[np.repeat(left[own] - ends[:-1], s) + np.arange(int(ends[-1]))]
                texts = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(near))
                index = pa.array(which[own])
                columns = [b.column(0).take(index), b.column(1).take(index), *map(pa.array, (place[own], pair[own], key[own], hi[own], lo[own], lead[own].astype(np.int32))), texts]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def agreeing(length: int) -> list:
    """Whether the seeds (hi, lo) and (r_hi, r_lo) agree in each of the four quarters."""
    x = quarter_codes(F.col("hi").bitwiseXOR(F.col("r_hi")), F.col("lo").bitwiseXOR(F.col("r_lo")), length)
    return [c == 0 for c in x]


def seed_hits(text: Pieces, p: Probes, length: int, mismatches: int, around: tuple[int, int], broadcast_reads: int) -> DataFrame:
    """Each place near a read's seed once: read_ord, len, strand, file_ord, frag_ord, at, seed_k, pairs (all that agree), lead, near.

    What the filter let through by chance goes here, and of the pairs that agree the first alone keeps the place. Probes of up to broadcast_reads reads are
    broadcast, so that the text's rows stay where they are; beyond that both sides shuffle by key."""
    found = candidates(text, p, length, mismatches, around)
    met = found.join(F.broadcast(p.rows) if p.n <= broadcast_reads else p.rows, ["pair_idx", "key"])
    return near_seeds(met, length, mismatches).select("read_ord", "len", "strand", "file_ord", "frag_ord", "at", "seed_k", "pairs", "lead", "near")


def near_seeds(met: DataFrame, length: int, mismatches: int) -> DataFrame:
    """Of windows that met probes under a key, those within the seed's bound, each once, with seed_k and pairs."""
    same = agreeing(length)
    pairs = F.array_compact(F.array(*[F.when(same[a] & same[b], F.lit(i)) for i, (a, b) in enumerate(PAIRS)]))
    odd = F.lit(0x5555555555555555)
    apart = lambda x, y: (lambda d: F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(odd)))(x.bitwiseXOR(y))
    met = met.withColumn("seed_k", (apart(F.col("hi"), F.col("r_hi")) + apart(F.col("lo"), F.col("r_lo"))).cast("int")).filter(F.col("seed_k") <= mismatches)
    first = F.coalesce(*[F.when(same[PAIRS[i][0]] & same[PAIRS[i][1]], F.lit(i)) for i in cover(mismatches)])
    return met.filter(first == F.col("pair_idx")).withColumn("pairs", pairs).drop("pair_idx", "key", "hi", "lo", "r_hi", "r_lo")
