"""FASTA and FASTQ files as DataFrames.

Files are cut at lines by Spark and read by many tasks (blocks.py); no row or window holds a file, and of a reference none holds a whole sequence. A block's
records are parsed from the state that the block before left (records.py); parts of what reaches over a block's end, a few rows a block, are put together
by key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.reads import prepare
from quillon.operators.seeds import STEP, Pieces

from .blocks import by_block, lines_of, scratch_path, written
from .records import MACHINES, OUT, passed_through

NO_BASE = re.compile("[^ACGTN]+")
ROWS, BYTES = 16_384, 8 << 20


def arrow_of(spark: SparkSession, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


# --- reference text ---

BLOCK = "file string, block long, size long, bytes long, headers long, full long, head long, tail long, first string, last string"
PIECE = "file_ord int, frag_ord long, no long, piece string"
NAME = "file_ord int, frag_ord long, ref_id string, len long"


class Text:
    """The bases of a block: a run that goes on with the fragment before, then runs that headers begin. ">" opens a header anywhere, even within another
    one, which it replaces; the line feed ends it. Only upper-case A, C, G, T, N are bases."""

    def __init__(self):
        self.name, self.run, self.size = None, [], 0

    def line(self, value: str):
        """The run that this line ends (name, bases), if it does."""
        at = value.find(">")
        self.add(value if at < 0 else value[:at])
        if at < 0:
            return None
        ended = self.ended()
        self.name, self.run, self.size = value[value.rindex(">") + 1 :], [], 0
        return ended

    def add(self, text: str) -> None:
        got = NO_BASE.sub("", text)
        if got:
            self.run.append(got)
            self.size += len(got)

    def ended(self):
        return self.name, "".join(self.run)


def block_runs(batches):
    """(file, size, block, bytes, runs): runs of a block in order, the first without a name. One block's bases are held at a time."""
    text, runs, n = Text(), [], 0
    for file, size, block, lines, ends in by_block(batches):
        for value in lines:
            n += len(value.encode()) + 1
            ended = text.line(value)
            if ended is not None:
                runs.append(ended)
        if ends:
            yield file, size, block, n, [*runs, text.ended()]
            text, runs, n = Text(), [], 0


def cut_run(start: int, size: int, closed: bool, step: int, before: int, after: int):
    """Pieces (no, from, to, whole) that a run of a fragment, at start, of that size, has part in; closed: the fragment ends with it."""
    if not size:
        return
    end = start + size
    for no in range(max(0, start - after) // step, (end - 1 + before) // step + 1):
        low, high = max(0, no * step - before), (no + 1) * step + after
        if no * step >= end and closed:  # the fragment has no bases of this piece's own
            continue
        a, b = max(low, start), min(high, end)
        if a < b:
            yield no, a, b, low >= start and (high <= end or closed)


class Reference:
    """The blocks of reference files put in order: entry of each block as (file_ord, fragment's number or the one it would get, its bases so far, whether there
    is a fragment, whether the block's last fragment has bases here or later, whether it ends with the block)."""

    def __init__(self, blocks: list):
        self.entries, file_ord = {}, 0
        for file in sorted({b.file for b in blocks}):
            own = sorted((b for b in blocks if b.file == file), key=lambda b: b.block)
            number, so_far, open_, state = 0, 0, False, []
            for b in own:
                state.append((number, so_far, open_))
                so_far += b.head if open_ else 0
                if b.headers:
                    number += (1 if open_ and so_far else 0) + b.full
                    so_far, open_ = b.tail, True
            later = False  # does the fragment that is open at the block's end get bases in a later one
            for b, (n, s, o) in zip(reversed(own), reversed(state)):
                here = b.tail > 0 if b.headers else o and s + b.head > 0
                self.entries[b.file, b.block] = (file_ord, n, s, o, here or later, not later)
                later = o and b.head > 0 or not b.headers and later
            file_ord += 1 if number or so_far else 0  # files without bases have no number

    @staticmethod
    def placed(entry, headers: int, runs):
        """(fragment, where the run starts in it, closed, name, bases) of a block's runs that lie in fragments."""
        _, number, so_far, open_, lives, ends = entry
        for i, (name, bases) in enumerate(runs):
            last = i == len(runs) - 1
            if i:
                open_, so_far = True, 0
            alive = (so_far + len(bases) > 0) if not last else lives
            if open_ and alive:
                yield number, so_far, (ends if last else True), name, bases
            if open_ and so_far + len(bases) > 0 and not last:
                number += 1


def read_pieces(spark: SparkSession, path: str, before: int, after: int, step: int | None = None) -> tuple[Pieces, DataFrame]:
    """(pieces of the text, file_ord frag_ord ref_id len of its fragments) of the .fa files at path (one file, or a folder and all below it), in path order.

    Text before a file's first header is dropped, and so are empty fragments. Each piece comes from one block, or from the few bases at the ends
    of the blocks that it reaches over, which the first pass keeps."""
    step = step or max(STEP, before, after)
    reach = step + before + after
    lines = lines_of(spark, path, ".fa")
    block_schema, piece_schema, name_schema = (arrow_of(spark, x) for x in (BLOCK, PIECE + ", at long, whole boolean", NAME))

    def summed(batches):
        import pyarrow as pa

        for file, size, block, n, runs in block_runs(batches):
            head, (_, tail) = runs[0][1], runs[-1] if len(runs) > 1 else (None, "")
            rest = tail if len(runs) > 1 else head[min(reach, len(head)) :]
            row = (file, block, size, n, len(runs) - 1, sum(1 for _, r in runs[1:-1] if r), len(head), len(tail), head[:reach], rest[-reach:])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, block_schema)], schema=block_schema)

    blocks = written(lines.mapInArrow(summed, BLOCK), "text-blocks")
    found = blocks.drop("first", "last").collect()  # a row a block
    entries = spark.sparkContext.broadcast(Reference(found).entries)
    placed = Reference.placed

    def rows(pieces):
        import pyarrow as pa

        held, size = [], 0
        for row in pieces:
            held.append(row)
            size += len(row[3])
            if len(held) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), piece_schema)], schema=piece_schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), piece_schema)], schema=piece_schema)

    def inner(batches):
        """Pieces that lie in one block."""

        def each():
            for file, _, block, _, runs in block_runs(batches):
                entry = entries.value[file, block]
                for frag, start, closed, _, bases in placed(entry, len(runs) - 1, runs):
                    for no, a, b, whole in cut_run(start, len(bases), closed, step, before, after):
                        if whole:
                            yield entry[0], frag, no, bases[a - start : b - start], a, True

        yield from rows(each())

    def border(batches):
        """Parts of the pieces that reach over the ends of blocks, from the blocks' first and last bases."""

        def each():
            for b in batches:
                for file, block, _, _, headers, full, head, tail, first, last in zip(*[c.to_pylist() for c in b.columns]):
                    entry = entries.value[file, block]
                    _, number, so_far, open_, lives, ends = entry
                    runs = []
                    if open_ and head:
                        runs.append((number, so_far, head, True if headers else ends, [(so_far, first)] + ([] if headers else [(so_far + head - len(last), last)])))
                    if headers and tail:
                        number += (1 if open_ and so_far + head else 0) + full
                        runs.append((number, 0, tail, ends, [(tail - len(last), last)]))
                    for frag, start, size, closed, kept in runs:
                        for no, a, z, whole in cut_run(start, size, closed, step, before, after):
                            for at, bases in kept:
                                x, y = max(a, at), min(z, at + len(bases))
                                if not whole and x < y:
                                    yield entry[0], frag, no, bases[x - at : y - at], x, False

        yield from rows(each())

    def names(batches):
        import pyarrow as pa

        for file, _, block, _, runs in block_runs(batches):
            entry = entries.value[file, block]
            held = [(entry[0], frag, name, len(bases)) for frag, _, _, name, bases in placed(entry, len(runs) - 1, runs)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), name_schema)], schema=name_schema)

    more = PIECE + ", at long, whole boolean"
    parts = blocks.mapInArrow(border, more)
    joined = parts.groupBy("file_ord", "frag_ord", "no").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("x"))  # a few parts a piece
    reached = F.array_max(F.transform("x", lambda v: v["at"] + F.length(v["piece"])))
    joined = joined.filter(reached > F.col("no") * step)  # else the fragment ended before the piece's own bases
    joined = joined.select("file_ord", "frag_ord", "no", F.array_join(F.transform("x", lambda v: v["piece"]), "").alias("piece"))
    whole = lines.mapInArrow(inner, more).select("file_ord", "frag_ord", "no", "piece")
    about = lines.mapInArrow(names, NAME).groupBy("file_ord", "frag_ord").agg(F.max("ref_id").alias("ref_id"), F.sum("len").alias("len"))
    return Pieces(whole.unionByName(joined), step, before, after), about


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """file_ord, frag_ord, ref_id, seq, len: whole fragments, for texts whose sequences fit a row; read_pieces is for any."""
    pieces, about = read_pieces(spark, path, 0, 0, 1 << 20)
    seq = pieces.rows.groupBy("file_ord", "frag_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "piece"))), lambda v: v["piece"]), "").alias("seq"))
    return seq.join(about, ["file_ord", "frag_ord"]).select("file_ord", "frag_ord", "ref_id", "seq", F.col("len").cast("int").alias("len"))


# --- reads ---

PASS = "file string, block long, size long, bytes long, started long, seen long, opens boolean, turns boolean, exit array<long>, parts array<struct<block:long,no:long,read_id:string,raw:string,plus:string,quality_raw:string,ends:boolean>>"
PART = ("block", "no", "read_id", "raw", "plus", "quality_raw", "ends")
READ = "read_ord long, read_id string, raw string, plus string, quality_raw string"


def sniff(spark: SparkSession, path: str) -> str:
    """fasta or fastq by the first character."""
    first = spark.read.option("lineSep", "\n").text(path).select(F.substring("value", 1, 1).alias("c")).limit(1).collect()  # the first line alone is read
    kind = {">": "fasta", "@": "fastq"}.get(first[0].c if first else "")
    if kind is None:
        raise ValueError("reads start with > or @")
    return kind


def read_reads(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """read_ord, read_id, raw, plus, quality_raw and what prepare() adds; read_ord counts through the files in path order."""
    kind = kind or sniff(spark, path)
    lines, machine = lines_of(spark, path), MACHINES[kind]
    outset = (OUT, 0, -1, -1)
    pass_schema, read_schema = arrow_of(spark, PASS), arrow_of(spark, READ)

    def blocks_of(batches, entries, unterminated):
        """(file, size, block, bytes, machine, whether the block ends) after each chunk of a block's lines, which are started in the block's entry state.
        unterminated: last blocks of files without a last line feed."""
        m, n, held = None, 0, None
        for file, size, block, values, ends in by_block(batches):
            m = m or machine(block, entries.get((file, block), outset))
            for value in values:
                if held is not None:
                    m.line(held, True)
                held = value
                n += len(value.encode()) + 1
            if ends:
                m.line(held, (file, block) not in unterminated)
                m.close()
            yield file, size, block, n, m, ends
            if ends:
                m, n, held = None, 0, None

    def look(entries, unterminated):
        given = spark.sparkContext.broadcast((entries, unterminated))

        def run(batches):
            import pyarrow as pa

            for file, size, block, n, m, ends in blocks_of(batches, *given.value):
                m.done.clear()
                if ends:
                    parts = [dict(zip(PART, p)) for p in m.parts]
                    row = (file, block, size, n, m.started, m.seen, m.opens, m.turns, list(m.state), parts)
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, pass_schema)], schema=pass_schema)

        return written(lines.mapInArrow(run, PASS), "read-blocks")

    entries, unterminated = {}, set()
    while True:
        table = look(entries, unterminated)
        rows = table.drop("parts").orderBy("file", "block").collect()  # a row a block
        chain, ends = in_order(rows, entries, outset)
        open_ended = {(f, r.block) for f, (n, r) in ends.items() if n > r.size}
        if chain == entries and open_ended == unterminated:
            break
        entries, unterminated = chain, open_ended

    # numbers of the first record of each block; a FASTQ record that its file's end cuts short does not count
    short = {tuple(r.exit)[2:] + (f,) for f, (_, r) in ends.items() if kind == "fastq" and r.exit[0] != OUT}
    first, total = {}, 0
    for r in rows:
        first[r.file, r.block] = total
        total += r.started - sum(1 for block, _, file in short if (file, block) == (r.file, r.block))
    given = spark.sparkContext.broadcast((entries, unterminated, first))

    def inner(batches):
        """Records that lie in one block."""
        import pyarrow as pa

        states, open_ended, first = given.value
        for file, _, block, _, m, _ in blocks_of(batches, states, open_ended):
            for i in range(0, len(m.done), ROWS):
                own = [(first[file, block] + no, *rest[:-1], rest[-1] if kind == "fastq" else None) for no, *rest in m.done[i : i + ROWS]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own), read_schema)], schema=read_schema)
            m.done.clear()

    starts = [(f, b, n) for (f, b), n in first.items()]
    where = spark.createDataFrame(starts, "file string, origin long, first long") if starts else spark.createDataFrame([], "file string, origin long, first long")
    parts = table.select("file", F.col("block").alias("at"), F.inline("parts")).withColumnRenamed("block", "origin").join(where, ["file", "origin"])
    in_turn = lambda c: F.array_join(F.transform("x", lambda v: v[c]), "")
    joined = parts.groupBy((F.col("first") + F.col("no")).alias("read_ord")).agg(  # a few parts a record
        F.max("read_id").alias("read_id"), F.max("plus").alias("plus"), F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("at", "raw", "quality_raw"))).alias("x")
    )
    quality = in_turn("quality_raw") if kind == "fastq" else F.lit(None).cast("string")
    joined = joined.filter("ends" if kind == "fastq" else "true").select("read_ord", "read_id", in_turn("raw").alias("raw"), "plus", quality.alias("quality_raw"))
    return prepare(lines.mapInArrow(inner, READ).unionByName(joined))


def in_order(rows, entries: dict, outset: tuple) -> tuple[dict, dict]:
    """(entry state of each block that does not begin in the outset state, (bytes, last block's row) of each file) by the blocks' exits, which hold for these
    entries; rows in the order of files and blocks."""
    chain, ends, state, file = {}, {}, outset, None
    for r in rows:
        if r.file != file:
            state, file = outset, r.file
        if state != outset:
            chain[r.file, r.block] = state
        known = entries.get((r.file, r.block), outset) == state
        state = tuple(r.exit) if known else passed_through(state, r.seen, r.opens, r.turns) or tuple(r.exit)
        ends[file] = (ends[file][0] if file in ends else 0) + r.bytes, r
    return chain, ends


def spooled(spark: SparkSession, stream) -> str:
    """The bytes of a stream as a file in the shared folder, a chunk at a time; its path."""
    path = scratch_path(spark, "spool")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        while chunk := stream.read(1 << 20):
            out.write(bytearray(chunk))
    finally:
        out.close()
    return path


def with_quality(reads: DataFrame, offset: int) -> DataFrame:
    """qual: the quality characters less the offset."""
    return reads.withColumn("qual", F.transform(F.filter(F.split("quality_raw", ""), lambda c: c != ""), lambda c: F.ascii(c) - offset))


def fastq_lines(reads: DataFrame, offset: int = 33) -> DataFrame:
    """read_ord, record: reads(read_ord, read_id, raw, qual) as FASTQ records of four lines; the id ends in the length."""
    quality = F.array_join(F.transform("qual", lambda x: F.char(x + offset)), "")
    head = F.concat(F.lit("@"), F.col("read_id"), F.lit(" length="), F.length("raw").cast("string"))
    return reads.select("read_ord", F.concat_ws("\n", head, F.col("raw"), F.lit("+"), quality).alias("record"))


def fasta_lines(reads: DataFrame) -> DataFrame:
    return reads.select("read_ord", F.concat_ws("\n", F.concat(F.lit(">"), F.col("read_id")), F.col("raw")).alias("record"))


def write_lines(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """FASTA or FASTQ files of records, in read order across the files."""
    records.orderBy("read_ord").select("record").write.mode(mode).text(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The report as tab-separated text without a header; scores to six significant digits."""
    score = F.when(F.col("score").isNull(), F.lit("")).otherwise(F.regexp_replace(F.format_string("%.6g", "score"), r"(\.\d*?)0+$|\.$", "$1"))
    report.withColumn("score", F.regexp_replace(score, r"\.$", "")).write.mode(mode).csv(path, sep="\t", quote="", emptyValue="", nullValue="")


def write_reads(reads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reads as Parquet partitioned by length and whether they hold N, so that scans prune what cannot be aligned."""
    reads.repartition("len", "has_n", F.floor(F.col("read_ord") / 1_000_000)).sortWithinPartitions("len", "has_n", "read_ord").write.mode(mode).partitionBy("len", "has_n").parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """What write_reads wrote; filters on len and has_n leave files unread."""
    return spark.read.parquet(path).withColumn("has_n", F.col("has_n").cast("boolean"))  # folder names are text
