"""Operator 9: token-id output in patched frame-of-reference segments (format: pfor.py).

Documents are range-partitioned and sorted by doc_id (equal ids by a checksum of their text), so one shuffle of the texts gives the file
order. Each task encodes its documents and appends their ids to segments of about SEGMENT ids; a segment is one row of a Parquet folder
(part, seg, documents with their lengths, payload), which Spark's committer publishes whole, lost executors or not. Offsets come from
the segments' sizes: a running sum over the parts, then one within each part. Reading decodes segments independently.

The encoder works on groups of texts of about GROUP_BYTES: ids of a word never depend on its neighbours beyond a space, so the group's distinct words
are found first (Arrow's dictionary encoding), encoded once by the tokenizers library, and their ids gathered by word number. What a
worker remembers of words between groups is bounded by CACHE_BYTES.

Defined results: a null text is an empty one and has the end id alone; a null doc_id comes first; repeated rows are written as often as
they come; an empty table gives no segments and an empty result; other columns are ignored. A very long text is encoded whole in one task and
makes a segment of its own; a segment holds less than 4 GiB. Documents of equal doc_id and equal text are interchangeable.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .common import arrow_schema, grouped, scratch_path, small_batches, spread, table, texts

SEGMENT, GROUP_BYTES, CACHE_BYTES, BROADCAST_SEGMENTS, END_ID = 1 << 20, 8 << 20, 96 << 20, 1_000_000, 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Whole-text ids of a tokenizer that drops white space, through the distinct words of a group of texts.

    Spaces and line feeds part words. A word of Latin-1 letters, digits and ASCII marks (no apostrophe) falls into runs of letters, single
    digits and runs of marks, as the tokenizer would part it, and each run is one string for the tokenizer's model; other words take
    its whole course, many at a time with a special token between them. Texts with such a token's string go to the library as they are.
    """

    MARK = "<|endoftext|>"
    PLAIN = re.compile("[a-z0-9!-&(-/:-@\\[-`{-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.token_to_id(self.MARK)
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0
        # the byte-level letters of Latin-1 letters' two bytes; plain words use those and ASCII alone
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        letter = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.letters = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
        # held against the library itself: a tokenizer that parts plain words otherwise takes its whole course
        tried = ["a", "word", "\u00e9t\u00e9", "na\u00efve\u00df", "\u00f1\u00ff", "\u00c9a,b.12..x-"]
        self.plain = self.mark is not None and all(b"".join(map(self.run_ids, self.RUNS.findall(w.lower()))) == self.ids(w).tobytes() for w in tried)

    def run_ids(self, run: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(run if run.isascii() else run.translate(self.letters))]).tobytes()

    @classmethod
    def of_process(cls, path: str):
        """One encoder a worker process: the memory of words outlives a task."""
        import sys
        import types

        kept = sys.modules.setdefault("quillon_worker_state", types.ModuleType("quillon_worker_state")).__dict__
        return kept.setdefault(("words", path), cls(path)) if ("words", path) not in kept else kept["words", path]

    def ids(self, text: str):
        """Ids of one string, as the library gives them."""
        import numpy as np

        some = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return np.array(some([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words that are not plain."""
        import numpy as np

        alone = [w for w in words if "<|" in w or self.mark is None]
        for w in alone:
            self.known[w] = self.ids(w).tobytes()
        joint = [w for w in words if "<|" not in w] if self.mark is not None else []
        for i in range(0, len(joint), 1024):
            part = joint[i : i + 1024]
            ids = self.ids(f" {self.MARK} ".join(part))
            raw, cut = ids.tobytes(), (np.flatnonzero(ids == self.mark) * 4).tolist()
            if len(cut) != len(part) - 1:
                raise ValueError("a word without the mark gave the mark's id")
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *(c + 4 for c in cut)], [*cut, len(raw)]))

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (distinct ones); CACHE_BYTES bounds what is remembered of them."""
        if self.held > CACHE_BYTES:
            self.known, self.held = {"": b""}, 0
        plain, runs, known, run_ids, other = self.PLAIN.fullmatch, self.RUNS.findall, self.known, self.run_ids, []
        new = [w for w in words if w not in known]
        for w in new:  # nothing but bytes is kept, so the garbage collector has nothing to look at
            if not self.plain or not plain(w) or "<|" in w:
                other.append(w)
                continue
            ids = b""
            for run in runs(w if w.isascii() else w.lower()):
                one = known.get(run)
                if one is None:
                    one = known[run] = run_ids(run)
                    self.held += 150 + len(run)
                ids = ids + one if ids else one
            known[w] = ids
        self.learn(other)
        self.held += sum(map(len, new)) + 150 * len(new)
        return list(map(known.__getitem__, words))

    def encode(self, texts, end_id: int):
        """(ids of all texts on end, each closed by end_id; sizes) of an Arrow array of strings."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        alone = {int(i): self.ids(texts[int(i)].as_py()) for i in special}
        if alone:
            texts = pc.if_else(pc.match_substring(texts, "<|"), "", texts)
        words = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        ends, flat = words.offsets.to_numpy()[1:] - words.offsets[0].as_py(), words.flatten().dictionary_encode()
        found = self.of_words(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        found.append(np.array([end_id], "<u4").tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        codes = np.insert(flat.indices.to_numpy(), ends, len(found) - 1)
        at = np.cumsum(sizes[codes])
        stops = at[ends + np.arange(len(ends))] if len(ends) else np.zeros(0, np.int64)
        ids, n = pool[spread(np.cumsum(sizes) - sizes, sizes, codes)], np.diff(stops, prepend=0)
        if alone:
            runs = np.split(ids, stops[:-1])
            for i, a in alone.items():
                runs[i] = np.concatenate([a, runs[i]])
                n[i] = len(runs[i])
            ids = np.concatenate(runs)
        return ids, n


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encode docs(doc_id, text) in ascending doc_id order and write the segments under path."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs).withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("crc")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc").select("doc_id", "text")

    schema = arrow_schema(SEGMENTS.format(id_type))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, seg = WordEncoder.of_process(tokenizer), TaskContext.get().partitionId(), 0
        ids, docs_in, sizes, held = [], [], [], 0

        def flush():
            columns = [[part], [seg], [held], [docs_in], [np.concatenate(sizes)], [pfor.encode(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in grouped(batches, 1, GROUP_BYTES):
            found, n = encoder.encode(b.column(1), end_id)
            names, stops, at = b.column(0).to_pylist(), np.cumsum(n), 0
            while at < len(n):
                # documents up to the one that fills the segment
                to = min(len(n), int(np.searchsorted(stops, (stops[at - 1] if at else 0) + segment - held)) + 1)
                first = int(stops[at - 1]) if at else 0
                ids.append(found[first : stops[to - 1]])
                docs_in += names[at:to]
                sizes.append(n[at:to])
                held, at = held + int(stops[to - 1]) - first, to
                if held >= segment:
                    yield flush()
                    ids, docs_in, sizes, held, seg = [], [], [], 0, seg + 1
        if docs_in:
            yield flush()

    ordered.mapInArrow(run, SEGMENTS.format(id_type)).write.parquet(path)


SEGMENTS = "part int, seg int, n_ids long, doc_ids array<{}>, sizes array<long>, payload binary"


def with_starts(segments: DataFrame) -> DataFrame:
    """Each segment with the number of ids before it; at most one row a part meets in a task, then one part."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("part", "seg", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    within = sizes.select("part", "seg", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seg"))), F.lit(0)).alias("seg_start"))
    starts = within.join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("start"))
    # one row a segment: broadcast up to BROADCAST_SEGMENTS of them, so that payloads stay where they are read
    few = sizes.count() <= BROADCAST_SEGMENTS
    return segments.join(F.broadcast(starts) if few else starts, ["part", "seg"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the segments under path: doc_id, start, n_tokens, ids (little-endian 32-bit integers)."""
    segments = with_starts(spark.read.parquet(path)).select("start", "doc_ids", "sizes", "payload")
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()
    out = f"doc_id {id_type}, start long, n_tokens long, ids binary"

    schema = arrow_schema(out)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for start, docs, sizes, payload in zip(*[c.to_pylist() for c in b.columns]):
                raw = pfor.decode(payload).astype("<u4", copy=False)
                ends = np.cumsum(sizes)
                first = ends - sizes
                ids = [raw[i:j].tobytes() for i, j in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([docs, first + start, sizes, ids], schema)], schema=schema)

    small_batches(spark)
    return segments.mapInArrow(run, out)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_token_output": op9_token_output}
SQL: dict[str, str] = {}
