"""Operator 12: byte-level BPE by ranks, each distinct word encoded once in the whole corpus; and decoding.

1. Cut. A task joins its texts to blocks of about BLOCK_BYTES and explodes each into pre-tokens (matches of the pattern). A block keeps its documents as
   the pre-tokens' numbers by position, and its distinct words. A pre-token that is itself a token has that token's rank for number; the others are
   dealt to buckets by a hash of their bytes and numbered within the block by bucket. Blocks are written to the shared folder as a table bucketed by
   block: nothing is cut twice, an executor may go, and the documents' numbers are never shuffled.
2. Encode. Packed words shuffle by bucket. A task finds the distinct words of the rows it holds (up to ENCODE_BYTES, so that an ordinary shuffle
   partition is one go) and merges each once. Words are merged side by side: a matrix of symbols, each round one merge a word, that of the least rank.
3. Join back. Packed ids shuffle to their block, where each document is reassembled by position.

A word is one entry a block however often it occurs, so a hot word is as many entries as there are blocks. There are as many buckets as shuffle
partitions; with very many of them a row of (block, bucket) comes down to a few words, as in a plain shuffle of words.

Texts part before each run of white space and after each run of ASCII letters that an ASCII character follows. No match of the pattern crosses such a
place or looks behind it, so the pattern runs on the distinct parts alone; another pattern must have this property.

Decoding joins ids with the token-byte table in the tasks; the table is a vocabulary's, whose size is checked (TABLE_BYTES), and is broadcast.

Defined results: a null text is an empty one and has no ids; rows come back as often as they are, null doc_ids too; an empty table gives
an empty result; other columns are ignored. A very long text is a block of its own and is cut in one task; only its ids are as large. A document with an
id that the table lacks, or with null ids, decodes to null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bucketed, grouped, small_batches, spread, table, texts

BLOCK_BYTES, ENCODE_BYTES, TABLE_BYTES, SIDE_BY_SIDE = 8 << 20, 8 << 20, 64 << 20, 64
NO_RANK = (1 << 31) - 1


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines (token in base64, rank); read on the driver. All single bytes are tokens."""
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if sum(map(len, ranks)) > TABLE_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    return ranks


class Merges:
    """Ids of words by the ranks: again and again the adjacent pair whose bytes together have the least rank, the leftmost of equals, becomes one token."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks, self.byte = ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:i]] << 32 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs
        self.first = self.lookup(self.byte[:, None], self.byte[None, :])  # of two single bytes

    def lookup(self, left, right):
        """The rank of each pair's bytes together, NO_RANK where they are no token."""
        import numpy as np

        key = left.astype(np.int64) << 32 | right
        if not len(self.keys):
            return np.full(key.shape, NO_RANK, np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], np.int32(NO_RANK))

    def side_by_side(self, flat, starts, sizes):
        """A matrix of ids of words given as runs of one array of bytes, a row a word; -1 where there is none. Symbols stay in their columns; each knows
        the next and the one before."""
        import numpy as np

        w, width = len(sizes), int(sizes.max())
        place = np.arange(width)
        raw = flat[np.minimum(starts[:, None] + place, len(flat) - 1)]
        inside = place < sizes[:, None]
        ids, rank = np.where(inside, self.byte[raw], np.int32(-1)), np.full((w, width), NO_RANK, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.first[raw[:, :-1], raw[:, 1:]], np.int32(NO_RANK))
        after, before = np.empty((w, width + 1), np.int16), np.empty((w, width + 1), np.int16)
        after[:, :], before[:, :] = np.arange(1, width + 2), np.arange(-1, width)
        after[np.arange(w), sizes - 1] = width
        live = np.arange(w)
        while len(live):
            at = rank[live].argmin(1)
            least = rank[live, at]
            go = least != NO_RANK
            k, at, least = live[go], at[go], least[go]
            gone = after[k, at]
            right = after[k, gone]
            ids[k, at], ids[k, gone], rank[k, gone], after[k, at], before[k, right] = least, -1, NO_RANK, right, at
            some = right < width
            rank[k, at] = NO_RANK
            rank[k[some], at[some]] = self.lookup(least[some], ids[k[some], right[some]])
            left = before[k, at]
            some = left >= 0
            rank[k[some], left[some]] = self.lookup(ids[k[some], left[some]], least[some])
            live = k
        return ids

    def one(self, word: bytes) -> list[int]:
        """Ids of one long word, by a heap of pairs: n log n in its length."""
        import heapq

        ids, n = [self.ranks[bytes([b])] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:  # one of the two has merged since
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (q := self.pairs.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (q, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def encode(self, flat, starts, sizes):
        """(ids of all words on end as 32-bit integers, how many each has) of words given as runs of one array of bytes."""
        import numpy as np

        w = len(sizes)
        n, found = np.zeros(w, np.int64), []
        for low, high in ((0, 8), (8, 16), (16, 32), (32, SIDE_BY_SIDE)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.split(own, range(1 << 16, len(own), 1 << 16)) if len(own) else []:
                ids = self.side_by_side(flat, starts[part], sizes[part])
                n[part] = (ids >= 0).sum(1)
                found.append((part, ids[ids >= 0]))
        for i in np.flatnonzero(sizes > SIDE_BY_SIDE).tolist():
            ids = np.array(self.one(flat[starts[i] : starts[i] + sizes[i]].tobytes()), np.int64)
            n[i] = len(ids)
            found.append((np.array([i]), ids))
        out, at = np.zeros(int(n.sum()), "<u4"), np.cumsum(n) - n
        for part, ids in found:
            out[spread(at, n, part)] = ids
        return out, n


def runs_of(column):
    """(bytes of all strings on end, starts, sizes) of an Arrow array of strings or binaries without nulls."""
    import numpy as np
    import pyarrow as pa

    kind = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(kind)
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, ends[:-1], np.diff(ends)


def part_starts(flat):
    """Places that no pre-token crosses: where white space follows something else, and where an ASCII letter is followed by an ASCII character that is no
    letter. Only ASCII white space is looked for; a character before it that may be white space itself makes no such place, which leaves a longer part."""
    import numpy as np

    kind = np.zeros(256, np.uint8)  # 0: other ASCII; 1: letter; 2: white space; 3: control; 4: beyond ASCII
    kind[128:], kind[:33] = 4, 3
    kind[[9, 10, 11, 12, 13, 32]], kind[65:91], kind[97:123] = 2, 1, 1
    apart = np.zeros((5, 5), bool)
    apart[[0, 1, 4], 2] = True
    apart[1, [0, 3]] = True
    of = kind[flat]
    at = np.flatnonzero(apart.reshape(-1)[of[:-1] * np.uint8(5) + of[1:]]) + 1
    wide = np.flatnonzero(of[at - 1] == 4)
    x, y, z = (np.where(at[wide] >= k, flat[np.maximum(at[wide] - k, 0)], 0) for k in (3, 2, 1))
    space = (y == 0xC2) & ((z == 0x85) | (z == 0xA0)) | (x == 0xE2) & ((y == 0x80) | (y == 0x81)) | (x == 0xE1) & (y == 0x9A) | (x == 0xE3) & (y == 0x80)
    return np.delete(at, wide[space])


class Cutter:
    """Blocks of texts as numbers of pre-tokens; a token's number is its rank."""

    #: Parts that are one pre-token by any pattern that joins letters and the space before them; told without running it.
    PLAIN = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, ranks: dict[bytes, int], cut: str, buckets: int):
        import numpy as np
        import pyarrow as pa
        import regex

        self.find, self.buckets, self.tokens = regex.compile(cut).findall, buckets, pa.array(list(ranks), pa.large_binary())
        self.rank_of = np.array(list(ranks.values()) or [0], np.int64)
        self.beyond = int(self.rank_of.max()) + 1
        tried = ["word", " word", " \u00e9t\u00e9\u00c0\u00ff", "aZ"]
        self.plain = all(self.find(t) == [t] for t in tried)

    def words_of(self, parts):
        """(words of distinct parts in some order, where each part's words begin, how many they are)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.match_substring_regex(parts, self.PLAIN) if self.plain else pa.array(np.zeros(len(parts), bool))
        plain = whole.to_numpy(zero_copy_only=False)
        cut = list(map(self.find, parts.filter(pc.invert(whole)).to_pylist()))
        size, start = np.ones(len(parts), np.int64), np.zeros(len(parts), np.int64)
        size[~plain] = np.fromiter(map(len, cut), np.int64, len(cut))
        start[plain] = np.arange(int(plain.sum()))
        start[~plain] = plain.sum() + np.cumsum(size[~plain]) - size[~plain]
        return pa.concat_arrays([parts.filter(whole), pa.array([w for c in cut for w in c], pa.large_string())]), start, size

    def block(self, column):
        """(numbers of all texts on end, how many each has, words, of buckets) of an Arrow array of strings. words are those that are no tokens, by
        bucket: word i has number beyond + i, and buckets[b] is where bucket b begins."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat, starts, sizes = runs_of(pc.fill_null(column, ""))
        first, last = (int(starts[0]), int(starts[-1] + sizes[-1])) if len(starts) else (0, 0)
        flat, starts = flat[first:last], starts - first
        begins = np.zeros(len(flat) + 1, bool)
        begins[part_starts(flat)] = True
        begins[starts] = True
        begins[len(flat)] = False
        at = np.flatnonzero(begins)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(flat)).astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
        found, start, size = self.words_of(parts.dictionary.cast(pa.large_string()))
        words = found.cast(pa.large_binary()).dictionary_encode()
        known = pc.index_in(words.dictionary, value_set=self.tokens)
        missing = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        other = words.dictionary.take(pa.array(missing))
        bucket = bucket_of(other, self.buckets)
        order = pc.sort_indices(pa.table({"b": bucket, "w": other}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
        number = self.rank_of[known.fill_null(0).to_numpy()]
        number[missing[order]] = self.beyond + np.arange(len(order))
        codes = parts.indices.to_numpy()
        numbers = number[words.indices.to_numpy()][spread(start, size, codes)].astype("<u4") if len(codes) else np.zeros(0, "<u4")
        stop = np.concatenate([[0], np.cumsum(size[codes])])[np.searchsorted(at, starts + sizes)]
        return numbers, np.diff(stop, prepend=0), other.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(self.buckets + 1))


def bucket_of(words, buckets: int):
    """A bucket for each of an Arrow array of words, by their bytes alone: bytes times odd numbers of their places, summed in 64 bits."""
    import numpy as np

    flat, starts, sizes = runs_of(words)
    if not len(sizes):
        return np.zeros(0, np.int32)
    place = spread(np.zeros(len(sizes), np.int64), sizes, np.arange(len(sizes))).astype(np.uint64)
    x = place + np.uint64(1)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):  # fixed values: multipliers that mix the places' bits
        x = (x ^ (x >> np.uint64(29))) * np.uint64(by)
    terms = (flat[int(starts[0]) : int(starts[-1] + sizes[-1])].astype(np.uint64) + np.uint64(1)) * (x | np.uint64(1))
    sums = np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)
    return ((sums >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def packed(numbers) -> bytes:
    """32-bit integers, byte plane by byte plane, compressed."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(np.frombuffer(numbers.tobytes(), np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(payload: bytes, n: int):
    import numpy as np
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(payload, n * 4, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4")


def of_process(key, make):
    """What a worker process builds once and keeps between tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("quillon_worker_state", types.ModuleType("quillon_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def pack_words(words) -> bytes:
    """An Arrow array of binaries: how many, their sizes, their bytes; compressed."""
    import numpy as np
    import pyarrow as pa

    flat, starts, sizes = runs_of(words)
    body = sizes.astype("<u4").tobytes() + flat[int(starts[0]) : int(starts[-1] + sizes[-1])].tobytes()
    return np.array([len(sizes), len(body)], "<u8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack_words(payload: bytes):
    import numpy as np
    import pyarrow as pa

    n, size = np.frombuffer(payload, "<u8", 2).tolist()
    body = pa.decompress(payload[16:], size, codec="zstd")
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(body, "<u4", n).astype(np.int64))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), body.slice(4 * n)])


BLOCKS = "block long, bucket int, doc_ids array<{}>, sizes array<int>, payload binary"


def cut_blocks(docs: DataFrame, path: str, cut: str) -> DataFrame:
    """Step 1, written: a row a bucket of a block (block, bucket, payload: words), and a row a block (block, doc_ids, sizes, payload: numbers by position)."""
    spark = docs.sparkSession
    ranks, buckets = spark.sparkContext.broadcast(read_ranks(path)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema(ddl := BLOCKS.format(docs.schema["doc_id"].dataType.simpleString()))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cutter = of_process(("cut", path, cut, buckets), lambda: Cutter(ranks.value, cut, buckets))
        for k, b in enumerate(grouped(batches, 1, BLOCK_BYTES)):
            block = TaskContext.get().partitionId() << 32 | k
            numbers, sizes, words, at = cutter.block(b.column(1))
            own = np.flatnonzero(np.diff(at)).tolist()
            n = len(own)
            row = [[block] * (n + 1), [*own, -1], [None] * n + [b.column(0).to_pylist()], [None] * n + [sizes.astype(np.int32)], [*(pack_words(words[at[i] : at[i + 1]]) for i in own), packed(numbers)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    return bucketed(texts(docs).mapInArrow(run, ddl), "bpe-blocks", "block", buckets)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Step 2: words(block, bucket, payload) with their ids for payload (sizes, then ids)."""
    spark = words.sparkSession
    ranks, buckets = spark.sparkContext.broadcast(read_ranks(path)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = words.select("block", "bucket", "payload").repartitionById(buckets, "bucket")
    schema = arrow_schema(ddl := "block long, bucket int, n_words int, n_ids int, sizes binary, ids binary")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        merges = of_process(("merges", path), lambda: Merges(ranks.value))

        def coded(held, names):
            all_words = pa.concat_arrays(held).dictionary_encode()
            ids, n = merges.encode(*runs_of(all_words.dictionary))
            at, codes = np.cumsum(n) - n, all_words.indices.to_numpy()
            own, size = ids[spread(at, n, codes)], n[codes].astype("<u4")
            ends = np.concatenate([[0], np.cumsum([len(h) for h in held])])
            upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends]
            columns = [[x for x, _ in names], [x for _, x in names], np.diff(ends), np.diff(upto), [packed(size[i:j]) for i, j in zip(ends, ends[1:])], [packed(own[i:j]) for i, j in zip(upto, upto[1:])]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        held, names, size = [], [], 0
        for b in batches:
            for block, bucket, payload in zip(*[c.to_pylist() for c in b.columns]):
                held.append(unpack_words(payload))
                names.append((block, bucket))
                size += held[-1].nbytes
                if size >= ENCODE_BYTES:
                    yield coded(held, names)
                    held, names, size = [], [], 0
        if held:
            yield coded(held, names)

    return rows.mapInArrow(run, ddl)


def encode_docs(docs: DataFrame, path: str, cut: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit integers) of docs(doc_id, text), by the ranks in the file at path and the pattern of pre-tokens."""
    blocks = cut_blocks(docs, path, cut or pattern())
    beyond = max(read_ranks(path).values(), default=0) + 1
    coded = encode_words(blocks.filter("bucket >= 0"), path)
    schema = arrow_schema(ddl := f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")

    def assemble(left, right):
        """The documents of one block: numbers become ids, ranks themselves and words by what came back."""
        import numpy as np
        import pyarrow as pa

        doc_ids, sizes, payload = (left.column(c)[0] for c in ("doc_ids", "sizes", "payload"))
        sizes = np.array(sizes.as_py(), np.int64)
        numbers = unpacked(payload.as_py(), int(sizes.sum()))
        right = right.sort_by("bucket")
        back = lambda c, of: np.concatenate([np.zeros(0, "<u4"), *(unpacked(x, n) for x, n in zip(right.column(c).to_pylist(), right.column(of).to_pylist()))])
        n, ids = back("sizes", "n_words").astype(np.int64), back("ids", "n_ids")
        # the ranks first, each its own id, then the words in the order of their numbers
        count = np.concatenate([np.ones(beyond, np.int64), n])
        start = np.concatenate([np.arange(beyond), beyond + np.cumsum(n) - n])
        found = np.concatenate([np.arange(beyond, dtype="<u4"), ids])[spread(start, count, numbers)]
        upto = np.concatenate([[0], np.cumsum(count[numbers])])[np.concatenate([[0], np.cumsum(sizes)])]
        raw = [found[i:j].tobytes() for i, j in zip(upto, upto[1:])]
        return pa.table([pa.array(doc_ids.as_py(), schema.field(0).type), pa.array(raw, pa.binary())], schema=schema)

    kept = blocks.filter("bucket < 0").select("block", "doc_ids", "sizes", "payload")
    return kept.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, ddl)


def decode_docs(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) with decoded (binary): the bytes of the ids, joined with the token-byte table."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = encoded.select("doc_id", "ids")
    schema = arrow_schema(ddl := f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def bytes_of_ids():
            size = np.full(max(ranks.value.values(), default=0) + 1, -1, np.int64)
            by_rank = sorted(ranks.value, key=ranks.value.get)
            size[[ranks.value[t] for t in by_rank]] = [len(t) for t in by_rank]
            held = np.maximum(size, 0)
            return np.frombuffer(b"".join(by_rank), np.uint8), np.cumsum(held) - held, size

        flat, start, size = of_process(("bytes", path), bytes_of_ids)

        def decode(raw):
            ids = np.frombuffer(raw, "<u4")
            if len(ids) and (int(ids.max()) >= len(size) or size[ids].min() < 0):
                return None
            return flat[spread(start, size, ids)].tobytes()

        for b in batches:
            for k in range(0, len(b), 64):
                part = b[k : k + 64]
                decoded = [None if raw is None else decode(raw) for raw in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], schema=schema)

    small_batches(encoded.sparkSession)
    return rows.mapInArrow(run, ddl)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ranks_path()
    both = decode_docs(encode_docs(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_byte_bpe": op12_byte_bpe}
SQL: dict[str, str] = {}
