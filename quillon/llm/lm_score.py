"""Operator 10: language-model scoring with a weighted backoff automaton.

Tokens are the ASCII-lower-cased words of a text and one end. The model is a backoff automaton of order 3. The root holds an arc a token with the
smoothed unigram p1 = (c + 0.5) / (N + 0.5 (V + 1)). The start, every token and every pair of tokens seen twice or more in training is a state. A state h
believes its own counts by the share b(h) = (c(h) - 1) / (c(h) - 1 + WEIGHTS[order - 1]): the arc of a token w seen after it weighs
b c(h w) / c(h) + (1 - b) p(w | h without its first token), and its failure arc leads to the state without the first token at 1 - b. The weights
of a state sum to one; a history seen once is no state, so a text gains nothing from its own rare words, but from what others share with it.
A text is one left-to-right walk: take the arc of the next token or follow failure arcs until there is one, add up the log-weights, and go on
from the longest state that the tokens read end in.

No task needs the whole model. Texts are packed into blocks of about BLOCK_BYTES where they are read and written once, as token numbers in a table
bucketed by block, so that they are never shuffled. Each block sends its distinct token keys, then its pair and triple keys (hashes, see key_bits), with
their training counts to key ranges; each range adds them up over all blocks and answers every block with the totals in the order of its keys; the block
then builds the part of the automaton that its texts walk through. The totals of tokens, a small part, are written, as N and V must be known before
any text is scored; those of pairs and triples go straight to the blocks. What is gathered is in proportion to the corpus, memory to a block or a
range, or to one very long text, which is a block of its own.

Defined results: a null or empty text is one end token; with nothing to learn from (N = 0) every count is 0 and V is 0, so p1 is 1;
repeated rows are documents of their own, in training too, so ties score alike; a null doc_id counts as the empty string in a fold; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bucketed, fold, grouped, stash, table, texts

BLOCK_BYTES, RANGE_BYTES, STRETCH, SPARE = 4 << 20, 8 << 20, 512, 18
WEIGHTS = (20.0, 4.0, 1.0)  # of the backoff of one-token and two-token histories; the third is never used as a history
END, START = b"\n", b" "  # no word holds white space


def token_keys(text: str | None):
    """64-bit keys of the words of a text and its end."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as key

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII letters and white space only
    words.append(END)
    return np.fromiter(map(key, words), np.uint64, len(words))


def pair_keys(before, after):
    """Keys of token pairs: a mix of both sides."""
    import numpy as np

    k = before * np.uint64(0x9E3779B97F4A7C15)
    k += after
    k ^= k >> np.uint64(31)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(29))


def histories(keys, starts):
    """The token before each token; the start key at the first of each text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as key

    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[starts] = key(START)
    return before


def numbered(keys):
    """The distinct keys, sorted, and the number of each key's: np.unique in less memory."""
    import numpy as np

    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    distinct = ranked[fresh]
    del ranked
    nth, at = np.cumsum(fresh, dtype=np.int32), np.empty(len(keys), np.int32)
    nth -= 1
    at[order] = nth
    return distinct, at


class Block:
    """The texts of a block as numbers: its distinct token keys (sorted), the number of each token, tokens a text, and from these the distinct keys of
    pairs and triples and the number of each position's; of tokens alone if order is 1. Before a text's first token stands the start; a first token is in
    no triple."""

    def __init__(self, tokens, token, sizes, bits: int = 64, order: int = 3):
        import numpy as np

        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.keys, self.at = [tokens], [token]
        if order == 1:
            return
        flat = tokens[token]
        pair = pair_keys(histories(flat, self.starts), flat)
        triple = pair_keys(np.roll(pair, 1), flat)
        inner = np.ones(len(flat), bool)
        inner[self.starts] = False
        del flat
        triple = triple[inner]
        for keys in (pair, triple):
            keys >>= np.uint64(64 - bits)
        keys, at = numbered(pair)
        del pair
        self.keys.append(keys)
        self.at.append(at)
        keys, at = numbered(triple)
        del triple
        every = np.full(len(token), -1, np.int32)
        every[inner] = at
        self.keys.append(keys)
        self.at.append(every)


def key_bits(tokens: int) -> int:
    """How many bits the keys of pairs and triples have: at any size, one key in 2^SPARE at most is expected to be another's too, their counts then being
    added up. Tokens have all 64."""
    return min(64, max(44, int(tokens).bit_length() + SPARE))


def cuts(keys, ranges: int, bits: int = 64):
    """Positions in sorted keys where each of the ranges begins, and the end."""
    import numpy as np

    bounds = np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def planes(x) -> bytes:
    """Numbers as byte planes; the upper ones are mostly zeros and compress away."""
    import numpy as np

    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, kind: str):
    import numpy as np

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def squeeze(keys) -> bytes:
    """Sorted keys as the first one and byte planes of the differences, as many as the largest needs; the top plane, of few values, compressed."""
    import zlib

    import numpy as np

    if not len(keys):
        return b""
    d = np.diff(keys).astype("<u8")
    width = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    flat = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([keys[0], len(d), width], "<u8").tobytes() + flat[: width - 1].tobytes() + zlib.compress(flat[width - 1].tobytes(), 1)


def unsqueeze(raw: bytes):
    import zlib

    import numpy as np

    if not raw:
        return np.zeros(0, np.uint64)
    first, n, width = (int(x) for x in np.frombuffer(raw, "<u8", 3))
    d, stop = np.zeros((n, 8), np.uint8), 24 + (width - 1) * n
    d[:, : width - 1] = np.frombuffer(raw, np.uint8, stop - 24, 24).reshape(width - 1, n).T
    d[:, width - 1] = np.frombuffer(zlib.decompress(raw[stop:]), np.uint8)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), d.view("<u8").reshape(-1).astype(np.uint64)]), dtype=np.uint64)


def pack_counts(counts) -> bytes:
    """Counts as compressed byte planes; nearly all are small, so all planes but one are zeros."""
    import zlib

    import numpy as np

    return zlib.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(raw: bytes):
    import zlib

    import numpy as np

    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


class Automaton:
    """The part of the backoff automaton that a block walks through, as arrays over its distinct tokens, pairs and triples.

    arcs[k]: weight of the arc that reads the last token of a (k+1)-gram from the state of the k tokens before it; open[k]: whether that arc is
    there; fails[k]: weight of the failure arc of the state of a k-gram; state[k]: whether that state is there."""

    def __init__(self, block: Block, counts: list, n: int, v: int):
        import numpy as np

        c = [x.astype(np.float64, copy=False) for x in counts]
        start = c[0][block.at[0][block.starts + block.sizes - 1]][0] if len(block.starts) else 0.0  # texts began as often as they ended
        first = np.zeros(len(block.at[0]), bool)
        first[block.starts] = True
        self.start_state, self.fail_start = start >= 2, math.log10(1 - share(start, WEIGHTS[0]))
        p = (c[0] + 0.5) / (n + 0.5 * (v + 1))
        self.arcs, self.open = [np.log10(p)], [np.ones(len(p), bool)]
        self.fails = [np.log10(1 - share(x, w)) for x, w in zip(c, WEIGHTS)]
        self.state = [x >= 2 for x in c[:2]]
        for k in (1, 2):
            at = block.at[k]
            where = np.zeros(len(block.keys[k]) + 1, np.int32)
            where[at] = np.arange(len(at), dtype=np.int32)  # any position of each distinct n-gram; places without one, at -1, go to the end
            where = where[:-1]
            seen = c[k - 1][block.at[k - 1][where - 1]]
            if k == 1:
                seen = np.where(first[where], start, seen)
            mine = share(seen, WEIGHTS[k - 1])
            p = mine * c[k] / np.maximum(seen, 1) + (1 - mine) * p[block.at[k - 1][where]]
            self.arcs.append(np.log10(p))
            self.open.append((c[k] > 0) & (seen >= 2))

    def walk(self, block: Block):
        """log10 probability of each text: one left-to-right traversal, texts side by side. A state depends on the two tokens before it, so long texts
        are walked in stretches of STRETCH tokens, each from the state that its text has there."""
        import numpy as np

        tok, pair, triple = block.at
        cuts = -(-block.sizes // STRETCH)
        owner = np.repeat(np.arange(len(cuts)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = block.starts[owner] + nth * STRETCH
        length = np.minimum(STRETCH, block.sizes[owner] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        begin, length, nth, owner = begin[order], length[order], nth[order], owner[order]
        depth = np.where(self.state[1][pair[begin - 1]], 2, np.where(self.state[0][tok[begin - 1]], 1, 0))
        depth[nth == 0] = int(self.start_state)
        total = np.zeros(len(begin))
        live = np.searchsorted(-length, -np.arange(int(length.max()) if len(length) else 0), "left")
        for t, m in enumerate(live.tolist()):
            at, d = begin[:m] + t, depth[:m]
            one, two = tok[at], pair[at]
            fresh = nth[:m] == 0 if t == 0 else False  # the state before is the start's
            three = (d == 2) & (triple[at] >= 0)
            took = np.zeros(m, np.int8)
            took[three] = np.where(self.open[2][triple[at[three]]], 3, 0)
            add = np.where(three & (took == 0), self.fails[1][pair[at - 1]], 0.0)
            add[took == 3] = self.arcs[2][triple[at[took == 3]]]
            left = (took == 0) & (d >= 1)
            arc = left & self.open[1][two]
            add[arc] += self.arcs[1][two[arc]]
            fail = left & ~arc
            add[fail] += np.where(fresh, self.fail_start, self.fails[0][tok[at - 1]])[fail]
            root = (took == 0) & ~arc
            add[root] += self.arcs[0][one[root]]
            total[:m] += add
            depth[:m] = np.where(self.state[1][two], 2, np.where(self.state[0][one], 1, 0))
        return np.bincount(owner, total, len(block.sizes))


def totals(messages):
    """Of messages (keys, counts) to a range: the sum of all counts, how many keys have one, and a function that gives the totals of the i-th one's keys."""
    import numpy as np

    keys = [unsqueeze(k) for k, _ in messages]
    ends = np.cumsum([0, *map(len, keys)]).tolist()
    keys = np.concatenate(keys)
    distinct, at = numbered(keys)
    total = np.zeros(len(distinct), "<u8")
    del keys, distinct
    for i, j, (_, counts) in zip(ends, ends[1:], messages):
        total[at[i:j]] += unpack_counts(counts)  # no key is twice in a message
    return int(total.sum()), int((total > 0).sum()), lambda i: total[at[ends[i] : ends[i + 1]]]


def share(count, weight: float):
    """How much a state believes its own arcs: nothing of a history seen once, nearly all of one seen often."""
    import numpy as np

    more = np.maximum(count - 1, 0)
    return more / (more + weight)


def _blocks(batches, fields: int):
    """(block, rows) of a stream sorted by block, columns block first."""
    now, rows = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def score_texts(docs: DataFrame, learn) -> DataFrame:
    """Per row of docs: doc_id, held_out (not learn(doc_id)), n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    packed_ddl = f"block long, ids array<{id_type}>, train binary, sizes binary, tokens binary, token binary"
    packed = arrow_schema(packed_ddl)
    sent_ddl = "kind int, part int, block long, keys binary, counts binary"
    sent = arrow_schema(sent_ddl)

    def pack(batches):
        """Blocks of whole texts as numbers; written once, so that all passes see the same blocks."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in grouped(batches, 1, BLOCK_BYTES):
            each = [token_keys(t.as_py()) for t in b.column(1)]
            sizes, each = np.array([len(k) for k in each], "<i8"), np.concatenate(each)
            tokens, token = numbered(each)
            del each
            train = np.array(b.column(2).to_pylist(), bool)
            row = [part << 32 | seq], [b.column(0).to_pylist()], [train.tobytes()], [sizes.tobytes()], [squeeze(tokens)], [planes(token.view("<u4"))]
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, packed)], schema=packed)

    rows = texts(docs).withColumn("train", learn(F.col("doc_id")))
    store = bucketed(rows.mapInArrow(pack, packed_ddl), "lm-blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = store.agg(F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()[0]
    ranges, bits = max(1, -(-size // RANGE_BYTES)), key_bits(size // 4)

    def unpack(sizes, tokens, token, order=3):
        import numpy as np

        return Block(unsqueeze(tokens), unplanes(token, "<i4"), np.frombuffer(sizes, "<i8").astype(np.int64), bits, order)

    def send(kinds):
        def messages(no, train, sizes, tokens, token):
            import numpy as np
            import pyarrow as pa

            block = unpack(sizes, tokens, token, max(kinds) + 1)
            learnt = np.repeat(np.frombuffer(train, bool), block.sizes)
            for kind in kinds:
                keys, at = block.keys[kind], block.at[kind]
                counts = np.bincount(at[learnt & (at >= 0)], minlength=len(keys)).view("<u8")
                cut = cuts(keys, ranges, bits if kind else 64).tolist()
                out = [(kind, p, no, squeeze(keys[i:j]), pack_counts(counts[i:j])) for p, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, sent)], schema=sent)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for i in range(b.num_rows):
                    yield from messages(*[c[i].as_py() for c in b.columns])
                pa.default_memory_pool().release_unused()

        return run

    told_ddl = "block long, kind int, part int, counts binary, total long, types long"
    told = arrow_schema(told_ddl)

    def answers(rows):
        import pyarrow as pa

        total, types, of = totals([r[4:6] for r in rows])
        sums = (total, types) if rows[0][1] == 0 else (0, 0)
        for i, r in enumerate(rows):
            out = [r[3]], [r[1]], [r[2]], [pack_counts(of(i))], [sums[0] if not i else 0], [sums[1] if not i else 0]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, told)], schema=told)

    def answer(batches):
        import pyarrow as pa

        for _, rows in _blocks(batches, 6):
            yield from answers(rows)
            del rows  # or they would stay while the next range's come
            pa.default_memory_pool().release_unused()

    def exchange(*kinds):
        """The totals of all blocks' keys of these kinds, by block."""
        asked = store.select("block", "train", "sizes", "tokens", "token").mapInArrow(send(kinds), sent_ddl)
        by_range = asked.withColumn("range", F.col("part") * 3 + F.col("kind")).select("range", "kind", "part", "block", "keys", "counts")
        return by_range.repartition(len(kinds) * ranges, "range").sortWithinPartitions("range").mapInArrow(answer, told_ddl)

    of_tokens = stash(exchange(0), "lm-answers")
    stats = of_tokens.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    n, v = stats.n, stats.v
    out_ddl = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = arrow_schema(out_ddl)

    def score(left, right):
        """The texts of one block, by the totals of its tokens, pairs and triples."""
        import numpy as np
        import pyarrow as pa

        ids, train, sizes, tokens, token = (left.column(c)[0].as_py() for c in ("ids", "train", "sizes", "tokens", "token"))
        block = unpack(sizes, tokens, token)
        told = sorted(zip(*[right.column(c).to_pylist() for c in ("kind", "part", "counts")]))
        counts = [np.concatenate([np.zeros(0), *[unpack_counts(c).astype(np.float64) for k, _, c in told if k == kind]]) for kind in range(3)]
        del told, tokens, token
        model = Automaton(block, counts, n, v)
        add = lambda x: np.add.reduceat(x, block.starts)
        base, known = add(model.arcs[0][block.at[0]]), add((counts[0] > 0)[block.at[0]].astype(np.int64))
        pa.default_memory_pool().release_unused()
        out = ids, ~np.frombuffer(train, bool), block.sizes, known, np.full(len(ids), n), base, model.walk(block)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, scored)], schema=scored)

    every = of_tokens.unionAll(exchange(1, 2)).select("block", "kind", "part", "counts")
    return store.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(score, out_ddl)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), learn=lambda c: fold(c) != 1)


QUERIES = {"op10_lm_score": op10_lm_score}
SQL: dict[str, str] = {}
