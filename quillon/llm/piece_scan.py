"""Operator 2: SentencePiece encoding and decoding by a max-plus scan.

A text is a path through its character positions; an arc is a piece that spells the characters between two positions. Path weights add,
alternatives take the maximum. In a unigram model an arc weighs its piece's score. In a BPE model the weights are 0 and -inf: a piece may follow
another only if merging the two alone gives back the two; exactly one path from the start to a position is then free of -inf, and it
is the library's segmentation. A boundary state is (how many characters before the boundary the last piece ended, that piece).

Positions that no piece crosses (before a space after another character or a mark after a letter, around a line feed) are certain boundaries.
Texts up to CHUNK characters are taken in groups of about GROUP_BYTES: the group's distinct stretches between certain boundaries are solved side by
side, one max-plus step a position over arrays of at most CELLS places, and their ids gathered by number, for texts of RUN_WORDS words at a time: what
a worker holds besides the group's distinct words has a bound.

A giant document is split into chunks of CHUNK characters. Each gives, independently, the matrix from the states at its left boundary to
those at its right; the matrices are combined associatively, the best path's states are read off at every boundary, and each chunk is then traced
back on its own between its two states.

Defined results: a null text is an empty one and has no ids; characters without a piece become their UTF-8 bytes' pieces; decoding gives back
the text, but U+2581 becomes a space; repeated rows each get their row; an empty table gives an empty result; other columns are
ignored. Of paths of equal value the one of the longest last piece is taken. A very long text's ids are one row, as its text is.
"""

from __future__ import annotations

import re
import string
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, grouped, map_rows, spread, stash, table, texts

CHUNK, GROUP_BYTES, SPACE = 65_536, 4 << 20, "▁"
WIDE, PAIR_SLOTS, CHAR_BITS = 64, 1 << 20, 21  # stretches up to WIDE characters are solved side by side; the memory of pairs is a fixed table
CELLS, RUN_WORDS = 1 << 18, 1 << 17
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NOTHING = -1  # the piece before the start


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A SentencePiece model: its pieces, and the arcs that its kind allows."""

    def __init__(self, raw: bytes):
        self.kind, rows, normalizer = UNIGRAM, [], {}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                rows.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only the identity normalizer with a dummy prefix is known")
        if {t for _, _, t in rows} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined or unused pieces are not known")
        self.pieces = [p for p, _, _ in rows]
        self.types = [t for _, _, t in rows]
        self.score = [s for _, s, _ in rows]
        self.ids = {p: i for i, (p, _, t) in enumerate(rows) if t == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(rows) if t == BYTE}
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # the longest piece that ends in these two characters
        for p in self.ids:
            self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 1))
        self.unknown = min(s for _, s, t in rows if t == NORMAL) - 10
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces go across words")
        self.memory: dict[int, bool] = {}
        self.tables = self.spelled = None
        joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        marks = re.escape("".join(m for m in string.punctuation if not any(c + m in joined for c in string.ascii_letters)))
        to_mark = rf"[A-Za-z]+(?=[{marks}])|" if marks else ""  # no piece holds a letter and such a mark after it
        self.cut = re.compile(rf"\n|{SPACE}+(?:{to_mark}[^{SPACE}\n]*)|{to_mark}[^{SPACE}\n]+")

    @classmethod
    def of_process(cls, path: str):
        """One model a worker process; what it remembers outlives a task."""
        import sys
        import types

        kept = sys.modules.setdefault("quillon_worker_state", types.ModuleType("quillon_worker_state")).__dict__
        if ("pieces", path) not in kept:
            kept["pieces", path] = cls(open(path, "rb").read())
        return kept["pieces", path]

    def spell(self, piece: int) -> str:
        """A piece's characters; -2 - c stands for the character c that is no piece."""
        return chr(-2 - piece) if piece < NOTHING else self.pieces[piece]

    def merged(self, s: str) -> list[str]:
        """Byte-pair merging of a short string: the best pair first, of equals the leftmost."""
        parts = list(s)
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.score[p] > best):
                    best, at = self.score[p], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether the arc of piece b may come after piece a."""
        if self.kind != BPE or b < NOTHING and a <= NOTHING:
            return True
        key = a * 4_194_304 + b  # characters without a piece are numbered down to -1_114_113
        ok = self.memory.get(key)
        if ok is None:
            ok = self.checks(a, b)
            if len(self.memory) > 500_000:
                self.memory.clear()
            self.memory[key] = ok
        return ok

    def checks(self, a: int, b: int) -> bool:
        if b < NOTHING and a <= NOTHING:
            return True
        x, y = self.spell(a) if a != NOTHING else "", self.spell(b)
        return self.merged(x + y) == ([x, y] if x else [y])

    def forward(self, s: str, lo: int, hi: int, piece: int, meet=None):
        """Best values, last pieces and their lengths at the positions lo to hi, from the start state (at lo, after piece).

        meet: an earlier result (first position, values, pieces, lengths); once all of a longest piece's positions agree with it in pieces
        and in the differences of values, the rest is its own, and the difference is returned as the fourth item."""
        n = hi - lo + 1
        value, last, size = [None] * n, [None] * n, [0] * n
        value[0], last[0] = 0.0, piece
        get, bpe, agree, by, reach, sure = self.ids.get, self.kind == BPE, 0, None, self.reach.get, self.memory.get
        for i in range(lo + 1, hi + 1):
            best = None
            most = reach(s[i - 2 : i], 1) if i - lo > 1 else 1
            for k in range(most if most < i - lo else i - lo, 0, -1):
                j = i - k - lo
                before = last[j]
                if before is None:
                    continue
                p = get(s[i - k : i])
                if p is None:
                    if k > 1:
                        continue
                    p = -2 - ord(s[i - 1])
                if bpe:
                    ok = sure(before * 4_194_304 + p)
                    if ok or ok is None and self.follows(before, p):
                        best = (0.0, p, k)
                        break
                else:
                    v = value[j] + (self.score[p] if p >= 0 else self.unknown)
                    if best is None or v > best[0]:
                        best = (v, p, k)
            if best:
                value[i - lo], last[i - lo], size[i - lo] = best
            if meet is not None and i >= meet[0]:
                o = i - meet[0]
                same = last[i - lo] == meet[2][o] and (last[i - lo] is None or by is None or abs(value[i - lo] - meet[1][o] - by) < 1e-9)
                if same and last[i - lo] is not None and by is None:
                    by = value[i - lo] - meet[1][o]
                agree = agree + 1 if same else 0
                by = by if same else None
                if agree >= self.longest and i < hi and by is not None:
                    return value, last, size, by
        return value, last, size, None

    def trace(self, last, size, i: int) -> list[int]:
        """Pieces on the best path to position i of a forward result."""
        out = []
        while i > 0:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def build(self):
        """The pieces' prefix tree as a hash table in arrays: (node, character) to node, and the piece that ends at a node."""
        import numpy as np

        edges, at_node = {}, [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                key = node << CHAR_BITS | ord(c)
                if key not in edges:
                    edges[key] = len(at_node)
                    at_node.append(-1)
                node = edges[key]
            at_node[node] = i
        self.slots = 1 << max(10, (4 * len(edges)).bit_length())
        keys, to = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        key, value = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        slot = self.slot(key, self.slots)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            first = first[keys[slot[first]] < 0]
            keys[slot[first]], to[slot[first]] = key[first], value[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) % self.slots
        score = np.array([*self.score, self.unknown])
        self.tables = keys, to, np.array(at_node, np.int32), score, np.array([self.bytes.get(i, 0) for i in range(256)], np.int32)
        self.pair_keys, self.pair_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    @staticmethod
    def slot(key, slots: int):
        import numpy as np

        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)

    def child(self, node, char):
        """The nodes that the characters lead to, -1 where none does."""
        import numpy as np

        keys, to = self.tables[:2]
        key = node.astype(np.int64) << CHAR_BITS | char
        slot = self.slot(key, self.slots)
        have = keys[slot]
        out = np.where(have == key, to[slot], np.int32(-1))
        at = np.flatnonzero((have != key) & (have >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) % self.slots
            have = keys[slot[at]]
            hit = have == key[at]
            out[at[hit]] = to[slot[at[hit]]]
            at = at[~hit & (have >= 0)]
        return out

    def follow(self, a, b):
        """follows() of arrays of pieces; distinct pairs not seen before are worked out one by one."""
        import numpy as np

        shift = 1_114_114
        key = (a.astype(np.int64) + shift) << 22 | (b.astype(np.int64) + shift)
        slot = self.slot(key, PAIR_SLOTS)
        ok, new = self.pair_ok[slot], np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            distinct, inverse = np.unique(key[new], return_inverse=True)
            found = np.array([self.checks((k >> 22) - shift, (k & ((1 << 22) - 1)) - shift) for k in distinct.tolist()], bool)
            ok[new] = found[inverse]
            where = self.slot(distinct, PAIR_SLOTS)
            self.pair_keys[where], self.pair_ok[where] = -1, False
            _, one = np.unique(where, return_index=True)  # of pairs that share a slot, one is remembered
            self.pair_keys[where[one]], self.pair_ok[where[one]] = distinct[one], found[one]
        return ok

    def solve(self, chars, n):
        """Best paths through strings side by side: chars (longest, strings) of code points, n: lengths, longest first. (pieces on end, counts).

        One max-plus step a position: the value at i is the maximum over the pieces that end there of the value where they begin plus their weight."""
        import numpy as np

        length, count = chars.shape
        at_node, score = self.tables[2:4]
        pos, row = np.nonzero(np.arange(length)[:, None] < n)
        node = self.child(np.zeros(len(pos), np.int32), chars[pos, row])
        first = np.where(node >= 0, at_node[node], -1)
        arcs = [np.full((length, count), -1, np.int32)]
        arcs[0][pos, row] = np.where(first >= 0, first, -2 - chars[pos, row])
        while True:
            k = len(arcs)
            go = (node >= 0) & (pos + k < n[row])
            pos, row, node = pos[go], row[go], node[go]
            if not len(pos):
                break
            node = self.child(node, chars[pos + k, row])
            piece = np.where(node >= 0, at_node[node], -1)
            arcs.append(np.full((length, count), -1, np.int32))
            arcs[k][pos, row] = piece
        value, last, size = np.full((length + 1, count), -np.inf), np.full((length + 1, count), NOTHING, np.int32), np.zeros((length + 1, count), np.int8)
        value[0] = 0.0
        live = np.searchsorted(-n, -np.arange(length + 1), "right")  # strings of at least this length
        for i in range(1, length + 1):
            m = int(live[i])
            for k in range(min(i, len(arcs)), 0, -1):
                p = arcs[k - 1][i - k, :m]
                some = (p != -1) & (value[i - k, :m] > -np.inf)
                if self.kind == BPE:
                    some &= value[i, :m] == -np.inf  # at most one path is free of -inf
                at = np.flatnonzero(some)
                if not len(at):
                    continue
                p = p[at]
                if self.kind == BPE:
                    ok = self.follow(last[i - k, at], p)
                    at, p = at[ok], p[ok]
                    v = value[i - k, at]
                else:
                    v = value[i - k, at] + score[np.where(p < 0, len(score) - 1, p)]
                    more = v > value[i, at]
                    at, p, v = at[more], p[more], v[more]
                value[i, at], last[i, at], size[i, at] = v, p, k
        back, left, steps = n.astype(np.int64).copy(), np.arange(count), []
        counts = np.zeros(count, np.int64)
        while True:
            left = left[back[left] > 0]
            if not len(left):
                break
            out = np.full(count, -1, np.int32)
            out[left] = last[back[left], left]
            back[left] -= size[back[left], left]
            counts[left] += 1
            steps.append(out)
        if not steps:
            return np.zeros(0, np.int32), counts
        turned = np.array(steps[::-1]).T
        return turned[np.arange(len(steps))[None, :] >= len(steps) - counts[:, None]], counts

    def solve_all(self, stretches: list[str]):
        """Pieces of stretches between certain boundaries: (all on end, counts)."""
        import numpy as np

        if self.tables is None:
            self.build()
        n = np.fromiter(map(len, stretches), np.int64, len(stretches))
        code = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts, order = np.cumsum(n) - n, np.argsort(-n, kind="stable")
        flat, sizes, which = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        wide = int(np.searchsorted(-n[order], -WIDE, "left"))
        for i in order[:wide].tolist():  # long unbroken ones alone, along the string
            s = stretches[i]
            _, last, size, _ = self.forward(s, 0, len(s), NOTHING)
            flat.append(np.array(self.trace(last, size, len(s)), np.int32))
            sizes.append(np.array([len(flat[-1])]))
            which.append(np.array([i]))
        for low, high in ((17, WIDE), (11, 16), (7, 10), (1, 6), (0, 0)):
            at = order[int(np.searchsorted(-n[order], -high, "left")) : int(np.searchsorted(-n[order], -low, "right"))]
            for k in range(0, len(at), CELLS // max(1, high)):
                some = at[k : k + CELLS // max(1, high)]
                m = n[some]
                chars = np.zeros((int(m.max()), len(some)), np.int64)
                pos, row = np.nonzero(np.arange(len(chars))[:, None] < m)
                chars[pos, row] = code[starts[some][row] + pos]
                pieces, counts = self.solve(chars, m)
                flat.append(pieces)
                sizes.append(counts)
                which.append(some)
        flat, which, sizes = np.concatenate(flat), np.concatenate(which), np.concatenate(sizes)
        begin = np.empty(len(n), np.int64)
        begin[which] = np.cumsum(sizes) - sizes
        count = np.empty(len(n), np.int64)
        count[which] = sizes
        return flat[spread(begin, count, np.arange(len(n)))], count

    def ids_of(self, pieces, counts):
        """Ids instead of pieces: characters that are none become their UTF-8 bytes' pieces."""
        import numpy as np

        none = np.flatnonzero(pieces < 0)
        if not len(none):
            return pieces, counts
        char = -2 - pieces[none].astype(np.int64)
        width = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        raw = np.frombuffer(char.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        each = np.ones(len(pieces), np.int64)
        each[none] = width
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(pieces, each)
        out[np.repeat(pieces < 0, each)] = self.tables[4][raw]
        return out, np.bincount(owner, each, len(counts)).astype(np.int64)

    def distinct(self, stretches: list[str]):
        """(ids of the distinct stretches on end, their counts, the number of each stretch)."""
        number: dict[str, int] = {}
        codes = [number.setdefault(x, len(number)) for x in stretches]
        return *self.ids_of(*self.solve_all(list(number))), codes

    def along(self, s: str) -> list[int]:
        """Pieces of a string from one certain boundary to another."""
        import numpy as np

        number: dict[str, int] = {}
        codes = np.array([number.setdefault(x, len(number)) for x in self.cut.findall(s)], np.int64)
        flat, counts = self.solve_all(list(number))
        return flat[spread(np.cumsum(counts) - counts, counts, codes)].tolist() if len(codes) else []

    def to_ids(self, pieces: list[int]) -> list[int]:
        return [i for p in pieces for i in ([p] if p >= 0 else [self.bytes[b] for b in chr(-2 - p).encode()])]

    def encode(self, text: str | None) -> list[int]:
        return self.to_ids(self.along(SPACE + text.replace(" ", SPACE))) if text else []

    def encode_all(self, texts):
        """(ids on end, their sizes) of the texts of an Arrow array of strings, in their order, those of about RUN_WORDS words (one at least) at a time.

        A text is a row of words, each the spaces before it and what follows; the group's distinct words are cut into stretches, and its distinct
        stretches solved."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        flag = lambda x: x.to_numpy(zero_copy_only=False)
        full = flag(pc.binary_length(texts)) > 0
        if not full.any():
            yield np.zeros(0, np.int32), np.zeros(len(full), np.int64)
            return
        spaced = flag(pc.match_substring(texts, "  ")) | flag(pc.match_substring(texts, SPACE)) | flag(pc.starts_with(texts, " ")) | flag(pc.ends_with(texts, " "))
        plain, other = np.flatnonzero(full & ~spaced), np.flatnonzero(full & spaced)
        words = pc.split_pattern(texts.take(pa.array(plain)), " ")
        more, n_more = [], []
        for t in texts.take(pa.array(other)).to_pylist():
            found = re.findall(" +[^ ]*", " " + t.replace(SPACE, " "))
            n_more.append(len(found))
            more += [x[1:] for x in found]
        n_words = np.zeros(len(texts), np.int64)
        n_words[plain], n_words[other] = np.diff(words.offsets.to_numpy()), n_more
        every = pa.chunked_array([words.flatten(), pa.array(more, pa.large_string())])
        del texts, words, more
        every = every.dictionary_encode().combine_chunks()  # of one dictionary: the words are not copied
        number_of, listed = every.indices.to_numpy(), every.dictionary.to_numpy(zero_copy_only=False).tolist()
        del every
        parts, cuts, findall = [], [], self.cut.findall
        for w in listed:
            found = findall(SPACE + w.replace(" ", SPACE))
            cuts.append(len(found))
            parts += found
        del listed
        flat, counts, codes = self.distinct(parts)
        del parts
        codes, cuts = np.array(codes, np.int64), np.array(cuts, np.int64)
        pool = flat[spread(np.cumsum(counts) - counts, counts, codes)] if len(codes) else np.zeros(0, np.int32)  # ids of the distinct words
        word_at = np.concatenate([[0], np.cumsum(cuts)])
        sizes = np.diff(np.concatenate([[0], np.cumsum(counts[codes])])[word_at]) if len(codes) else np.zeros(0, np.int64)
        place = np.cumsum(sizes) - sizes
        # words lie in the order plain texts, other texts; texts are put back in theirs
        begin = np.zeros(len(n_words), np.int64)
        order = np.concatenate([plain, other])
        begin[order] = np.cumsum(n_words[order]) - n_words[order]
        upto, i = np.cumsum(n_words), 0
        while i < len(n_words):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - n_words[i] + RUN_WORDS, "right")))
            at = number_of[spread(begin, n_words, np.arange(i, j))]
            ids = pool[spread(place, sizes, at)]
            stops = np.concatenate([[0], np.cumsum(sizes[at])])[upto[i:j] - (upto[i] - n_words[i])]
            yield ids, np.diff(stops, prepend=0)
            i = j

    def texts_of(self, ids):
        """The text of each list of ids (an Arrow list array)."""
        import numpy as np
        import pyarrow as pa

        if self.spelled is None:
            raw = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t == NORMAL else b"" for p, t in zip(self.pieces, self.types)]
            self.spelled = pa.array(raw, pa.large_binary())
        taken = self.spelled.take(ids.values)  # the bytes of all pieces on end: a text is a slice of them
        if not len(taken):
            return [""] * len(ids)
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ids.offsets.to_numpy()].tolist()
        raw = memoryview(taken.buffers()[2])
        decoded = (str(raw[i:j], "utf-8", "replace") for i, j in zip(at, at[1:]))
        return [t[1:] if t.startswith(" ") else t for t in decoded]

    def decode(self, ids: list[int]) -> str:
        import pyarrow as pa

        return self.texts_of(pa.array([ids], pa.list_(pa.int32())))[0]

    # chunks: s holds the characters from `left` before the chunk to its end; states are (characters before the boundary, piece)

    def states(self, s: str, left: int) -> list[tuple[int, int]]:
        """All states that the left boundary can have, from the characters before it."""
        if not left:
            return [(0, NOTHING)]
        out = [(left, NOTHING)] if left < self.longest else []  # no piece may have ended since the start of the text
        sure = {m.start() for m in self.cut.finditer(s)}
        for d in range(min(self.longest, left)):
            end = left - d
            if d and end in sure:
                out.append((d, NOTHING))
                continue
            for k in range(1, min(self.longest, end) + 1):
                p = self.ids.get(s[end - k : end])
                if p is not None or k == 1:
                    out.append((d, p if p is not None else -2 - ord(s[end - 1])))
        return out

    def certain(self, s: str, left: int) -> list[int]:
        """The certain boundaries of the chunk, first and last only."""
        at = [m.start() for m in self.cut.finditer(s) if m.start() > left]
        return [at[0], at[-1]] if at else []

    def ends(self, result, s: str, lo: int, hi: int) -> list[tuple[int, int, float]]:
        """States at the right boundary. At a certain boundary what came before does not matter: its piece is none."""
        value, last, _, _ = result
        sure = {m.start() for m in self.cut.finditer(s, max(0, hi - 2 * self.longest))}
        some = [i for i in range(max(lo, hi - self.longest + 1), hi + 1) if last[i - lo] is not None]
        return [(hi - i, NOTHING if i in sure else last[i - lo], value[i - lo]) for i in some]

    def transfer(self, s: str, left: int) -> dict[tuple[int, int], dict[tuple[int, int], float]]:
        """The chunk's matrix: start state to end states with the value of the best path between."""
        hi, cuts, out = len(s), self.certain(s, left), {}
        if cuts:
            tail = self.forward(s, cuts[1], hi, NOTHING)
            after = {(d, p): v for d, p, v in self.ends(tail, s, cuts[1], hi)}
            between = 0.0 if self.kind == BPE else sum(self.score[p] if p >= 0 else self.unknown for p in self.along(s[cuts[0] : cuts[1]]))
            for d, p in self.states(s, left):
                value, last, _, _ = self.forward(s, left - d, cuts[0], p)
                if last[-1] is not None:
                    out[d, p] = {e: value[-1] + between + v for e, v in after.items()}
            return out
        first = None
        for d, p in sorted(self.states(s, left), reverse=True):
            lo = left - d
            result = self.forward(s, lo, hi, p, first[1] if first else None)
            if result[3] is not None:
                out[d, p] = {e: v + result[3] for e, v in first[2].items()}
                continue
            out[d, p] = {(a, b): v for a, b, v in self.ends(result, s, lo, hi)}
            if first is None and out[d, p]:
                first = (lo, (lo, *result[:3]), out[d, p])
        return {k: v for k, v in out.items() if v}

    def backtrace(self, s: str, left: int, start: tuple[int, int], end: tuple[int, int]) -> list[int]:
        """Pieces of the chunk between its two states: from `start` up to where `end` says the last piece ended."""
        d, p = start
        lo, hi, cuts = left - d, len(s) - end[0], self.certain(s, left)
        if not cuts or hi <= cuts[0]:
            _, last, size, _ = self.forward(s, lo, hi, p)
            return self.trace(last, size, hi - lo)
        _, last, size, _ = self.forward(s, lo, cuts[0], p)
        out = self.trace(last, size, cuts[0] - lo)
        stop = max(i for i in cuts if i <= hi)
        out += self.along(s[cuts[0] : stop])
        _, last, size, _ = self.forward(s, stop, hi, NOTHING)
        return out + self.trace(last, size, hi - stop)


def compose(x: dict, y: dict) -> dict:
    """Max-plus product of two matrices."""
    out = {}
    for a, row in x.items():
        best: dict = {}
        for b, v in row.items():
            for c, w in y.get(b, {}).items():
                if c not in best or v + w > best[c]:
                    best[c] = v + w
        if best:
            out[a] = best
    return out


def prefixes(matrices: list[dict]) -> list[dict]:
    """Products of the first 1, 2, ... matrices by an associative scan of logarithmic depth."""
    if len(matrices) == 1:
        return matrices
    pairs = [compose(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
    done = prefixes(pairs)
    return [done[i // 2] if i % 2 else (matrices[0] if not i else compose(done[i // 2 - 1], matrices[i])) for i in range(len(matrices))]


def boundary_states(matrices: list[dict], last: tuple | None = None) -> list[tuple[int, int]]:
    """The best path's states at all boundaries, the start first: backwards, each the best that leads to the next."""
    start = (0, NOTHING)
    sums = [m[start] for m in prefixes(matrices)]
    at = max((v, e) for e, v in sums[-1].items() if e[0] == 0)[1]
    out = [at]
    for i in range(len(matrices) - 1, 0, -1):
        at = max((v + matrices[i][e][at], e) for e, v in sums[i - 1].items() if at in matrices[i].get(e, {}))[1]
        out.append(at)
    return [start, *out[::-1]]


def encode_docs(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, ids."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    whole_ddl, chunk_ddl = f"doc_id {id_type}, ids array<int>", "h string, c int, left int, s string"
    whole_schema, chunk_schema = arrow_schema(whole_ddl), arrow_schema(chunk_ddl)

    def whole(batches):
        import numpy as np
        import pyarrow as pa

        pieces = Pieces.of_process(model)
        for b in grouped(batches, 1, GROUP_BYTES):
            doc_id, at = b.column(0).cast(whole_schema.field(0).type), 0
            for ids, sizes in pieces.encode_all(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([doc_id.slice(at, len(sizes)), lists.cast(whole_schema.field(1).type)], schema=whole_schema)
                at += len(sizes)
            pa.default_memory_pool().release_unused()

    def cut(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            for t in b.column(0).to_pylist():
                h, s = hashlib.sha256(t.encode()).hexdigest(), SPACE + t.replace(" ", SPACE)
                for i in range(0, len(s), chunk):
                    back = min(i, left)
                    row = [[h], [i // chunk], [back], [s[i - back : i + chunk]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, chunk_schema)], schema=chunk_schema)

    rows = texts(docs)
    giant = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = rows.filter(~giant).mapInArrow(whole, whole_ddl)
    hashed = rows.filter(giant).select("doc_id", F.sha2("text", 256).alias("h"))
    left = 64  # characters before a chunk; twice the longest piece is enough
    chunks = rows.filter(giant).select("text").mapInArrow(cut, chunk_ddl)
    chunks = stash(chunks.repartition("h", "c").dropDuplicates(["h", "c"]), "piece-chunks")
    if chunks.isEmpty():
        return short
    matrix = "h string, c int, sd array<int>, sp array<int>, ed array<int>, ep array<int>, v array<double>"

    def transfers():
        pieces = Pieces.of_process(model)
        if 2 * pieces.longest > left:
            raise ValueError("pieces are too long for the characters kept before a chunk")

        def each(h, c, lefts, strings):
            flat = [[(*a, *b, v) for a, row in pieces.transfer(s, k).items() for b, v in row.items()] for k, s in zip(lefts, strings)]
            return h, c, *[[[x[i] for x in f] for f in flat] for i in range(5)]

        return each

    matrices = map_rows(chunks.repartition("h", "c"), transfers, matrix)
    scanned = arrow_schema("h string, c int, start array<int>, stop array<int>")

    def scan(batches):
        import pyarrow as pa

        def solve(h, rows):
            ms = []
            for r in rows:
                m: dict = {}
                for a, b, c, d, v in zip(*r[2:]):
                    m.setdefault((a, b), {})[c, d] = v
                ms.append(m)
            at = boundary_states(ms)
            cols = [h] * len(rows), [r[1] for r in rows], [list(x) for x in at[:-1]], [list(x) for x in at[1:]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, scanned)], schema=scanned)

        now, rows = None, []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if r[0] != now and rows:
                    yield solve(now, rows)
                    rows = []
                now = r[0]
                rows.append(r)
        if rows:
            yield solve(now, rows)

    states = matrices.repartition("h").sortWithinPartitions("h", "c").mapInArrow(scan, "h string, c int, start array<int>, stop array<int>")

    def traces():
        pieces = Pieces.of_process(model)

        def each(h, c, lefts, strings, starts, stops):
            return h, c, [pieces.to_ids(pieces.backtrace(s, k, tuple(a), tuple(b))) for k, s, a, b in zip(lefts, strings, starts, stops)]

        return each

    traced = map_rows(chunks.join(states, ["h", "c"]).select("h", "c", "left", "s", "start", "stop"), traces, "h string, c int, ids array<int>")
    joined = traced.groupBy("h").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionAll(hashed.select("doc_id", "h").join(joined, "h").select("doc_id", "ids"))


def decode_docs(encoded: DataFrame, model: str) -> DataFrame:
    """Per row of encoded(doc_id, ids): doc_id, text."""
    ddl = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        pieces = Pieces.of_process(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field(0).type), pa.array(pieces.texts_of(b.column(1)), schema.field(1).type)], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, ddl)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), n_chars and text_crc32 of the decoded text."""
    encoded = encode_docs(table(spark, sf_dir, "documents"), model_path())
    return digests(encoded, model_path())


def digests(encoded: DataFrame, model: str) -> DataFrame:
    ddl = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, n_chars long, text_crc32 long"
    schema = arrow_schema(ddl)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        pieces = Pieces.of_process(model)
        for b in batches:
            ids = b.column(1)
            text, at, flat = pieces.texts_of(ids), ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            columns = [np.diff(at), [zlib.crc32(flat[i:j]) for i, j in zip(at, at[1:])], list(map(len, text)), [zlib.crc32(t.encode()) for t in text]]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, ddl)


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
