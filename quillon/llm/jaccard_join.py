"""Operator 8: n-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct WORDS-word shingles (ASCII-lower-cased words; a shorter text is one shingle, an
empty one has none). Two documents link when 100 * |A and B| >= PERCENT * |A or B|; the result is the connected components of all links.

1. Documents of equal sets are one class. A pair of classes that links shares a key among the first n - ceil(PERCENT n / 100) + 1 of each, in
   any common order. The order puts keys that many classes begin with last, so shared passages open few pairs; within that it is by hash.
2. Each class goes to the partitions of those of its first keys that it shares, once a partition, with its size and token bitmap.
   Classes that meet under a key make a unit. A unit of few classes (FEW) is one leaf and tries all its pairs by bitmap; a larger one builds a
   signature tree, leaves of NODE classes and FAN nodes to a node, which hold OR-combined bitmaps, size ranges and the largest excess (elements
   beyond bits), and traverses it against itself from the root: node pairs are pruned by the largest overlap that their bitmaps and sizes allow. Nothing that could link is pruned; pairs already joined
   through others are passed over, so a partition gives a forest. Its trees over all partitions are the candidate groups: no link leaves one.
3. The sets of a candidate group meet once and every pair not yet joined is checked on them exactly; again a forest of links comes out. A
   group of more than GROUP classes or GROUP_KEYS keys is cut into blocks, which meet in pairs. Of a group of more than SQUARE blocks, copies of CENTRES of its
   classes meet every block first, and only classes that these do not join into the group's largest part meet the others in pairs of blocks. So a group
   of near copies costs at most SQUARE times its size in rows; one that no few centres join, such as a long chain, still costs the square of its blocks.

A key of more classes than UNIT is dealt over pairs of blocks. All tables are shuffled by hash; broadcast are only the list of
frequent first keys (at most HOT_KEYS) and, when they are at most SMALL, the ids of the candidate documents.

Defined results: a null or empty text, or one of white space, has 0 shingles and is its own component; a null doc_id takes part and never is the
smallest of a component that has another; repeated rows and ties in size are in one component or none; an empty table gives an empty result; other
columns are ignored. A very long text is one set, held whole by one task. Hashes are 64-bit: among a billion distinct shingles or texts, equal ones by chance are expected 0.03 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, stash, table, texts
from .lm_score import token_keys

WORDS, PERCENT = 4, 85
UNIT, GROUP, GROUP_KEYS, SQUARE, CENTRES, FEW, NODE, FAN, FREQUENT, HOT_KEYS, SMALL = 20_000, 1_000, 1 << 22, 8, 16, 24, 16, 8, 64, 100_000, 1_000_000
PAIRS_AT_ONCE, LEAF_PAIRS_AT_ONCE = 4_096, 256
MIN_BITS, MAX_BITS = 256, 65_536


def mix(k):
    import numpy as np

    k = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(29))


def shingle_set(text: str | None, words: int = WORDS):
    """Sorted distinct 64-bit keys of a text's shingles."""
    import numpy as np

    k = token_keys(text)[:-1]
    if not len(k):
        return k
    n = min(words, len(k))
    m = len(k) - n + 1
    s = np.full(m, n, np.uint64)
    for i in range(n):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + k[i : i + m])
    return np.unique(s)


def class_id(keys) -> int:
    """A signed 64-bit id of a set."""
    import numpy as np

    return int(mix(keys + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).astype(np.int64))


def first_keys(keys, hot, percent: int):
    """The keys of which a set that links must share one: frequent ones (hot, sorted) come last in the order."""
    import numpy as np

    n = len(keys)
    p = n + (-percent * n // 100) + 1
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        late = hot[at] == keys
        keys = np.concatenate([keys[~late], keys[late]])
    return keys[:p]


def bitmap(keys) -> bytes:
    """Bits (key mod m) for m the power of two from n to 2 n, within limits."""
    import numpy as np

    m = min(MAX_BITS, max(MIN_BITS, 1 << max(0, int(len(keys) - 1).bit_length())))
    bits = np.zeros(m, np.uint8)
    bits[(keys % np.uint64(m)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Signatures:
    """Sizes and bitmaps of some classes, grouped by bitmap length; a longer bitmap is folded to compare it with one half as long."""

    def __init__(self, sizes: list[int], bitmaps: list[bytes], percent: int):
        import numpy as np

        self.percent, self.n, self.visited = percent, np.array(sizes, np.int64), 0
        self.bits = np.array([len(b) * 8 for b in bitmaps], np.int64)
        self.place = np.zeros(len(sizes), np.int64)
        self.rows, self.folded = {}, {}
        for m in np.unique(self.bits).tolist():
            at = np.flatnonzero(self.bits == m)
            self.place[at] = np.arange(len(at))
            self.rows[m] = np.frombuffer(b"".join(bitmaps[i] for i in at), np.uint64).reshape(len(at), -1)
            half = self.rows[m].shape[1] // 2
            if half:
                self.folded[m // 2] = self.rows[m][:, :half] | self.rows[m][:, half:]

    def at(self, i, m: int):
        """Bitmaps of the classes i at m bits; theirs are m or 2 m bits long."""
        import numpy as np

        out = np.empty((len(i), m // 64), np.uint64)
        own = self.bits[i] == m
        out[own] = self.rows[m][self.place[i[own]]] if own.any() else 0
        if not own.all():
            out[~own] = self.folded[m][self.place[i[~own]]]
        return out

    def need(self, na, nb):
        """The overlap from which sets of these sizes link."""
        return -(-self.percent * (na + nb) // (100 + self.percent))

    def alike(self, na, nb):
        import numpy as np

        return 100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb)

    def may_link(self, a, b):
        """For index arrays a, b: whether sizes and bitmaps allow a link."""
        import numpy as np

        ok = self.alike(self.n[a], self.n[b])
        low = np.minimum(self.bits[a], self.bits[b])
        ok &= np.maximum(self.bits[a], self.bits[b]) <= 2 * low
        for m in np.unique(low[ok]).tolist():
            at = np.flatnonzero(ok & (low == m))
            for k in range(0, len(at), max(1, (1 << 22) // m)):
                i = at[k : k + max(1, (1 << 22) // m)]
                x, y = self.at(a[i], m), self.at(b[i], m)
                na, nb = self.n[a[i]], self.n[b[i]]
                most = np.minimum(na - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
                ok[i] = most >= self.need(na, nb)
        return ok

    def tree(self, both, m: int) -> list[tuple]:
        """Levels of a signature tree over classes in the order given, leaves of NODE classes first, then FAN nodes to a node: OR-combined bitmaps, least and
        largest size, largest excess (elements beyond bits)."""
        import numpy as np

        marks, n = self.at(both, m), self.n[both]
        level = marks, n, n, n - np.bitwise_count(marks).sum(1, dtype=np.int64)
        levels, size = [], NODE
        while True:
            cut = np.arange(0, len(level[0]), size)
            level = np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut)
            levels.append(level)
            if len(cut) == 1:
                return levels
            size = FAN

    def tree_pairs(self, members, roots):
        """Pairs of members (i, j) that may link, by dual traversal of their signature tree from its root: a pair of nodes opens into pairs of their children
        unless the largest overlap that bitmaps, excess and sizes allow is too small. roots(array): the tree of pairs found so far that each class is in;
        pairs within one are not wanted. Asked again as the traversal goes, so that what was found meanwhile prunes whole nodes."""
        import numpy as np

        members = members[np.lexsort((members, self.n[members]))]
        for m in np.unique(self.bits[members]).tolist():
            low = members[self.bits[members] == m]
            both = np.concatenate([low, members[self.bits[members] == 2 * m]])
            levels = self.tree(both, m)
            spans = [NODE * FAN**k for k in range(len(levels))]
            todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
            while todo:
                k, u, v = todo.pop()
                joined, least, largest, spare = levels[k]
                self.visited += len(u)
                ok = u * spans[k] < len(low)  # a pair needs a class of the shorter bitmaps
                ok &= (100 * largest[v] >= self.percent * least[u]) & (100 * largest[u] >= self.percent * least[v])
                u, v = u[ok], v[ok]
                most = np.bitwise_count(joined[u] & joined[v]).sum(1, dtype=np.int64) + np.minimum(spare[u], spare[v])
                ok = most >= self.need(least[u], least[v])
                u, v = u[ok], v[ok]
                if not len(u):
                    continue
                top = roots(both)
                cut = np.arange(0, len(both), spans[k])
                low_root, high_root = np.minimum.reduceat(top, cut), np.maximum.reduceat(top, cut)
                ok = (low_root[v] != low_root[u]) | (high_root[v] != low_root[u]) | (high_root[u] != low_root[u])
                u, v = u[ok], v[ok]
                if k:
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
                    a, b = (u[:, None] * FAN + i).ravel(), (v[:, None] * FAN + j).ravel()
                    some = (a <= b) & (b < len(levels[k - 1][0]))
                    a, b = a[some], b[some]
                    step = PAIRS_AT_ONCE if k > 1 else LEAF_PAIRS_AT_ONCE
                    todo += [(k - 1, a[x : x + step], b[x : x + step]) for x in range(0, len(a), step)][::-1]
                    continue
                i, j = (x.ravel() for x in np.meshgrid(np.arange(NODE), np.arange(NODE), indexing="ij"))
                i, j = (u[:, None] * NODE + i).ravel(), (v[:, None] * NODE + j).ravel()
                some = (i < j) & (i < len(low)) & (j < len(both))
                i, j = i[some], j[some]
                some = top[i] != top[j]
                i, j = both[i[some]], both[j[some]]
                if len(i):
                    some = self.may_link(i, j)
                    yield i[some], j[some]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def root(self, i: int) -> int:
        top = self.top
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.top[max(a, b)] = min(a, b)
        return a != b


def candidate_forest(sizes: list[int], bitmaps: list[bytes], units: dict, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Index pairs that may link and share a unit ({unit: [indices]}), without those already joined through others."""
    import numpy as np

    s, forest, out = Signatures(sizes, bitmaps, percent), Forest(len(sizes)), []
    by_size: dict[int, list] = {}
    for members in units.values():
        by_size.setdefault(len(members), []).append(members)
    pairs = [np.zeros((0, 2), np.int64)]
    for size, some in by_size.items():
        if size <= FEW:
            i, j = np.triu_indices(size, 1)
            m = np.array(some, np.int64)
            pairs.append(np.unique(np.sort(np.stack([m[:, i].ravel(), m[:, j].ravel()], 1), 1), axis=0))
    few = np.unique(np.concatenate(pairs), axis=0)
    few = few[few[:, 0] != few[:, 1]]
    if len(few):
        few = few[s.may_link(few[:, 0], few[:, 1])]
        out += [(i, j) for i, j in few.tolist() if forest.join(i, j)]

    def roots(members):
        return np.array([forest.root(x) for x in members.tolist()])

    for size, some in by_size.items():
        if size > FEW:
            for members in some:
                for i, j in s.tree_pairs(np.array(members, np.int64), roots):
                    out += [(x, y) for x, y in zip(i.tolist(), j.tolist()) if forest.join(x, y)]
    return out


def link_forest(sets: list, sides: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Index pairs of sets that link, exactly, without those already joined through others; sides: only pairs across sides (unless all are
    on one). Sets become bits over the keys that two of them share, which is an exact overlap."""
    import numpy as np

    n = np.array([len(x) for x in sets], np.int64)
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if k * (100 + percent) >= percent * (n[0] + n[1]) else []
    keys, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    width = int((counts > 1).sum())
    words = -(-max(1, width) // 64)
    bits = np.zeros((len(sets), words), np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    keep = counts[inverse] > 1
    at = place[inverse[keep]]
    np.bitwise_or.at(bits, (owner[keep], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    order = np.argsort(n, kind="stable")
    size, group, out = n[order], np.arange(len(sets)), []
    side = None if sides is None or len(set(sides)) == 1 else np.array(sides)
    for i, x in enumerate(order.tolist()):
        j = order[i + 1 : int(np.searchsorted(size, size[i] * 100 // percent, "right"))]
        j = j[group[j] != group[x]]
        if side is not None:
            j = j[side[j] != side[x]]
        for k in range(0, len(j), 1024):
            y = j[k : k + 1024]
            both = np.bitwise_count(bits[y] & bits[x]).sum(1, dtype=np.int64)
            for z in y[both * (100 + percent) >= percent * (n[y] + n[x])].tolist():
                if group[z] != group[x]:
                    out.append((x, z))
                    group[group == group[z]] = group[x]
    return out


def _scan(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """kind 0: a document (doc_id, n, cid, bitmap of its set); kind 1: a first key (cid) that several classes of a task have, and how many (n)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"kind int, doc_id {id_type}, n long, cid long, marks binary, text_id long"
    schema = arrow_schema(ddl)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        none, held, classes = np.zeros(0, np.uint64), [], set()

        def frequent():
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (none, none)
            some = counts > 1
            return keys[some], counts[some]

        def batch(kind, ids, n, cid, marks, text_ids):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((np.full(len(n), kind), ids, n, cid, marks, text_ids), schema)], schema=schema)

        size = 0
        for b in batches:
            ids, n, cid, marks = b.column(0).to_pylist(), [], [], []
            for t in b.column(1).to_pylist():
                k = shingle_set(t, words)
                n.append(len(k))
                cid.append(class_id(k) if len(k) else None)
                marks.append(bitmap(k) if len(k) else None)
                if len(k) and cid[-1] not in classes:
                    classes.add(cid[-1])
                    held.append(first_keys(k, none, percent))
                    size += len(held[-1])
            yield batch(0, ids, n, cid, marks, b.column(2).to_pylist())
            if size > 4_000_000:
                keys, counts = frequent()
                yield batch(1, [None] * len(keys), counts, keys.view(np.int64), [None] * len(keys), [None] * len(keys))
                held, classes, size = [], set(), 0
        keys, counts = frequent()
        yield batch(1, [None] * len(keys), counts, keys.view(np.int64), [None] * len(keys), [None] * len(keys))

    return texts(docs, F.xxhash64("text").alias("text_id")).mapInArrow(run, ddl)


def _first_rows(docs: DataFrame, hot, words: int, percent: int) -> DataFrame:
    """(key, cid) for the first keys of each class, once a task."""
    schema = arrow_schema("key long, cid long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        classes = set()
        for b in batches:
            cids, keys = [], []
            for t in b.column(1).to_pylist():
                k = shingle_set(t, words)
                c = class_id(k) if len(k) else None
                if c is not None and c not in classes:
                    classes.add(c)
                    cids.append(c)
                    keys.append(first_keys(k, hot, percent).view(np.int64))
            if len(classes) > 1_000_000:
                classes = set()
            if cids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(cids, np.int64), [len(k) for k in keys]))], schema=schema)

    return texts(docs).mapInArrow(run, "key long, cid long")


def _shared(rows: DataFrame) -> DataFrame:
    """Distinct (key, cid) of the keys that two classes or more have; a stream sorted by key, so memory is a batch and one key's first row."""
    schema = arrow_schema("key long, cid long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, first, several = None, None, False  # of the key that a batch ended in: its last class, its first and whether that was given out
        for b in batches:
            key, cid = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(key):
                continue
            same_key = np.concatenate([[last is not None and key[0] == last[0]], key[1:] == key[:-1]])
            same = same_key & np.concatenate([[last is not None and cid[0] == last[1]], cid[1:] == cid[:-1]])
            more = same_key & ~same  # a second or later class of its key
            keep = more.copy()
            k = np.flatnonzero(~same_key)  # firsts
            runs = np.append(k, len(key))
            has = np.add.reduceat(more, k) > 0 if len(k) else np.zeros(0, bool)
            keep[k[has]] = True
            extra = ([], [])
            head = int(runs[0])
            if last is not None and head and not several and more[:head].any():
                extra, several = ([first[0]], [first[1]]), True
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(extra[0], np.int64), key[keep]])), pa.array(np.concatenate([np.array(extra[1], np.int64), cid[keep]]))], schema=schema)
            if len(k):
                first, several = (key[k[-1]], cid[k[-1]]), bool(has[-1])
            last = (key[-1], cid[-1])

    return rows.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(run, "key long, cid long")


def _by_first(batches, solve):
    """solve(rows) for each run of rows with the same first column, in a stream sorted by it."""
    now, rows = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[0] != now and rows:
                yield solve(rows)
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield solve(rows)


def _candidates(shared: DataFrame, classes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(a, b): a forest of classes that may link, a partition. shared: key, cid, sub; classes: cid, n, marks."""
    schema = arrow_schema("a long, b long")
    part = F.pmod(F.xxhash64("key", "sub"), F.lit(parts)).cast("int")
    routed = shared.groupBy(part.alias("part"), "cid").agg(F.collect_list(F.struct("key", "sub")).alias("units")).join(classes, "cid")

    def solve(rows):
        import pyarrow as pa

        units: dict[tuple, list[int]] = {}
        for i, r in enumerate(rows):
            for u in r[4]:
                units.setdefault((u["key"], u["sub"]), []).append(i)
        pairs = candidate_forest([r[2] for r in rows], [r[3] for r in rows], units, percent)
        return pa.RecordBatch.from_arrays([pa.array([rows[p[k]][1] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    sent = routed.select("part", "cid", "n", "marks", "units").repartition(parts, "part").sortWithinPartitions("part")
    return sent.mapInArrow(lambda batches: _by_first(batches, solve), "a long, b long")


def block_pairs(i, of):
    """The pairs (lower, higher) of `of` blocks that block i is in, as an array column of numbers lower * of + higher."""
    return F.transform(F.sequence(F.lit(0), of - 1), lambda j: F.least(i, j) * of + F.greatest(i, j))


def _links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of links within each candidate group (cid, comp), checked on the sets (cid, keys).

    A group that one task should not hold meets in pairs of blocks, which sends each set once a block. A group of more than SQUARE blocks is joined around a few
    centres first: its blocks each meet copies of CENTRES of its classes. What that joins into the group's largest part needs no further check within
    itself; the rest alone meets every block. So no set of a group of near copies is sent more than SQUARE times."""
    sized = groups.join(sets.select("cid", F.size("keys").alias("_n")), "cid")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(GROUP), F.sum("_n") / F.lit(GROUP_KEYS))).cast("int")
    large = stash(sized.groupBy("comp").agg(blocks.alias("of")).filter("of > 1"), "join-large")
    unit = lambda *c: F.concat_ws(":", *c).alias("unit")
    block = F.pmod(F.xxhash64("cid"), F.col("of")).cast("int")
    dealt = groups.join(large, "comp", "left").withColumn("of", F.coalesce("of", F.lit(1))).filter(F.col("of") <= SQUARE).withColumn("block", block)
    pairs = dealt.withColumn("pair", F.explode(block_pairs(F.col("block"), F.col("of"))))
    found = _checked(pairs.select(unit("comp", "pair"), "cid", F.col("block").alias("side")), sets, percent)
    huge = large.filter(F.col("of") > SQUARE)
    if huge.isEmpty():
        return found
    own = sized.join(huge, "comp").withColumn("block", block)
    spot = F.xxhash64("cid", F.lit(1))
    centres = own.groupBy("comp", "of", F.pmod(spot, F.lit(CENTRES))).agg(F.min_by("cid", spot).alias("cid")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    star = own.select(unit("comp", "block"), "cid", F.lit(1).alias("side")).unionAll(centres.select(unit("comp", "block"), "cid", F.lit(0).alias("side")))
    starred = stash(_checked(star, sets, percent), "join-starred")
    part = own.join(components(starred).withColumnRenamed("comp", "part"), "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    sizes = part.groupBy("comp", "part").agg(F.count("*").alias("of_part"))
    top = sizes.groupBy("comp").agg(F.max_by("part", F.struct("of_part", "part")).alias("top"))
    part = stash(part.join(top, "comp").select("comp", "cid", "_n", "of", "block", (F.col("part") != F.col("top")).alias("rest")), "join-parts")
    rests = part.filter("rest").groupBy("comp").agg(blocks.alias("rest_of"))
    every = part.join(rests, "comp")  # groups without a rest are done
    copies = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    all_rows = every.withColumn("rest_block", copies("rest_of")).select(unit("comp", "block", "rest_block"), "cid", F.lit(1).alias("side"))
    rest_rows = every.filter("rest").withColumn("rest_block", F.pmod(spot, F.col("rest_of")).cast("int")).withColumn("block", copies("of")).select(unit("comp", "block", "rest_block"), "cid", F.lit(0).alias("side"))
    return found.unionAll(starred).unionAll(_checked(all_rows.unionAll(rest_rows), sets, percent))


def _checked(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within each unit (unit, cid, side), between its sides if it has two."""
    schema = arrow_schema("a long, b long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solve(rows):
            pairs = [(rows[i][0], rows[j][0]) for i, j in link_forest([r[2].view(np.uint64) for r in rows], [r[1] for r in rows], percent)]
            pairs = [p for p in pairs if p[0] != p[1]]  # a class may stand on both sides
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

        now, rows = None, []
        for b in batches:
            keys, at = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_pylist()  # eight bytes a key
            for unit, cid, side, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), at, at[1:]):
                if unit != now and rows:
                    if len(rows) > 1:
                        yield solve(rows)
                    rows = []
                now = unit
                rows.append((cid, side, keys[i:j].copy()))
        if len(rows) > 1:
            yield solve(rows)

    # sets of two blocks at most meet in a task: 2 * GROUP classes
    session = units.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    met = units.join(sets, "cid").select("unit", "cid", "side", "keys").repartition(tasks, "unit").sortWithinPartitions("unit")
    return met.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """cid, comp (the smallest class id it reaches) of every class with an edge (a, b): least neighbours and pointer jumps in turn."""
    both = stash(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    labels = stash(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "join-labels")
    while True:
        near = both.join(labels.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cid").select("cid", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("cid").alias("new"), F.col("comp").alias("far"))
        nxt = stash(step.join(jump, "new", "left").select("cid", F.col("comp").alias("old"), F.least("new", F.coalesce("far", "new")).alias("comp")), "join-labels")
        done = nxt.filter("old != comp").isEmpty()
        labels = nxt.select("cid", "comp")
        if done:
            return labels


def class_sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """cid, keys of the wanted classes (cid), from the text of one document each. reps: cid, rep (a document id)."""
    ids = stash(wanted.join(reps, "cid").select(F.col("rep").alias("_rep")).distinct(), "join-ids")
    ids = F.broadcast(ids) if ids.count() <= SMALL else ids
    schema = arrow_schema("cid long, keys array<long>")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sets = [s for s in (shingle_set(t, words) for t in b.column(1).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], schema.field(1).type)], schema=schema)

    picked = texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    return picked.mapInArrow(run, "cid long, keys array<long>").dropDuplicates(["cid"])


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    return _row_components(docs, words, percent).drop("text_id")


def _row_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates with text_id, a hash of the row's text."""
    import numpy as np

    spark = docs.sparkSession
    scan = stash(_scan(docs, words, percent), "join-scan")
    thin = scan.filter("kind = 0").select("doc_id", "n", "cid", "text_id")
    reps = thin.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"))
    classes = scan.filter("kind = 0 and cid is not null").select("cid", "n", "marks").dropDuplicates(["cid"])
    often = scan.filter("kind = 1").groupBy("cid").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT)
    hot = np.sort(np.array([r.cid for r in often.orderBy(F.desc("n"), "cid").limit(HOT_KEYS).select("cid").collect()], np.int64).view(np.uint64))  # at most HOT_KEYS
    shared = stash(_shared(_first_rows(docs, hot, words, percent)), "join-shared")
    big = shared.groupBy("key").agg(F.count("*").alias("of")).filter(F.col("of") > UNIT).select("key", F.ceil(F.col("of") / F.lit(UNIT)).cast("int").alias("of"))
    dealt = shared.join(big, "key", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    dealt = dealt.select("key", "cid", F.explode(block_pairs(F.pmod(F.xxhash64("key", "cid"), F.col("of")).cast("int"), F.col("of"))).alias("sub"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shared.count() // 50_000))
    groups = components(stash(_candidates(dealt, classes, parts, percent), "join-candidates"))
    sets = stash(class_sets(docs, groups.select("cid"), reps, words), "join-sets")
    comp = components(stash(_links(groups, sets, percent), "join-links"))
    smallest = comp.join(reps, "cid").groupBy("comp").agg(F.min("rep").alias("least"))
    of_class = reps.join(comp, "cid", "left").join(smallest, "comp", "left").select("cid", F.coalesce("least", "rep").alias("component_id"))
    return thin.join(of_class, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those of a component that are not of its smallest doc_id. Rows go by doc_id and text: other texts
    under the doc_id (or without one) stay.

    A component of one doc_id keeps its rows as they are, and texts without words stay; a null doc_id is never the smallest, so its row
    goes when its component has another."""
    found = _row_components(docs, words, percent).filter("n_shingles > 0 and not (doc_id <=> component_id)")
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("text_id").alias("_gone_text")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_gone_text")), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _sql() -> str:
    return """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w WHERE ws IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 185 * k >= 85 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id, n.n"""


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL = {"op8_jaccard_join": _sql()}
