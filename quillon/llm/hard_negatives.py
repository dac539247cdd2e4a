"""Operator 13: hard negatives by exact inner products, searched through a table of pivot distances.

A vector x gains the coordinate sqrt(M^2 - |x|^2), M the largest norm, and an anchor q gains 0: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and a score is
a distance. PIVOTS augmented vectors, far from each other, are picked from a sample of SAMPLE rows. The pivot table, written once, holds every row's
distance to each pivot, rows lying near each other in one block; a block's least and largest distances stand in its row. By the triangle inequality
|d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), so the distances to the pivots bracket a score: blocks, then rows, that cannot matter to an anchor
are passed over, and the survivors' exact inner products decide.

Anchors are taken in passes of at most PASS_BYTES, which is what is broadcast. A pass reads the table twice: for each anchor's best rows of its own
label, then for the rows of other labels in the score range of each of its positives. Tasks keep the best few of each anchor; the sample's own scores
open the bounds, so that a task returns no more than what may still be among the best. What tasks return is cut down by partial top-k before it meets.

Every row is searched; the sample and the passes only decide how much is passed over at once.

Defined results: rows with a null id, label or vector, an empty vector, a null, NaN, infinite or very large entry (beyond 2^26 once scaled), or
another length than most rows take no part. Each of several equal rows is a row of its own: an anchor is not its own positive, an equal row is, and
anchors that occur twice give their rows twice. Anchors without positives, and positives without a negative in their range, give no rows; a positive
with a negative score has an empty range. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, carried, local_table, small_batches, stash, table

SCALE, LARGEST, PIVOTS, SAMPLE, BLOCK_ROWS, BLOCK_BYTES, PASS_BYTES = 256, 1 << 26, 16, 4096, 1024, 4 << 20, 32 << 20
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


def whole_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x (array of int) of the rows that take part, whatever their vectors' lengths."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / scale)
    good = rows.filter("vec_id is not null and label is not null and embedding is not null").filter((F.size("embedding") > 0) & F.forall("embedding", fine))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"))


def matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Pivots:
    """square: M^2 as an integer; x: pivots as rows; extra: their added coordinates."""

    square: int
    x: object
    extra: object

    @property
    def slack(self) -> float:
        """More than distances and their differences can be off by rounding to 32 bits."""
        return 1e-6 * max(1.0, self.square) ** 0.5

    def of_rows(self, x):
        """Distances of augmented rows to the pivots, 32-bit floats."""
        import numpy as np

        x = x.astype(np.float64)
        extra = np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * (self.square - x @ self.x.T - extra[:, None] * self.extra), 0)).astype(np.float32)

    def of_anchors(self, q):
        import numpy as np

        q = q.astype(np.float64)
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.square - 2 * (q @ self.x.T), 0)).astype(np.float32)


def pick_pivots(sample, square: int, count: int = PIVOTS) -> Pivots:
    """Augmented rows of the sample, each the farthest from those before it."""
    import numpy as np

    x = sample.astype(np.float64)
    extra = np.sqrt(np.maximum(square - (x * x).sum(1), 0))
    own = np.column_stack([x, extra])
    chosen, near = [0], np.full(len(own), np.inf)
    while len(chosen) < min(count, len(own)):
        near = np.minimum(near, ((own - own[chosen[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return Pivots(square, x[chosen], extra[chosen])


def pivot_table(rows: DataFrame, pivots: Pivots, d: int) -> DataFrame:
    """Rows in blocks of one label, near rows together: label, n, ids, x, far (binaries), and low, high (the block's range of each pivot's distance)."""
    placed, kept = arrow_schema("vec_id long, label long, x binary, far binary, cell int, near float"), carried(rows.sparkSession, pivots)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        pivots = kept()
        for b in batches:
            if len(b):
                x = matrix(b.column(2)).astype("<i4")
                far = pivots.of_rows(x)
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw(x), raw(far), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], schema=placed)

    blocks = arrow_schema("label long, n int, ids binary, x binary, far binary, low binary, high binary")
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * d)))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def block(label, ids, x, far):
            f = np.frombuffer(b"".join(far), "<f4").reshape(len(far), -1)
            row = [label, len(ids), np.array(ids, "<i8").tobytes(), b"".join(x), f.tobytes(), f.min(0).tobytes(), f.max(0).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, blocks)], schema=blocks)

        now, ids, x, far = None, [], [], []
        for b in batches:
            for i, label, v, f in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if ids and (label != now or len(ids) >= most):
                    yield block(now, ids, x, far)
                    ids, x, far = [], [], []
                now = label
                ids.append(i)
                x.append(v)
                far.append(f)
        if ids:
            yield block(now, ids, x, far)

    small_batches(rows.sparkSession)
    each = rows.select("vec_id", "label", "x").mapInArrow(place, "vec_id long, label long, x binary, far binary, cell int, near float")
    spot = F.xxhash64("vec_id")  # equal vectors are dealt to many tasks
    ordered = each.repartitionByRange("label", "cell", "near", spot).sortWithinPartitions("label", "cell", "near", spot)
    return stash(ordered.select("vec_id", "label", "x", "far").mapInArrow(pack, "label long, n int, ids binary, x binary, far binary, low binary, high binary"), "pivot-table")


@dataclass
class Anchors:
    """The anchors of one pass: ids, label, x; far: their distances to the pivots; norm: |q|^2."""

    ids: object
    label: object
    x: object
    far: object
    norm: object


def best(anchor, ids, score, keep: int):
    """Places of the first `keep` entries of each anchor: higher scores first, then smaller ids."""
    import numpy as np

    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    first = np.searchsorted(a, a)
    return order[np.arange(len(a)) - first < keep]


class Search:
    """Exact search of one pass's anchors in blocks of the pivot table.

    wanted: ranges of scores as (anchor, least, most) arrays; each range keeps its `keep` best rows. bound: the score of its keep-th best so far (its least
    score before). same: rows of the anchor's own label, else of other labels."""

    def __init__(self, anchors: Anchors, pivots: Pivots, wanted, keep: int, same: bool):
        import numpy as np

        self.anchors, self.pivots, self.keep, self.same = anchors, pivots, keep, same
        self.anchor, self.least, self.most = wanted
        self.bound = self.least.copy()
        self.exact_floats = float(pivots.square) * 4 < 2**53
        self.found = [np.zeros(0, np.int64) for _ in range(3)]  # range, id, score
        self.checked = self.seen = 0

    def limits(self):
        """The least bound and the largest upper end of each anchor's ranges; no ranges: nothing passes."""
        import numpy as np

        n = len(self.anchors.ids)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, self.anchor, self.bound.astype(np.float64))
        np.maximum.at(high, self.anchor, self.most.astype(np.float64))
        return low, high

    def block(self, label: int, ids, x, far, low, high) -> None:
        import numpy as np

        a, p, slack = self.anchors, self.pivots, self.pivots.slack
        least, most = self.limits()
        sq = a.norm + p.square
        off = 1e-9 * p.square + 1e-6
        score = lambda s, dist: (s - dist.astype(np.float64) ** 2) / 2
        gap = np.maximum(np.maximum(low - a.far, a.far - high).max(1) - slack, 0)
        reach = (a.far + high).min(1) + slack
        may = ((a.label == label) == self.same) & (score(sq, gap) + off >= least) & (score(sq, reach) - off <= most)
        self.seen += len(a.ids) * len(ids)
        for part in np.array_split(which := np.flatnonzero(may), -(-len(which) // 256)) if may.any() else []:
            gap, reach = np.zeros((len(part), len(ids)), np.float32), np.full((len(part), len(ids)), np.inf, np.float32)
            for k in range(far.shape[1]):
                own, there = a.far[part, k, None], far[None, :, k]
                np.maximum(gap, np.abs(own - there), out=gap)
                np.minimum(reach, own + there, out=reach)
            alive = (score(sq[part, None], np.maximum(gap - slack, 0)) + off >= least[part, None]) & (score(sq[part, None], reach + slack) - off <= most[part, None])
            rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(rows):
                continue
            q, r = a.x[part[rows]], x[cols]
            exact = (q.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64) if self.exact_floats else q.astype(np.int64) @ r.astype(np.int64).T
            alive = alive[np.ix_(rows, cols)]
            self.checked += int(alive.sum())
            self.take(part[rows], ids[cols], exact, alive)

    def take(self, anchor, ids, exact, alive) -> None:
        """Rows with exact scores, where alive: those in a range and not below its bound are kept."""
        import numpy as np

        row_of = np.full(len(self.anchors.ids), -1)
        row_of[anchor] = np.arange(len(anchor))
        ranges = np.flatnonzero(row_of[self.anchor] >= 0)
        for part in np.array_split(ranges, -(-len(ranges) // 512)) if len(ranges) else []:
            rows = row_of[self.anchor[part]]
            s = exact[rows]
            k, col = np.nonzero(alive[rows] & (s >= self.bound[part, None]) & (s <= self.most[part, None]))
            if len(k):
                self.add(part[k], ids[col], s[k, col])

    def add(self, which, ids, score) -> None:
        import numpy as np

        which, ids, score = (np.concatenate(x) for x in zip(self.found, (which, ids, score)))
        kept = best(which, ids, score, self.keep)
        self.found = [which[kept], ids[kept], score[kept]]
        of = self.found[0]
        last = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) == self.keep - 1)
        self.bound[of[last]] = np.maximum(self.bound[of[last]], self.found[2][last])


def searched(blocks: DataFrame, search: Search) -> DataFrame:
    """which (range), vec_id, score of the best rows of each range, over all blocks."""
    given, schema, keep = carried(blocks.sparkSession, search), arrow_schema("which long, vec_id long, score long"), search.keep

    def run(batches):
        import numpy as np
        import pyarrow as pa

        s = given()
        d, p = s.anchors.x.shape[1], s.anchors.far.shape[1]
        for b in batches:
            for label, n, ids, x, far, low, high in zip(*[c.to_pylist() for c in b.columns]):
                s.block(label, np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i4").reshape(n, d), np.frombuffer(far, "<f4").reshape(n, p), np.frombuffer(low, "<f4"), np.frombuffer(high, "<f4"))
        for i in range(0, len(s.found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in s.found], schema=schema)

    small_batches(blocks.sparkSession, 8)
    each = blocks.select("label", "n", "ids", "x", "far", "low", "high").mapInArrow(run, "which long, vec_id long, score long")
    order = Window.partitionBy("which").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def opened(search: Search, label, ids, x) -> Search:
    """The same search with bounds from the sample's own rows, which are rows of the table; what it found is forgotten, as the table holds it too."""
    import numpy as np

    a = search.anchors
    for part in np.array_split(np.arange(len(a.ids)), -(-len(a.ids) // 256)):
        exact = a.x[part].astype(np.int64) @ x.astype(np.int64).T if not search.exact_floats else (a.x[part].astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        search.take(part, ids, exact, (a.label[part, None] == label[None, :]) == search.same)
    search.found = [np.zeros(0, np.int64) for _ in range(3)]
    return search


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (is_anchor, over vec_id and label) and each of its best
    `positives` other rows of its label, the best `negatives` rows of other labels with low % <= score / positive score <= high %.

    rows(vec_id, label, x): x are integers of one length but for rows that take no part."""
    import numpy as np

    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))  # a row a length
    d = lengths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first().d
    if not d:
        return local_table(spark, [], RESULT)
    rows = rows.filter(F.size("x") == d).select("vec_id", "label", "x", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v)
    found = rows.agg(F.max(norm).alias("square"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "label", "x").toArrow().combine_chunks()
    s_ids, s_label, s_x = some.column(0).to_numpy(), some.column(1).to_numpy(), matrix(some.column(2).combine_chunks())
    pivots = pick_pivots(s_x, found.square)
    blocks = pivot_table(rows, pivots, d)
    passes = max(1, -(-found.anchors * (4 * d + 400) // pass_bytes))
    results = []
    for k in range(passes):
        own = rows.filter(F.col("anchor") & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == k)).select("vec_id", "label", "x").toArrow().combine_chunks()
        if not len(own):
            continue
        x = matrix(own.column(2).combine_chunks()).astype(np.int32)
        wide = x.astype(np.int64)
        anchors = Anchors(own.column(0).to_numpy(), own.column(1).to_numpy(), x, pivots.of_anchors(x), (wide * wide).sum(1))
        # positives: one range of all scores an anchor; one more is kept, as the anchor itself is among them
        n = len(x)
        everything = (np.arange(n), np.full(n, -(1 << 62)), np.full(n, 1 << 62))
        near = searched(blocks, opened(Search(anchors, pivots, everything, positives + 1, True), s_label, s_ids, s_x)).select("which", "vec_id", "score").toArrow()
        of, ids, score = (near.column(c).to_numpy() for c in ("which", "vec_id", "score"))
        order = np.lexsort((ids, -score, of))
        of, ids, score = of[order], ids[order], score[order]
        self_at = np.flatnonzero((ids == anchors.ids[of]) & (score == anchors.norm[of]))
        others = np.delete(np.arange(len(of)), self_at[np.unique(of[self_at], return_index=True)[1]])
        others = others[np.arange(len(others)) - np.searchsorted(of[others], of[others]) < positives]
        of, ids, score = of[others], ids[others], score[others]
        fit = score >= 0
        of, ids, score = of[fit], ids[fit], score[fit]
        ranges = (of, -((-low * score) // 100), high * score // 100)
        hits = searched(blocks, opened(Search(anchors, pivots, ranges, negatives, False), s_label, s_ids, s_x))
        names = local_table(spark, list(zip(range(len(of)), anchors.ids[of].tolist(), ids.tolist(), score.tolist())), "which long, anchor_id long, positive_id long, positive_score long")
        result = hits.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(names), "which")
        result = result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        results.append(stash(result, "hard-negatives") if passes > 1 else result)
    out = results[0] if results else local_table(spark, [], RESULT)
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_rows(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}

SQL = {
    "op13_hard_negatives": f"""WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
met AS (SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score FROM positive p JOIN pairs n USING (anchor_id)
  WHERE NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INT) AS rank FROM met)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}""",
}
