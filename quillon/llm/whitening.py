"""Operator 11: embedding whitening by an exact two-pass covariance.

Entries become whole numbers x = floor(scale * c) + shift. The fit list, each distinct x vector once, is written to the shared folder; three passes read
it. The first sums the entries as integers, which is exact in any order. The second sums outer products of the centred vectors by matrix multiplication in
each task; a vector is centred as (n * x - S) / n, whose numerator is an exact integer, so that nothing cancels. The third measures the whitened
fit list's own covariance. Each task gives one partial result, and partial results are merged in a tree of tasks (treeAggregate), so that the driver
receives sums of the size dimensions x dimensions and never one a task. The driver's symmetric eigensolver gives the components; their matrix (dimensions x
components) is broadcast, and all rows are projected without a shuffle.

Components are numbered from 1 by falling eigenvalue; the entry of the largest size is positive. An eigenvalue that is zero up to rounding gives no component.

Defined results: a row takes no part if its vector is null, empty, holds a null, a NaN, an infinity or an entry whose x is no long, or has another length than
most rows (of equally many, the longer length). Null ids stay; repeated rows come back as often as they are but are fitted once; rows of
an empty table, or of one where all vectors are equal, have no components and so no result. A deviation beyond a long is null. Columns other than vec_id
and embedding are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, small_batches, stash, table

SCALE, SHIFT, COMPONENTS, LONG, FAN_IN = 64, 1_000_000, 16, 1 << 63, 32


def whole_vectors(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (array of long) of the rows that take part, whatever their vectors' lengths."""
    most = float((1 << 62) // scale)
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < most)
    good = rows.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine))
    return good.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x"))


def of_usual_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the commonest length, and that length (0 without vectors)."""
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))  # a row a length
    top = lengths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first().d or 0
    return vectors.filter(F.size("x") == top), top


def matrix(column):
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def numerators(x, n: int, sums: list[int]):
    """n * x - S, exact: 64-bit integers where these suffice, else Python's."""
    import numpy as np

    largest = max(abs(int(x.max())), abs(int(x.min())), 1) if x.size else 1
    wide = n * largest + max(map(abs, sums), default=0) >= LONG
    return (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)


def merged(vectors: DataFrame, each, schema: str, read, add):
    """each(batches of matrices) gives one row a task; read makes it a value; values are added in a tree of tasks. None without rows."""
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        row = each(matrix(b.column(0)) for b in batches if len(b))
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    small_batches(vectors.sparkSession)
    parts = vectors.select("x").mapInArrow(run, schema).rdd.map(read)
    both = lambda a, b: b if a is None else a if b is None else add(a, b)
    return parts.treeAggregate(None, both, both, max(2, math.ceil(math.log(max(2, parts.getNumPartitions()), FAN_IN))))


def integer_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(how many vectors, the sum of each dimension), exact."""

    def each(matrices):
        n, sums = 0, [0] * d
        for x in matrices:
            n += len(x)
            wide = max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= LONG
            sums = [a + int(b) for a, b in zip(sums, (x.astype(object) if wide else x).sum(0))]
        return (n, [str(s) for s in sums]) if n else None

    read = lambda r: (r.n, [int(s) for s in r.sums])
    found = merged(fit, each, "n long, sums array<string>", read, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]))
    return found or (0, [0] * d)


def outer_products(fit: DataFrame, n: int, sums: list[int], project=None):
    """(sum of outer products, sum) of the centred vectors, or of their projections."""
    import numpy as np

    def each(matrices):
        total, first = None, None
        for x in matrices:
            c = numerators(x, n, sums).astype(np.float64) / n
            c = c if project is None else c @ project.value
            total, first = (c.T @ c, c.sum(0)) if total is None else (total + c.T @ c, first + c.sum(0))
        return None if total is None else (total.tobytes(), first.tobytes())

    def read(r):
        first = np.frombuffer(r.first)
        return np.frombuffer(r.total).reshape(len(first), -1), first

    return merged(fit, each, "total binary, first binary", read, lambda a, b: (a[0] + b[0], a[1] + b[1]))


@dataclass
class Whitening:
    """n and sums of the fit list; projection: dimensions x components, each divided by the root of its eigenvalue."""

    n: int
    sums: list[int]
    projection: object
    explained: list[float]
    identity_error: float | None


def fit_whitening(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors (x) of d entries."""
    import numpy as np

    fit = stash(vectors.select("x").distinct(), "whitening-fit")
    n, sums = integer_sums(fit, d)
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), [], None)
    v = outer_products(fit, n, sums)[0] / n
    value, vector = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-value, kind="stable")[:components]
    order = order[value[order] > max(value.max(), 0) * d * np.finfo(float).eps]
    chosen = vector[:, order]
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    model = Whitening(n, sums, chosen / np.sqrt(value[order]), (value[order] / np.trace(v)).tolist(), None)
    if len(order):
        total, first = outer_products(fit, n, sums, vectors.sparkSession.sparkContext.broadcast(model.projection))
        model.identity_error = float(np.abs(total / n - np.outer(first / n, first / n) - np.eye(len(order))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (the exact sum over dimensions of (n * x - S)^2), whitened (array of double, a component each)."""
    known = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.projection))
    rows = vectors.select("vec_id", "x")
    schema = arrow_schema(ddl := f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, sums, projection = known.value
        for b in batches:
            if not len(b):
                continue
            part = numerators(matrix(b.column(1)), n, sums)
            largest = int(np.abs(part).max())
            squares = ((part.astype(object) if largest * largest * part.shape[1] >= LONG else part) ** 2).sum(1)
            deviation = [int(s) if s < LONG else None for s in squares]
            found = (part.astype(np.float64) / n) @ projection
            ends = np.arange(len(b) + 1, dtype=np.int32) * found.shape[1]
            whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), whitened.cast(schema.field(2).type)], schema=schema)

    small_batches(vectors.sparkSession)
    return rows.mapInArrow(run, ddl)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, d = of_usual_length(whole_vectors(table(spark, sf_dir, "embeddings")))
    model = fit_whitening(vectors, d)
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array(F.lit(None).cast("double"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}
