"""What the operators of this package share: tables, the scratch store and folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, else a temporary one (local sessions only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillon-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/quillon/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """Write df to the shared folder as a table bucketed by key and read it back: a later join or grouping by key does not shuffle it."""
    spark, name, path = df.sparkSession, f"quillon_{uuid.uuid4().hex}", scratch_path(df.sparkSession, what)
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    back = spark.table(name)
    back.schema  # resolved, so that the catalog may forget the name; the files stay
    spark.sql(f"DROP TABLE {name}")
    return back


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table this package wrote to the shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{scratch_dir(spark)}/quillon")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; needs the driver's session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of driver parameters whose exact size Catalyst knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema=spark_schema)


def fold(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Arrow batches of few rows and bytes from now on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone; small Arrow batches, so that a batch of very long texts fits a Python worker."""
    spark = docs.sparkSession
    small_batches(spark)
    return docs.select("doc_id", "text", *more)


def grouped(batches, column: int, size: int):
    """Arrow batches joined until their column (of strings) holds about size bytes, so that work on distinct words has many to share."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            group, held, n = pa.concat_batches(held), [], 0
            yield group
            del b, group  # or they would stay while the next ones come
    if held:
        yield pa.concat_batches(held)


def spread(starts, sizes, codes):
    """Positions of the items of runs (starts, sizes), one run after the other in the order of codes."""
    import numpy as np

    n = sizes[codes]
    return np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def carried(spark: SparkSession, value):
    """value as a broadcast variable, classes of this package by value; the function gives it back in a task."""
    from pyspark import cloudpickle

    given = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(given.value)


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow over lists: make() once a task gives a function from a batch's columns (lists) to the output's columns (lists)."""
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        each = make()
        for batch in batches:
            columns = each(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
