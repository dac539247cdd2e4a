"""Reads that arrive as a stream, aligned to a fixed reference in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.stored import StoredIndex, indexed_matches
from quillon.plans.config import AlignConfig
from quillon.plans.run import align_reads, reported


def align_stream(text: DataFrame | StoredIndex, reads: DataFrame, config: AlignConfig, path: str, checkpoint: str, policy: str = "canonical") -> StreamingQuery:
    """Start a query that writes each micro-batch's report as Parquet under path/batch=N; a batch that is run again replaces its own folder.

    From a stored index a batch shuffles its own rows alone; from fragments it goes over the text."""

    def report(batch: DataFrame) -> DataFrame:
        if isinstance(text, StoredIndex):
            return reported(indexed_matches(text, batch, config), batch, config, policy, text.names)
        return align_reads(text, batch, config, policy)

    def each(batch: DataFrame, number: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
