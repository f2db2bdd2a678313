"""Structured Streaming over flow files: incremental scan and incremental scoring.

The stream carries the paths of the files that arrive; each micro-batch looks its files' headers up and reads
them joined by name, so a file keeps its values in place whatever its column order, whenever it lands and
whichever run picks it up. A micro-batch writes under its own number and replaces itself when it is run again
(exactly once across restarts and executor loss); ``trigger(availableNow=True)`` processes everything present
and stops, which is how a batch of arriving files is scored on a schedule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.util import qcol
from flowsieve.sources.flows import FLOW_TYPES, read_flow_csv

PATHS = "path string, modificationTime timestamp, length bigint, content binary"  # of a file stream that reads no content


def arriving_files(spark: SparkSession, src: str, handle: Callable[[list[str], int], None], checkpoint: str, max_files_per_trigger: int = 1000) -> None:
    """``handle(files, number)`` for each micro-batch of CSV files that ``checkpoint`` has not seen, then stop."""
    paths = (spark.readStream.format("binaryFile").schema(PATHS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(src).select("path", "length"))

    def run(batch: DataFrame, number: int):
        files = sorted(r.path for r in batch.where("length > 0").collect())  # bounded by max_files_per_trigger
        if files:
            handle(files, number)

    paths.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_columns(df: DataFrame, names, types: dict) -> DataFrame:
    """``df`` with the columns ``names`` that it lacks as nulls."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(None).cast(types.get(n, "string")).alias(n) for n in names if n.lower() not in have])


def run_to_parquet(spark: SparkSession, src: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, columns,
                   types: dict | None = None, max_files_per_trigger: int = 1000) -> str:
    """Flow files as they arrive -> ``transform`` -> a folder for each micro-batch below ``out``. ``columns``
    are there in every micro-batch, as nulls where its files lack them."""
    types = dict(FLOW_TYPES, **(types or {}))

    def handle(files: list[str], number: int):
        rows = with_columns(read_flow_csv(spark, files, types), columns, types)
        transform(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arriving_files(spark, src, handle, checkpoint, max_files_per_trigger)
    return out


def read_output(spark: SparkSession, out: str) -> DataFrame:
    """All micro-batches written so far."""
    return spark.read.parquet(out).drop("batch")


def stream_flow_csv_to_parquet(spark: SparkSession, src: str, out: str, checkpoint: str, columns: list[str], **options) -> str:
    return run_to_parquet(spark, src, lambda df: df.select(*[qcol(c) for c in columns]), out, checkpoint, columns, **options)


def score_stream(spark: SparkSession, src: str, prepare, model, out: str, checkpoint: str, columns=tuple(FLOW_TYPES), **options) -> str:
    """Arriving files -> ``prepare`` (same column expressions as batch) -> fitted model -> parquet."""
    return run_to_parquet(spark, src, lambda df: model(prepare(df)), out, checkpoint, columns, **options)
