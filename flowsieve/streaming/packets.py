"""Packet analytics over time: per-second counts, running totals, telemetry joins and
per-attack windows - as batch DataFrame code and as Structured Streaming queries.

Streams use event time with a watermark and update mode: state holds only windows that the watermark
has not passed, and the checkpointed sink writes each micro-batch under its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def packets_per_window(df: DataFrame, ts: str = "ts", every: str = "1 second") -> DataFrame:
    """(window_start, packets) tumbling counts."""
    return df.groupBy(F.window(ts, every).start.alias("window_start")).agg(
        F.count(F.lit(1)).cast("bigint").alias("packets"))


def cumulative_counts(counts: DataFrame, ts: str = "window_start", n: str = "packets", block: str = "day") -> DataFrame:
    """Running total over windowed counts: running totals inside each ``block`` of time in parallel,
    plus the total of the blocks before (an ordered window over one row per block)."""
    d = counts.withColumn("_block", F.date_trunc(block, ts))
    totals = d.groupBy("_block").agg(F.sum(n).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_block", before.alias("_before"))
    w = Window.partitionBy("_block").orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = d.withColumn("_inside", F.sum(n).over(w)).join(totals, "_block")
    return inside.withColumn("cumulative", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_block", "_before", "_inside")


def packets_by_attack_window(df: DataFrame, ts: str = "ts", every: str = "1 hour", slide: str | None = None,
                             key: str = "attack_type", value: str = "volume") -> DataFrame:
    win = F.window(ts, every, slide) if slide else F.window(ts, every)
    return df.groupBy(win.start.alias("window_start"), F.col(key)).agg(
        F.count(F.lit(1)).cast("bigint").alias("packets"), F.sum(value).cast("bigint").alias("volume"))


def telemetry_join(pps: DataFrame, telemetry: DataFrame, ts: str = "ts") -> DataFrame:
    """(second, pps, n, cpu, ram): packet rates next to the batches of the same second.

    Stamps have milliseconds that never agree, so both sides are first brought to whole seconds: a batch
    header belongs to the second of its stamp (several: n adds up, cpu and ram are averaged); a
    line "received in last second" speaks of the second before its stamp (several: they add up)."""
    second = F.date_trunc("second", ts)
    rates = pps.groupBy((second - F.expr("INTERVAL 1 SECOND")).alias("second")).agg(F.sum("pps").cast("bigint").alias("pps"))
    batches = telemetry.groupBy(second.alias("second")).agg(F.sum("n").cast("int").alias("n"), F.avg("cpu").alias("cpu"),
                                                             F.avg("ram").alias("ram"))
    return rates.join(batches, "second")


# ------------------------------------------------------------------ streaming forms

def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``events`` as a file stream (a single file or a folder of files: a glob that matches only it takes
    both); the NTZ timestamp is cast to a session-zone timestamp so watermarks accept it.

    What is there is one micro-batch: files in any order of time never meet the watermark of files
    read before them. ``max_files_per_trigger`` is for files that arrive in order of time."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    s = reader.parquet(path[:-1] + "[t]")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stream(stream: DataFrame, aggregates: dict, out: str, checkpoint: str, every: str, keys: list[str] = (),
                    watermark: str = "10 minutes") -> str:
    """Windowed aggregates in update mode: each micro-batch writes the windows it changed under its own
    batch number, so a batch that is run again after a failure replaces itself, and state holds only the
    windows that the watermark has not passed. ``latest_windows`` reads the result."""
    agg = (stream.withWatermark("ts", watermark).groupBy(F.window("ts", every).start.alias("window_start"), *keys)
           .agg(*[c.alias(n) for n, c in aggregates.items()]))

    def sink(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest_windows(spark: SparkSession, out: str, keys: list[str] = ()) -> DataFrame:
    """The last written state of every (window, keys)."""
    d = spark.read.parquet(out)
    values = [c for c in d.columns if c not in ("batch", "window_start", *keys)]
    last = d.groupBy("window_start", *keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select("window_start", *keys, *[F.col(f"v.{c}").alias(c) for c in values])


def packets_per_window_stream(stream: DataFrame, out: str, checkpoint: str, every: str = "1 second", watermark: str = "10 minutes") -> str:
    """Streaming form of ``packets_per_window``; ``cumulative_counts`` of ``latest_windows`` gives the
    running totals so far."""
    return windowed_stream(stream, {"packets": F.count(F.lit(1)).cast("bigint")}, out, checkpoint, every, [], watermark)


def packets_by_attack_stream(stream: DataFrame, out: str, checkpoint: str, every: str = "1 hour", key: str = "attack_type",
                             value: str = "volume", watermark: str = "10 minutes") -> str:
    """Streaming form of ``packets_by_attack_window``."""
    aggs = {"packets": F.count(F.lit(1)).cast("bigint"), "volume": F.sum(value).cast("bigint")}
    return windowed_stream(stream, aggs, out, checkpoint, every, [key], watermark)


def windowed_counts_stream(stream: DataFrame, out: str, checkpoint: str, every: str = "1 hour",
                           key: str = "event_type", watermark: str = "10 minutes") -> str:
    aggs = {"n": F.count(F.lit(1)).cast("bigint"), "value_sum": F.sum("value")}
    return windowed_stream(stream, aggs, out, checkpoint, every, [key], watermark)
