"""Running totals and the telemetry join as live streams.

Both keep what the watermark has not passed and nothing else: a row later than the watermark is left out, as
in every windowed stream; one within it corrects the results it belongs to. Each micro-batch writes under its own
number, so that a run that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


def _run(df: DataFrame, mode: str, out: str, checkpoint: str) -> str:
    def sink(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return out


def counted_in_tasks(stream: DataFrame, ts: str, every: str) -> DataFrame:
    """(window_start, n): a task's rows of each window as one row, so that what meets in the totals is
    a few rows a task, however many packets there are."""
    starts = stream.where(F.col(ts).isNotNull()).select(F.window(ts, every).start.alias("window_start"))

    def run(batches):
        found, kind = Counter(), None
        for b in batches:
            kind = b.schema.field("window_start").type
            for entry in b.column("window_start").value_counts().to_pylist():
                found[entry["values"]] += entry["counts"]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), pa.int64())], ["window_start", "n"])

    return starts.mapInArrow(run, "window_start timestamp, n long")


class RunningTotal(StatefulProcessor):
    """Counts of the open windows and the total of those that the watermark has passed. New counts change the
    totals of their window and of all later open ones; these are what is emitted."""

    def init(self, handle) -> None:
        self.closed = handle.getValueState("closed", "total long")
        self.open = handle.getMapState("open", "window_us long", "n long")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        total = self.closed.get()[0] if self.closed.exists() else 0
        counts = {w[0]: n[0] for w, n in self.open.iterator()} if self.open.exists() else {}
        for w in sorted(counts):
            if w < passed:
                total += counts.pop(w)
                self.open.removeKey((w,))
        self.closed.update((total,))
        new: Counter = Counter()
        for pdf in rows:
            stamps = pdf["window_start"].astype("datetime64[us]").astype("int64")
            for w, n in zip(stamps.tolist(), pdf["n"].tolist(), strict=True):
                if w >= passed:
                    new[w] += n
        for w, n in new.items():
            counts[w] = counts.get(w, 0) + n
            self.open.updateValue((w,), (counts[w],))
        out = []
        for w in sorted(counts):
            total += counts[w]
            if new and w >= min(new):
                out.append((pd.Timestamp(w, unit="us"), counts[w], total))
        yield pd.DataFrame(out, columns=["window_start", "packets", "cumulative"])

    def close(self) -> None:
        pass


def running_totals_stream(stream: DataFrame, out: str, checkpoint: str, every: str = "1 second", ts: str = "ts", watermark: str = "10 minutes") -> str:
    """Per window: packets, and all packets up to its end. After every micro-batch ``latest_windows`` of ``out``
    is right for what has arrived. A window stays open until the watermark (the latest window's start less
    ``watermark``) has passed its start; state holds the open windows and one total."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    counts = counted_in_tasks(stream, ts, every).withWatermark("window_start", watermark).withColumn("stream", F.lit(0))
    totals = counts.groupBy("stream").transformWithStateInPandas(
        RunningTotal(), "window_start timestamp, packets long, cumulative long", "Update", "EventTime")
    conf.set(PROVIDER, ROCKS)  # the only store with maps and values of named states
    try:
        return _run(totals, "update", out, checkpoint)
    finally:
        conf.set(PROVIDER, before)


def telemetry_join_stream(rates: DataFrame, batches: DataFrame, out: str, checkpoint: str, ts: str = "ts", watermark: str = "10 minutes") -> str:
    """Streaming form of ``telemetry_join``: packet rates (ts, pps) next to the batches (ts, n, cpu, ram) of the same
    second. Both sides are aggregated by second under a watermark and joined; a second is written once, when the
    watermark of both streams has passed it, and then leaves the state."""
    rates = rates.withColumn("at", F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 SECOND")).withWatermark("at", watermark)
    rates = rates.groupBy(F.window("at", "1 second")).agg(F.sum("pps").cast("bigint").alias("pps"))
    batches = batches.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", watermark)
    batches = batches.groupBy(F.window("at", "1 second")).agg(F.sum("n").cast("int").alias("n"), F.avg("cpu").alias("cpu"), F.avg("ram").alias("ram"))
    joined = rates.join(batches, "window").select(F.col("window.start").alias("second"), "pps", "n", "cpu", "ram")
    # every partition of the state writes its files in every micro-batch, however few its rows: two a core
    conf = joined.sparkSession.conf
    before = conf.get(PARTITIONS)
    conf.set(PARTITIONS, str(min(int(before), 2 * joined.sparkSession.sparkContext.defaultParallelism)))
    try:
        return _run(joined, "append", out, checkpoint)
    finally:
        conf.set(PARTITIONS, before)
