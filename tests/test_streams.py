"""Windowed streams over more files than a limited micro-batch takes, in no order of time."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowsieve.plans import q_stream as Q

FILES = 1050


def _rows(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 389) % FILES, minutes=i % 60)


def test_events_in_a_folder_of_many_files(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    os.makedirs(folder)
    for i in range(FILES):
        pq.write_table(pa.table({"event_id": [i], "ts": pa.array([_rows(i)], pa.timestamp("us")), "event_type": ["view"], "value": [1.0]}),
                       folder / f"part-{i:05d}.parquet")
    got = Q.q_windowed_counts_stream(spark, str(tmp_path))
    assert got.agg(F.sum("n")).first()[0] == FILES and got.count() == FILES


def test_delivery_of_many_files(spark, monkeypatch, tmp_path):
    hour = (F.col("id") * 389) % FILES
    pk = spark.range(FILES * 12, numPartitions=FILES).select((F.lit(1704067200) + hour * 3600).cast("timestamp").alias("record_ts"))
    monkeypatch.setattr(Q, "_filled_packets", lambda *_: pk)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    class Enough(Exception):
        pass

    def run(stream):
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        got = Q.SP.latest_windows(spark, Q.SP.packets_per_window_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "1 hour"))
        found = got.agg(F.sum("packets").alias("n"), F.max("window_start").alias("last")).first()
        assert found.n == pk.where(F.col("record_ts") <= F.lit(found.last)).count() >= FILES * 3
        raise Enough
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # a file a task
    try:
        with pytest.raises(Enough):
            Q._packet_stream(spark, "")(run)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
