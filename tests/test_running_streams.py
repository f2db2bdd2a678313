"""Stateful streams against their batch forms: after every delivery, with late rows and restarts."""

import datetime as dt
import random

from flowsieve.streaming import packets as SP
from flowsieve.streaming import running as SR

START = dt.datetime(2024, 1, 1)


def _deliver(spark, folder, seconds):
    rows = [(START + dt.timedelta(seconds=s),) for s in seconds]
    spark.createDataFrame(rows, "ts timestamp").repartition(2).write.mode("append").parquet(folder)


def test_running_totals_after_every_delivery(spark, tmp_path):
    """Every run is a restart from the checkpoint. The third delivery brings rows of earlier windows within the
    watermark and rows later than it, which are left out."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rng, kept = random.Random(5), []
    deliveries = [[rng.randint(0, 1200) for _ in range(400)] + [1200], [rng.randint(700, 2400) for _ in range(300)] + [2400],
                  [1900, 1901, 1901, 2399, 100, 101, 3000], [rng.randint(2500, 9000) for _ in range(200)]]
    late = {100, 101}
    for part in deliveries:
        _deliver(spark, src, part)
        kept += [s for s in part if not (part is deliveries[2] and s in late)]
        SR.running_totals_stream(spark.readStream.schema("ts timestamp").parquet(src), out, ck, "10 seconds")
        got = [(r.window_start, r.packets, r.cumulative) for r in SP.latest_windows(spark, out).orderBy("window_start").collect()]
        want, total = [], 0
        for w in sorted({s // 10 * 10 for s in kept}):
            n = sum(s // 10 * 10 == w for s in kept)
            total += n
            want.append((START + dt.timedelta(seconds=w), n, total))
        assert got == want
    state = spark.read.format("statestore").option("path", ck).option("stateVarName", "open").load().count()
    assert state < 200  # windows of the last delivery's ten minutes and what it brought, not all


def test_running_totals_of_nothing(spark, tmp_path):
    _deliver(spark, str(tmp_path / "in"), [])
    SR.running_totals_stream(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))


def _telemetry(spark, tmp_path, part):
    rates = [(START + dt.timedelta(seconds=s + 1, milliseconds=130), p) for s, p, *_ in part]
    heads = [(START + dt.timedelta(seconds=s, milliseconds=123), n, c, m) for s, _, n, c, m in part]
    spark.createDataFrame(rates, "ts timestamp, pps long").write.mode("append").parquet(str(tmp_path / "rates"))
    spark.createDataFrame(heads, "ts timestamp, n int, cpu double, ram double").write.mode("append").parquet(str(tmp_path / "heads"))


def test_telemetry_join_equals_the_batch_form(spark, tmp_path):
    """Three deliveries, several lines a second, rows late within the watermark; a heartbeat closes the last seconds."""
    rng = random.Random(8)
    row = lambda s: (s, rng.randint(1, 9), rng.randint(1, 9), rng.randint(0, 8) / 2, rng.randint(0, 8) / 4)
    deliveries = [[row(rng.randint(0, 900)) for _ in range(150)], [row(rng.randint(600, 1800)) for _ in range(150)],
                  [row(rng.randint(1500, 2400)) for _ in range(100)]]
    out, ck, rows = str(tmp_path / "out"), str(tmp_path / "ck"), []

    def run():
        stream = lambda n, s: spark.readStream.schema(s).parquet(str(tmp_path / n))
        SR.telemetry_join_stream(stream("rates", "ts timestamp, pps long"), stream("heads", "ts timestamp, n int, cpu double, ram double"), out, ck)
    for part in deliveries:
        _telemetry(spark, tmp_path, part)
        run()
    batch = SP.telemetry_join(spark.read.parquet(str(tmp_path / "rates")), spark.read.parquet(str(tmp_path / "heads"))).collect()
    _telemetry(spark, tmp_path, [(90_000, 0, 0, 0.0, 0.0)])
    run()
    rows = spark.read.parquet(out).drop("batch").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, batch)) and len(rows) > 250
