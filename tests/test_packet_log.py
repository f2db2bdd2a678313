"""Packet-log parsing and the split-safe forward fill."""

import datetime as dt
import os
import tempfile

from flowsieve.sources import packet_log as PL

LOG = """2024-01-01 00:00:00,123 - Batch processed 2 packets. CPU: 12.5%, RAM: 40.1%
Received Packet 00000001 | Source IP: 1.2.3.4 | Destination IP: 10.0.0.50 | Source Port: 1024 | Destination Port: 80 | Protocol: TCP | Flags: SYN | TTL: 64 | Volume: 100 | Spoofed: 1 | Attack Type: SYN_Flood
Received Packet garbage | Source IP: n/a
Received Packet 00000002 | Source IP: 5.6.7.8 | Destination IP: 10.0.0.50 | Source Port: 2000 | Destination Port: 53 | Protocol: UDP | Flags:  | TTL: 32 | Volume: 900 | Spoofed: 0 | Attack Type: UDP_Flood
2024-01-01 00:00:01,130 - Packets received in last second: 2
"""


def _write(text, name="server.log"):
    d = tempfile.mkdtemp(prefix="flowsieve-log-")
    with open(os.path.join(d, name), "w") as f:
        f.write(text)
    return d


def test_parse_packets_and_telemetry(spark):
    lines = PL.read_log_lines(spark, _write(LOG))
    pk = sorted(PL.parse_packets(lines).collect(), key=lambda r: r.packet_id)
    assert [r.packet_id for r in pk] == ["00000001", "00000002"]
    assert (pk[0].source_ip, pk[0].flags, pk[0].ttl, pk[0].spoofed) == (16909060, 1, 64, 1)
    assert (pk[1].flags, pk[1].volume, pk[1].protocol) == (0, 900, "UDP")
    h = PL.parse_headers(lines).first()
    assert (h.n, h.cpu, h.ram) == (2, 12.5, 40.1) and h.ts == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert PL.parse_pps(lines).first().pps == 2


def test_ffill_across_small_splits(spark):
    # many records; tiny splits so that records straddle split boundaries
    recs = []
    for m in range(60):
        recs.append(f"2024-01-01 00:{m:02d}:00,000 - Batch processed 3 packets. CPU: 1.0%, RAM: 2.0%")
        for k in range(3):
            pid = m * 3 + k
            recs.append(f"Received Packet {pid:08d} | Source IP: 1.2.3.4 | Destination IP: 10.0.0.50 | Source Port: 1 | "
                        f"Destination Port: 2 | Protocol: TCP | Flags: ACK | TTL: 3 | Volume: 4 | Spoofed: 0 | "
                        f"Attack Type: X")
    path = _write("\n".join(recs) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = PL.read_log_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5
        got = {r.packet_id: r.record_ts for r in
               PL.parse_packets(PL.ffill_record_time(lines), keep=["record_ts"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 180
    for pid, ts in got.items():
        assert ts == dt.datetime(2024, 1, 1, 0, int(pid) // 3, 0)


def test_telemetry_joins_by_second(spark):
    from flowsieve.streaming import packets as SP
    log = LOG + "2024-01-01 00:00:01,010 - Batch processed 3 packets. CPU: 20.5%, RAM: 50.1%\n"
    lines = PL.read_log_lines(spark, _write(log))
    r = SP.telemetry_join(PL.parse_pps(lines), PL.parse_headers(lines)).collect()
    assert [tuple(x) for x in r] == [(dt.datetime(2024, 1, 1), 2, 2, 12.5, 40.1)]


def test_long_packet_ids_stay_whole(spark):
    from pyspark.sql import functions as F
    from flowsieve.plans.q_stream import _padded
    df = spark.createDataFrame([(7,), (123456789,), (123456780,)], "n long").select(_padded(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["00000007", "123456789", "123456780"]


def test_cumulative_counts_across_blocks(spark):
    from pyspark.sql import functions as F
    from flowsieve.streaming import packets as SP
    c = spark.range(200).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("id").cast("int"))).alias("window_start"),
                                (F.col("id") % 5).alias("packets"))
    got = [r.cumulative for r in SP.cumulative_counts(c).orderBy("window_start").collect()]
    want, total = [], 0
    for i in range(200):
        total += i % 5
        want.append(total)
    assert got == want
