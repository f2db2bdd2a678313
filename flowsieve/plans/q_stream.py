"""Packet-log and streaming (2.12) queries.

The packet log is rendered from ``events`` (one packet per event, one batch record per
minute: header line, packet lines, a malformed line now and then, and a per-record
rate line), written as text, and parsed back - so every query on it reads text that
grows with the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowsieve.operators import naive_bayes as nb
from flowsieve.operators.sampling import split_two
from flowsieve.plans.adapters import sql, table
from flowsieve.plans.common import BASE_CTES, PREP_FEATURES, prepare, prepared_flows
from flowsieve.plans.q_eval import _nb_sql_ctes
from flowsieve.plans.registry import register
from flowsieve.session import scratch_path
from flowsieve.sources import packet_log as PL
from flowsieve.streaming import packets as SP
from flowsieve.streaming import running as SR

TYPES = ["click", "view", "purchase", "signup", "error"]
PORTS = {"click": 80, "view": 443, "purchase": 8443, "signup": 53, "error": 123}
PROTO = {"signup": "UDP", "error": "ICMP"}
ATTACK = {"click": "SYN_Flood", "view": "UDP_Flood", "purchase": "HTTP_Flood", "signup": "DNS_Amplification",
          "error": "ICMP_Flood"}
FLAGS = ["SYN", "SYN,ACK", "", "ACK"]


def _case(col, mapping, default):
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _padded(n):
    """At least eight digits; longer ids stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= 8, s).otherwise(F.lpad(s, 8, "0"))


def packet_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    minute = F.date_trunc("minute", F.col("ts"))
    uid = F.col("user_id")
    sip = F.concat_ws(".", F.lit("172"), F.lit("16"), F.expr("(user_id div 256) % 256"), uid % 256)
    flags = F.element_at(F.array(*[F.lit(f) for f in FLAGS]), (eid % 4 + 1).cast("int"))
    ttl = (F.lit(32) + eid % 97)
    line = F.concat_ws(" | ", F.concat(F.lit("Received Packet "), _padded(eid)),
                       F.concat(F.lit("Source IP: "), sip), F.lit("Destination IP: 10.0.0.50"),
                       F.concat(F.lit("Source Port: "), (F.lit(1024) + eid % 60000).cast("string")),
                       F.concat(F.lit("Destination Port: "), _case(et, PORTS, 0).cast("string")),
                       F.concat(F.lit("Protocol: "), _case(et, PROTO, "TCP")),
                       F.concat(F.lit("Flags: "), flags),
                       F.concat(F.lit("TTL: "), ttl.cast("string")),
                       F.concat(F.lit("Volume: "), F.floor(F.col("value") * 100).cast("bigint").cast("string")),
                       F.concat(F.lit("Spoofed: "), (eid % 2).cast("string")),
                       F.concat(F.lit("Attack Type: "), _case(et, ATTACK, "Unknown")))
    packets = e.select(minute.alias("minute"), F.lit(1).alias("kind"), eid.alias("seq"), line.alias("line"))
    bad = e.where(eid % 50 == 0).select(minute.alias("minute"), F.lit(1).alias("kind"), eid.alias("seq"),
                                        F.lit("Received Packet ???? | Source IP: n/a").alias("line"))
    per_min = e.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.sum(ttl).alias("ttl_sum"))
    # the header's stamp, and that of the rate line a second later
    stamp_h = F.concat(F.date_format("minute", "yyyy-MM-dd HH:mm:ss"), F.lit(",123"))
    stamp_r = F.concat(F.date_format(F.expr("minute + INTERVAL 1 SECOND"), "yyyy-MM-dd HH:mm:ss"), F.lit(",130"))
    cpu = (F.col("n") * 37) % 1000
    ram = F.col("ttl_sum") % 1000
    dec = lambda c: F.concat((c / 10).cast("bigint").cast("string"), F.lit("."), (c % 10).cast("string"))
    hdr = per_min.select("minute", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("seq"),
                         F.concat(stamp_h, F.lit(" - Batch processed "), F.col("n").cast("string"),
                                  F.lit(" packets. CPU: "), dec(cpu), F.lit("%, RAM: "), dec(ram),
                                  F.lit("%")).alias("line"))
    pps = per_min.select("minute", F.lit(2).alias("kind"), F.lit(-1).cast("bigint").alias("seq"),
                         F.concat(stamp_r, F.lit(" - Packets received in last second: "),
                                  F.col("n").cast("string")).alias("line"))
    return hdr.unionByName(packets).unionByName(bad).unionByName(pps)


def write_packet_log(spark, sf_dir):
    """Whole records per file, in time order: range-partition by minute (as many files as the session
    has shuffle partitions), sort inside."""
    path = scratch_path(spark, "packet-log")
    lines = packet_lines(spark, sf_dir)
    (lines.repartitionByRange("minute").sortWithinPartitions("minute", "kind", "seq")
     .select("line").write.mode("overwrite").text(path))
    return path


def _lines(spark, sf_dir):
    return PL.read_log_lines(spark, write_packet_log(spark, sf_dir))


def _filled_packets(spark, sf_dir):
    """Forward-fill, then parse."""
    return PL.parse_packets(PL.ffill_record_time(_lines(spark, sf_dir)), keep=["record_ts"])


def _packet_stream(spark, sf_dir):
    """Parsed packets with their record time, arriving in three deliveries of several files each: a
    function that runs a stream once after each of them. The files of a delivery are in no order of time, so
    each delivery is one micro-batch, however many files it has."""
    src = scratch_path(spark, "packet-stream")
    pk = _filled_packets(spark, sf_dir).withColumn("ts", F.col("record_ts").cast("timestamp"))
    path = scratch_path(spark, "packets-filled")
    pk.write.parquet(path)
    pk = spark.read.parquet(path)
    cuts = pk.agg(F.percentile_approx(F.col("ts").cast("double"), [1 / 3, 2 / 3])).first()[0] or [0.0, 0.0]
    at = F.when(F.col("ts").cast("double") < cuts[0], 0).when(F.col("ts").cast("double") < cuts[1], 1).otherwise(2)

    def deliver(run):
        for part in range(3):
            pk.where(at == part).write.mode("append").parquet(src)
            run(spark.readStream.schema(pk.schema).parquet(src))
    return deliver


def _sql_case(col, mapping, default):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" if isinstance(v, str) else f"WHEN {col} = '{k}' THEN {v}"
                              for k, v in mapping.items()) + (f" ELSE '{default}' END" if isinstance(default, str)
                                                              else f" ELSE {default} END")


PACKETS_SQL = f"""
pk AS (SELECT lpad(CAST(event_id AS VARCHAR), greatest(8, length(CAST(event_id AS VARCHAR)))::INTEGER, '0') AS packet_id,
  CAST(CAST(172 AS BIGINT) * 16777216 + 16 * 65536 + ((user_id // 256) % 256) * 256 + user_id % 256 AS BIGINT) AS source_ip,
  CAST(167772210 AS BIGINT) AS dest_ip, CAST(1024 + event_id % 60000 AS INTEGER) AS source_port,
  CAST({_sql_case('event_type', PORTS, 0)} AS INTEGER) AS dest_port, {_sql_case('event_type', PROTO, 'TCP')} AS protocol,
  CAST(CASE WHEN event_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS INTEGER) AS flags,
  CAST(32 + event_id % 97 AS INTEGER) AS ttl, CAST(floor(value * 100) AS INTEGER) AS volume,
  CAST(event_id % 2 AS INTEGER) AS spoofed, {_sql_case('event_type', ATTACK, 'Unknown')} AS attack_type,
  date_trunc('minute', ts) + INTERVAL 123 MILLISECOND AS record_ts, ts
  FROM events)"""

PK_COLS = ["packet_id", "source_ip", "dest_ip", "source_port", "dest_port", "protocol", "flags", "ttl", "volume",
           "spoofed", "attack_type"]


@register("scan_text_regex", sql(PACKETS_SQL, body="SELECT " + ", ".join(PK_COLS) + " FROM pk"))
def q_scan_text_regex(spark, sf_dir):
    return PL.parse_packets(_lines(spark, sf_dir))


@register("cast_columns", sql(PACKETS_SQL, body="SELECT packet_id, source_port, dest_port, ttl, volume, spoofed FROM pk"))
def q_cast_columns(spark, sf_dir):
    return PL.parse_packets(_lines(spark, sf_dir)).select("packet_id", "source_port", "dest_port", "ttl",
                                                                "volume", "spoofed")


@register("flag_contains", sql(PACKETS_SQL, body="SELECT packet_id, flags FROM pk"))
def q_flag_contains(spark, sf_dir):
    return PL.parse_packets(_lines(spark, sf_dir)).select("packet_id", "flags")


@register("ffill_record_time", sql(PACKETS_SQL, body="SELECT packet_id, record_ts FROM pk"))
def q_ffill_record_time(spark, sf_dir):
    return _filled_packets(spark, sf_dir).select("packet_id", "record_ts")


@register("packets_per_second", sql(PACKETS_SQL, body="""
SELECT date_trunc('second', record_ts) AS window_start, CAST(count(*) AS BIGINT) AS packets FROM pk GROUP BY 1"""))
def q_packets_per_second(spark, sf_dir):
    """The stream over three deliveries of the log; equals the batch form."""
    out, ckpt = scratch_path(spark, "pps-out"), scratch_path(spark, "pps-ckpt")
    _packet_stream(spark, sf_dir)(lambda s: SP.packets_per_window_stream(s, out, ckpt))
    return SP.latest_windows(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("cumulative_counts", sql(PACKETS_SQL, body="""
SELECT window_start, packets, CAST(sum(packets) OVER (ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING
       AND CURRENT ROW) AS BIGINT) AS cumulative
FROM (SELECT date_trunc('hour', record_ts) AS window_start, CAST(count(*) AS BIGINT) AS packets FROM pk GROUP BY 1)"""))
def q_cumulative_counts(spark, sf_dir):
    """Hourly counts and running totals, kept by the stream itself over three deliveries of the log."""
    out, ckpt = scratch_path(spark, "hours-out"), scratch_path(spark, "hours-ckpt")
    _packet_stream(spark, sf_dir)(lambda s: SR.running_totals_stream(s, out, ckpt, "1 hour"))
    return SP.latest_windows(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("telemetry_join", sql(PACKETS_SQL, body="""
SELECT date_trunc('second', record_ts) AS second, CAST(count(*) AS BIGINT) AS pps, CAST(count(*) AS INTEGER) AS n,
       CAST((count(*) * 37) % 1000 AS DOUBLE) / 10 AS cpu, CAST(sum(ttl) % 1000 AS DOUBLE) / 10 AS ram
FROM pk GROUP BY date_trunc('second', record_ts)"""))
def q_telemetry_join(spark, sf_dir):
    """Stream-stream join over three deliveries of the log as text; a heartbeat record closes the last seconds."""
    src, out, ckpt = (scratch_path(spark, f"telemetry-{n}") for n in ("log", "out", "ckpt"))
    lines = packet_lines(spark, sf_dir)
    at = F.col("minute").cast("timestamp").cast("double")
    seconds = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").cast("double").alias("t"))
    found = seconds.agg(F.percentile_approx("t", [1 / 3, 2 / 3]).alias("cuts"), F.max("t").alias("last")).first()
    low, high = found.cuts or [0.0, 0.0]
    part = F.when(at < low, 0).when(at < high, 1).otherwise(2)
    beat = dt.datetime.fromtimestamp(found.last or 0.0, dt.timezone.utc) + dt.timedelta(days=1)
    beats = spark.createDataFrame([(f"{beat:%Y-%m-%d %H:%M:%S},{ms} - {text}",) for ms, text in (
        ("123", "Batch processed 0 packets. CPU: 0.0%, RAM: 0.0%"), ("130", "Packets received in last second: 0"))], "line string")
    for delivery in (lines.where(part == 0), lines.where(part == 1), lines.where(part == 2), beats):
        delivery.select("line").write.mode("append").text(src)
        # one micro-batch a delivery: its files are in no order of time
        log = [spark.readStream.schema("value string").text(src).withColumnRenamed("value", "line") for _ in range(2)]
        SR.telemetry_join_stream(PL.parse_pps(log[0]), PL.parse_headers(log[1]), out, ckpt)
    return spark.read.parquet(out).drop("batch").withColumn("second", F.col("second").cast("timestamp_ntz"))


@register("packets_by_attack_window", sql(PACKETS_SQL, body="""
SELECT date_trunc('hour', record_ts) AS window_start, attack_type, CAST(count(*) AS BIGINT) AS packets,
       CAST(sum(volume) AS BIGINT) AS volume FROM pk GROUP BY 1, 2"""))
def q_packets_by_attack_window(spark, sf_dir):
    return SP.packets_by_attack_window(_filled_packets(spark, sf_dir), "record_ts", "1 hour", key="attack_type", value="volume")


@register("packets_by_attack_stream", sql(PACKETS_SQL, body="""
SELECT date_trunc('hour', record_ts) AS window_start, attack_type, CAST(count(*) AS BIGINT) AS packets,
       CAST(sum(volume) AS BIGINT) AS volume FROM pk GROUP BY 1, 2"""))
def q_packets_by_attack_stream(spark, sf_dir):
    out, ckpt = scratch_path(spark, "attack-out"), scratch_path(spark, "attack-ckpt")
    _packet_stream(spark, sf_dir)(lambda s: SP.packets_by_attack_stream(s, out, ckpt))
    return SP.latest_windows(spark, out, ["attack_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("windowed_counts_stream", """
SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) + 0.0
       AS value_sum FROM events GROUP BY 1, 2""")
def q_windowed_counts_stream(spark, sf_dir):
    """Structured Streaming over events (watermark 10 min, hourly windows, update mode)."""
    out = SP.windowed_counts_stream(SP.event_stream(spark, sf_dir), scratch_path(spark, "win-out"),
                                    scratch_path(spark, "win-ckpt"))
    r = SP.latest_windows(spark, out, ["event_type"])
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n",
                    (F.round("value_sum", 6) + F.lit(0.0)).alias("value_sum"))


@register("score_stream", sql(*BASE_CTES, _nb_sql_ctes(), body="SELECT flow_id, y, p FROM nbpred"))
def q_score_stream(spark, sf_dir):
    """Fit NB in batch on the train split; score the test split as a stream of flow CSV files."""
    from flowsieve.plans.q_io import _flows_csv
    from flowsieve.streaming.flows import read_output, score_stream

    prep = prepared_flows(spark, sf_dir)
    train, _test = split_two(prep, "flow_id", 25)
    scaler, model = nb.fit_with_scaler(train, PREP_FEATURES, "y")
    out = score_stream(spark, _flows_csv(spark, sf_dir, complete=True), lambda s: split_two(prepare(s), "flow_id", 25)[1],
                       lambda d: model.transform(scaler.transform(d), out="p").select("flow_id", "y", "p"),
                       scratch_path(spark, "score-out"), scratch_path(spark, "score-ckpt"))
    return read_output(spark, out)
