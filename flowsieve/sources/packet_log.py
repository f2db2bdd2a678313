"""Packet-log scans: regex-parsed packet lines, record headers (telemetry) and the
record time every packet line inherits from its header (forward fill).

Lines keep their file order through (file, split start, monotonically_increasing_id):
inside one input split rows arrive in file order, and a split never spans partitions.
The forward fill is exact and never windows over a whole file:

1. inside each split: ``last(header_ts, ignorenulls)`` over a window partitioned by
   (file, split) - a split is at most ``maxPartitionBytes``;
2. lines before the first header of a split take the last header time of the
   nearest earlier split of the same file, found on a tiny per-split table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions.ipv4 import ipv4_to_int
from flowsieve.functions.numbers import flag_contains

# ---------------------------------------------------------------------------
# Log line layouts that must equal the original tool's.
PACKET_PATTERN = (r"Received Packet (\d+) \| Source IP: ([\d.]+) \| Destination IP: ([\d.]+) \| "
                  r"Source Port: (\d+) \| Destination Port: (\d+) \| Protocol: (\w+) \| Flags: ([\w,]*) \| "
                  r"TTL: (\d+) \| Volume: (\d+) \| Spoofed: ([01]) \| Attack Type: (\w+)")
HEADER_PATTERN = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - Batch processed (\d+) packets\. "
                  r"CPU: ([\d.]+)%, RAM: ([\d.]+)%")
PPS_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - Packets received in last second: (\d+)"
# ---------------------------------------------------------------------------

SEP = "\u0001"
# ---------------------------------------------------------------------------
# The groups of PACKET_PATTERN in order.
PACKET_GROUPS = ["packet_id", "source_ip", "dest_ip", "source_port", "dest_port", "protocol", "flags", "ttl",
                 "volume", "spoofed", "attack_type"]


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split_start, pos, line) - pos orders lines within a split."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("split_start"),
                     F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def _ts(date_col, ms_col):
    return F.to_timestamp_ntz(F.concat(date_col, F.lit("."), ms_col), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def parse_packets(lines: DataFrame, line_col: str = "line", keep=()) -> DataFrame:
    """Packet lines -> typed columns; lines that do not match are dropped. One regex pass a line: the
    match is rewritten to its groups, which a plain split takes apart."""
    l = F.col(line_col)
    groups = F.regexp_replace(l, "^.*?" + PACKET_PATTERN + ".*$", SEP + SEP.join(f"${i + 1}" for i in range(len(PACKET_GROUPS))))
    cand = lines.where(l.contains("Received Packet") & l.contains("|")).select(*keep, groups.alias("_groups"))
    cand = cand.where(F.col("_groups").startswith(SEP)).select(*keep, F.split("_groups", SEP).alias("_g"))
    g = {name: F.get("_g", F.lit(i + 1)) for i, name in enumerate(PACKET_GROUPS)}
    return cand.select(
        *keep, g["packet_id"].alias("packet_id"),
        ipv4_to_int(g["source_ip"]).alias("source_ip"), ipv4_to_int(g["dest_ip"]).alias("dest_ip"),
        g["source_port"].try_cast("int").alias("source_port"), g["dest_port"].try_cast("int").alias("dest_port"),
        g["protocol"].alias("protocol"), flag_contains(g["flags"], "SYN").alias("flags"),
        g["ttl"].try_cast("int").alias("ttl"), g["volume"].try_cast("int").alias("volume"),
        g["spoofed"].try_cast("int").alias("spoofed"), g["attack_type"].alias("attack_type"))


def parse_headers(lines: DataFrame, line_col: str = "line", keep=()) -> DataFrame:
    """Batch header lines -> (ts, n, cpu, ram)."""
    l = F.col(line_col)
    h = lines.where(l.rlike(HEADER_PATTERN))
    e = lambda i: F.regexp_extract(l, HEADER_PATTERN, i)
    return h.select(*keep, _ts(e(1), e(2)).alias("ts"), e(3).try_cast("int").alias("n"),
                    e(4).try_cast("double").alias("cpu"), e(5).try_cast("double").alias("ram"))


def parse_pps(lines: DataFrame, line_col: str = "line") -> DataFrame:
    l = F.col(line_col)
    e = lambda i: F.regexp_extract(l, PPS_PATTERN, i)
    return lines.where(l.rlike(PPS_PATTERN)).select(_ts(e(1), e(2)).alias("ts"), e(3).try_cast("bigint").alias("pps"))


def ffill_record_time(lines: DataFrame) -> DataFrame:
    """Every line with the time of the latest batch header at or before it (same file)."""
    l = F.col("line")
    hts = F.when(l.rlike(HEADER_PATTERN), _ts(F.regexp_extract(l, HEADER_PATTERN, 1),
                                              F.regexp_extract(l, HEADER_PATTERN, 2)))
    d = lines.withColumn("_hts", hts)
    w = (Window.partitionBy("file", "split_start").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_local", F.last("_hts", ignorenulls=True).over(w))
    # carry-in per split: last header time of the closest earlier split that has one
    per_split = d.groupBy("file", "split_start").agg(F.max_by("_hts", F.when(F.col("_hts").isNotNull(),
                                                                            F.col("pos"))).alias("_last"))
    ws = (Window.partitionBy("file").orderBy("split_start")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_split.withColumn("_carry", F.last("_last", ignorenulls=True).over(ws)).select(
        "file", "split_start", "_carry")
    # one row per input split (data size / maxPartitionBytes rows): AQE broadcasts it when small
    d = d.join(carry, ["file", "split_start"], "left")
    return d.withColumn("record_ts", F.coalesce("_local", "_carry")).drop("_hts", "_local", "_carry")
