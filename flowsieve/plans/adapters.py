"""Adapters from the driver tables to flow-, packet- and report-shaped inputs.

Each adapter exists twice: as Spark DataFrame code (what the registered queries run)
and as a DuckDB SQL CTE (what the oracle runs). Both derive every row from the
parquet tables, so the work grows with the scale factor.

Flow rows come from ``lineitem JOIN part``: ids and addresses from the keys, features
from the numeric columns, a class label from (returnflag, linestatus), and a
deterministic sprinkle of dirty values (bad IPs, +/-inf, NaN, nulls, BENIGN) keyed
on the order key so cleaning operators have something to clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its scan has fewer tasks than there are cores (a table of one
    small file); larger inputs, which have tasks enough, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Class label of a flow, from returnflag || linestatus (fixed demo assignment).
FLAG_LABELS = [("AF", "DrDoS_DNS"), ("AO", "DrDoS_LDAP"), ("NF", "DrDoS_MSSQL"),
               ("NO", "DrDoS_NetBIOS"), ("RF", "DrDoS_NTP"), ("RO", "Syn")]

FEATURES = ["Packets", "Bytes", "Discount", "Tax", "Size", "Retail Price", "Flow Bytes/s"]
IP_COLUMNS = ["Source IP", "Destination IP"]


def _flag_label(code):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FLAG_LABELS for x in kv]), code)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    j = l.join(p, l.l_partkey == p.p_partkey, "inner")
    ok, ln, pk, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    quad = F.concat_ws(".", F.lit("10"), F.expr("(l_suppkey div 65536) % 256"),
                       F.expr("(l_suppkey div 256) % 256"), sk % 256)
    m50 = ok % 50
    src = (F.when(m50 == 7, F.lit("256.1.1.1")).when(m50 == 13, F.lit(None).cast("string"))
           .when(m50 == 21, F.lit("")).otherwise(quad))
    dst = F.concat_ws(".", F.lit("192"), F.lit("168"), F.expr("(l_partkey div 256) % 256"), pk % 256)
    m40 = ok % 40
    rate = (F.when(m40 == 1, F.lit(float("inf"))).when(m40 == 2, F.lit(float("-inf")))
            .when(m40 == 3, F.lit(float("nan"))).when(m40 == 4, F.lit(None).cast("double"))
            .otherwise(F.col("l_extendedprice") / F.col("l_quantity")))
    base_label = _flag_label(F.concat(F.col("l_returnflag"), F.col("l_linestatus")))
    label = (F.when(ok % 97 == 0, F.lit("BENIGN")).when(ok % 89 == 0, F.lit(None).cast("string"))
             .otherwise(base_label))
    return j.select(
        F.concat_ws("-", ok, ln, pk, sk, cents).alias("Flow ID"),
        src.alias("Source IP"),
        dst.alias("Destination IP"),
        F.col("l_shipdate").alias("Timestamp"),
        F.when(ln % 3 == 0, 1).when(ln % 3 == 1, 6).otherwise(17).cast("int").alias("Protocol"),
        F.col("l_quantity").alias("Packets"),
        F.col("l_extendedprice").alias("Bytes"),
        F.col("l_discount").alias("Discount"),
        F.col("l_tax").alias("Tax"),
        F.col("p_size").cast("double").alias("Size"),
        F.col("p_retailprice").alias("Retail Price"),
        rate.alias("Flow Bytes/s"),
        F.when(ln == 1, F.col("p_brand")).otherwise(F.lit("0")).alias("SimillarHTTP"),
        (ln % 2).cast("int").alias("Inbound"),
        label.alias("Label"),
        # a stem that no mapping knows, for the rows of one class
        F.concat(F.when(ok % 97 == 0, F.lit("WebDDoS")).otherwise(F.coalesce(base_label, F.lit("unlabeled"))), F.lit(".csv"))
        .alias("source_file"),
        F.expr("l_orderkey div 1000").cast("int").alias("chunk_id"),
    )


FLOWS_SQL = """
flows AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
      || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS "Flow ID",
    CASE WHEN l_orderkey % 50 = 7 THEN '256.1.1.1' WHEN l_orderkey % 50 = 13 THEN NULL
         WHEN l_orderkey % 50 = 21 THEN ''
         ELSE '10.' || CAST((l_suppkey // 65536) % 256 AS VARCHAR) || '.' || CAST((l_suppkey // 256) % 256 AS VARCHAR)
              || '.' || CAST(l_suppkey % 256 AS VARCHAR) END AS "Source IP",
    '192.168.' || CAST((l_partkey // 256) % 256 AS VARCHAR) || '.' || CAST(l_partkey % 256 AS VARCHAR) AS "Destination IP",
    l_shipdate AS "Timestamp",
    CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN l_linenumber % 3 = 1 THEN 6 ELSE 17 END AS INTEGER) AS "Protocol",
    l_quantity AS "Packets", l_extendedprice AS "Bytes", l_discount AS "Discount", l_tax AS "Tax",
    CAST(p_size AS DOUBLE) AS "Size", p_retailprice AS "Retail Price",
    CASE WHEN l_orderkey % 40 = 1 THEN 'inf'::DOUBLE WHEN l_orderkey % 40 = 2 THEN '-inf'::DOUBLE
         WHEN l_orderkey % 40 = 3 THEN 'nan'::DOUBLE WHEN l_orderkey % 40 = 4 THEN NULL::DOUBLE
         ELSE l_extendedprice / l_quantity END AS "Flow Bytes/s",
    CASE WHEN l_linenumber = 1 THEN p_brand ELSE '0' END AS "SimillarHTTP",
    CAST(l_linenumber % 2 AS INTEGER) AS "Inbound",
    CASE WHEN l_orderkey % 97 = 0 THEN 'BENIGN' WHEN l_orderkey % 89 = 0 THEN NULL
         ELSE {flag_case} END AS "Label",
    CASE WHEN l_orderkey % 97 = 0 THEN 'WebDDoS' ELSE coalesce({flag_case}, 'unlabeled') END || '.csv' AS source_file,
    CAST(l_orderkey // 1000 AS INTEGER) AS chunk_id
  FROM lineitem JOIN part ON l_partkey = p_partkey
)""".format(flag_case="CASE l_returnflag || l_linestatus " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in FLAG_LABELS) + " END")


def sql(*ctes: str, body: str) -> str:
    """WITH <ctes> <body>."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
