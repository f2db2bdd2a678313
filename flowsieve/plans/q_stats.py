"""Statistics and join / set / limit (2.9) queries over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.util import qcol, round6
from flowsieve.operators import moments as MO
from flowsieve.operators import stats as ST
from flowsieve.plans import sqlgen
from flowsieve.plans.adapters import FLOWS_SQL, flows, sql
from flowsieve.plans.common import BASE_CTES, RULE_SQL, prepared_flows, rule_prediction
from flowsieve.plans.registry import register
from flowsieve.schema import ATTACK_MAPPING_V1, mapping_df
from flowsieve.session import scratch_path
from flowsieve.sources.flows import write_flow_csv

q = sqlgen.q
SCALE_FEATURES = ["Packets", "Bytes", "Discount", "Tax", "Size", "Retail Price"]
VAR_FEATURES = SCALE_FEATURES + ["Flow Bytes/s", "Constant"]


@register("scaler_fit", sql(*BASE_CTES, body=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sqlgen.round6(f'avg({q(c)})')} AS mean, {sqlgen.round6(f'stddev_pop({q(c)})')} AS std "
    f"FROM prepared" for c in SCALE_FEATURES)))
def q_scaler_fit(spark, sf_dir):
    s = ST.scaler_stats(prepared_flows(spark, sf_dir), SCALE_FEATURES)
    return s.select("feature", round6("mean").alias("mean"), round6("std").alias("std"))


@register("scaler_fit_incremental", sql(FLOWS_SQL, body=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count({q(c)}) AS BIGINT) AS n, {sqlgen.round6(f'avg({q(c)})')} AS mean, "
    f"{sqlgen.round6(f'stddev_pop({q(c)})')} AS std FROM flows" for c in SCALE_FEATURES)))
def q_scaler_fit_incremental(spark, sf_dir):
    """Moments of the flow files, added in two deliveries; the second reads the new files only."""
    src, store = scratch_path(spark, "moment-files"), scratch_path(spark, "moments")
    f = flows(spark, sf_dir)
    for part, where in (("early", "Protocol = 6"), ("late", "Protocol <> 6")):
        write_flow_csv(f.where(where).select("Flow ID", *SCALE_FEATURES, "source_file"), f"{src}/{part}", partition_by="source_file")
        MO.add_files(spark, src, store, SCALE_FEATURES)
    m = MO.merged(MO.read_store(spark, store))
    return m.select("feature", "n", round6("mean").alias("mean"), round6("std").alias("std"))


@register("scaler_transform", sql(*BASE_CTES, "st AS (SELECT " + ", ".join(
    f"avg({q(c)}) AS m{i}, stddev_pop({q(c)}) AS s{i}" for i, c in enumerate(SCALE_FEATURES[:3])) + " FROM prepared)",
    body="SELECT flow_id, " + ", ".join(
        f"{sqlgen.round6(f'({q(c)} - m{i}) / CASE WHEN s{i} = 0 THEN 1.0 ELSE s{i} END')} AS {q(c)}"
        for i, c in enumerate(SCALE_FEATURES[:3])) + " FROM prepared CROSS JOIN st"))
def q_scaler_transform(spark, sf_dir):
    prep = prepared_flows(spark, sf_dir).select("flow_id", *SCALE_FEATURES[:3])
    model = ST.scaler_fit(prep, SCALE_FEATURES[:3])
    out = model.transform(prep)
    return out.select("flow_id", *[round6(qcol(c)).alias(c) for c in SCALE_FEATURES[:3]])


@register("zero_variance_filter", sql(*BASE_CTES, body="SELECT flow_id, " + ", ".join(
    q(c) for c in VAR_FEATURES if c != "Constant") + " FROM prepared"))
def q_zero_variance_filter(spark, sf_dir):
    prep = prepared_flows(spark, sf_dir).withColumn("Constant", F.lit(1.0)).select("flow_id", *VAR_FEATURES)
    return ST.zero_variance_filter(prep, VAR_FEATURES)


_DISC = ["Packets", "Bytes", "Discount", "Tax", "Size", "Retail Price", "Flow Bytes/s", "Protocol", "Inbound"]


def _disc_sql() -> str:
    # a column "exists" in a file when the file has any non-null value for it
    per = " UNION ALL ".join(
        f"SELECT source_file, '{c}' AS feature, count({q(c)}) AS nn FROM flows "
        f"WHERE NOT (\"Label\" = 'DrDoS_DNS' AND '{c}' = 'Tax') GROUP BY source_file" for c in _DISC)
    return f"SELECT DISTINCT feature FROM ({per}) WHERE nn > 0"


@register("discover_features", sql(FLOWS_SQL, body=_disc_sql()))
def q_discover_features(spark, sf_dir):
    f = flows(spark, sf_dir)
    # one file lacks a column: the union of per-file schemas must still include it
    f = f.withColumn("Tax", F.when(qcol("Label") == "DrDoS_DNS", F.lit(None)).otherwise(qcol("Tax")))
    return ST.discover_features(f, "source_file", exclude=["chunk_id"])


_COLUMNS = ["Flow ID", "Source IP", "Destination IP", "Timestamp", "Protocol", "Packets", "Bytes", "Discount", "Tax", "Size",
            "Retail Price", "Flow Bytes/s", "SimillarHTTP", "Inbound", "Label", "source_file", "chunk_id"]


@register("column_list", sql(FLOWS_SQL, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, CAST(count({q(c)}) AS BIGINT) AS non_null FROM flows" for i, c in enumerate(_COLUMNS))))
def q_column_list(spark, sf_dir):
    return ST.column_profile(flows(spark, sf_dir))


# ------------------------------------------------------------------ 2.9 joins / sets / limits

_MAP_VALUES = ", ".join(f"('{k}', {v})" for k, v in ATTACK_MAPPING_V1.items())


@register("lookup_join", sql(FLOWS_SQL, f"m(name, id) AS (VALUES {_MAP_VALUES})", body="""
SELECT "Flow ID", "Label", CAST(m.id AS INTEGER) AS id FROM flows LEFT JOIN m ON flows."Label" = m.name"""))
def q_lookup_join(spark, sf_dir):
    f = flows(spark, sf_dir).select("Flow ID", "Label")
    m = mapping_df(spark, 1)  # 11 rows: a fixed size, safe to broadcast
    return f.join(F.broadcast(m), f["Label"] == m["name"], "left").select("Flow ID", "Label", "id")


@register("join_predictions", sql(*BASE_CTES, f"""
pa AS (SELECT flow_id, y, {RULE_SQL} AS p_packets FROM prepared),
pb AS (SELECT flow_id, CAST(CASE WHEN "Tax" < 0.04 THEN 0 ELSE 8 END AS INTEGER) AS p_tax FROM prepared)""", body="""
SELECT pa.flow_id, y, p_packets, p_tax FROM pa JOIN pb ON pa.flow_id = pb.flow_id"""))
def q_join_predictions(spark, sf_dir):
    # both models score the same rows, so their columns are selected side by side; outputs stored
    # apart are joined on flow_id
    return prepared_flows(spark, sf_dir).select("flow_id", "y", rule_prediction().alias("p_packets"),
                                                F.when(F.col("Tax") < 0.04, 0).otherwise(8).cast("int").alias("p_tax"))


@register("distinct_union", sql(FLOWS_SQL, f"m(name, id) AS (VALUES {_MAP_VALUES})", body="""
SELECT "Label" AS label FROM flows WHERE "Label" IS NOT NULL UNION SELECT name FROM m"""))
def q_distinct_union(spark, sf_dir):
    f = flows(spark, sf_dir).where(qcol("Label").isNotNull()).select(qcol("Label").alias("label"))
    m = mapping_df(spark, 1).select(F.col("name").alias("label"))
    return f.union(m).distinct()


@register("limit_n", sql(FLOWS_SQL, body="""
SELECT "Flow ID", "Bytes" FROM flows ORDER BY "Bytes" DESC, "Flow ID" LIMIT 5"""))
def q_limit_n(spark, sf_dir):
    # top-k: each partition keeps its own 5 (TakeOrderedAndProject), the driver merges k x partitions rows
    return flows(spark, sf_dir).select("Flow ID", "Bytes").orderBy(F.col("Bytes").desc(), F.col("Flow ID")).limit(5)
