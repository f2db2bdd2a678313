"""Projection / filter / cleaning and scalar encoder (2.4) queries over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import ipv4, labels, numbers
from flowsieve.functions.util import qcol
from flowsieve.operators import clean, encode
from flowsieve.plans import sqlgen
from flowsieve.plans.adapters import FLOWS_SQL, flows, sql
from flowsieve.plans.common import BASE_CTES, RULE_PAIRS_SQL, rule_pairs
from flowsieve.plans.registry import register
from flowsieve.schema import ATTACK_MAPPING_V1, ATTACK_MAPPING_V4, NON_FEATURE_COLUMNS

q = sqlgen.q
FLOW_COLUMNS = ["Flow ID", "Source IP", "Destination IP", "Timestamp", "Protocol", "Packets", "Bytes",
                "Discount", "Tax", "Size", "Retail Price", "Flow Bytes/s", "SimillarHTTP", "Inbound",
                "Label", "source_file", "chunk_id"]
DOUBLE_COLUMNS = ["Packets", "Bytes", "Discount", "Tax", "Size", "Retail Price", "Flow Bytes/s"]


def fsql(body: str, *ctes: str) -> str:
    return sql(FLOWS_SQL, *ctes, body=body)


@register("drop_missing_rows", fsql(
    'SELECT "Flow ID", "Label", "Flow Bytes/s", "Source IP" FROM flows WHERE '
    + " AND ".join(f"{q(c)} IS NOT NULL" for c in FLOW_COLUMNS) + " AND "
    + " AND ".join(f"NOT isnan({q(c)})" for c in DOUBLE_COLUMNS)))
def q_drop_missing_rows(spark, sf_dir):
    return clean.drop_missing_rows(flows(spark, sf_dir)).select("Flow ID", "Label", "Flow Bytes/s", "Source IP")


@register("filter_known_labels", fsql(
    'SELECT "Flow ID", "Label" FROM flows WHERE "Label" IN ('
    + ", ".join(f"'{k}'" for k in ATTACK_MAPPING_V1) + ")"))
def q_filter_known_labels(spark, sf_dir):
    return clean.filter_known_labels(flows(spark, sf_dir)).select("Flow ID", "Label")


@register("filter_one_attack", fsql(
    "SELECT \"Flow ID\", \"Label\", \"Packets\" FROM flows WHERE \"Label\" = 'DrDoS_NTP'"))
def q_filter_one_attack(spark, sf_dir):
    return clean.filter_one_attack(flows(spark, sf_dir), "DrDoS_NTP").select("Flow ID", "Label", "Packets")


_KEPT_AFTER_DROP = [c for c in FLOW_COLUMNS if c not in NON_FEATURE_COLUMNS or c == "Flow ID"]


@register("drop_columns_if_exist", fsql(
    "SELECT " + ", ".join(q(c) for c in FLOW_COLUMNS if c not in NON_FEATURE_COLUMNS) + " FROM flows"))
def q_drop_columns_if_exist(spark, sf_dir):
    return clean.drop_columns_if_exist(flows(spark, sf_dir), NON_FEATURE_COLUMNS + ["Not A Column"])


@register("select_numeric", fsql(
    'SELECT "Flow ID", "Packets", "Bytes", "Discount", "Tax", "Size", "Retail Price", "Flow Bytes/s", '
    '"Inbound", chunk_id, CAST(coalesce("Protocol" = 6, FALSE) AS INTEGER) AS "Protocol_6", '
    'CAST(coalesce("Protocol" = 17, FALSE) AS INTEGER) AS "Protocol_17" FROM flows'))
def q_select_numeric(spark, sf_dir):
    f = encode.one_hot(flows(spark, sf_dir), "Protocol", categories=[1, 6, 17], drop_first=True)
    f = f.withColumn("Protocol_6", F.col("Protocol_6").cast("boolean")).withColumn(
        "Protocol_17", F.col("Protocol_17").cast("boolean"))  # booleans count as 0/1 features
    return clean.select_numeric(f, exclude=["Protocol"], keep=["Flow ID"])


_PARSE_COLS = ["Source IP", "Destination IP", "SimillarHTTP", "Protocol", "Label", "Packets"]


@register("drop_unparseable_columns", fsql(
    'SELECT "Flow ID", CAST("Protocol" AS DOUBLE) AS "Protocol", CAST("Packets" AS DOUBLE) AS "Packets" FROM flows'))
def q_drop_unparseable_columns(spark, sf_dir):
    return clean.drop_unparseable_columns(flows(spark, sf_dir).select("Flow ID", *_PARSE_COLS), _PARSE_COLS)


@register("inf_to_sentinel", fsql(
    f'SELECT "Flow ID", {sqlgen.inf_to_sentinel(q("Flow Bytes/s"))} AS "Flow Bytes/s" FROM flows'))
def q_inf_to_sentinel(spark, sf_dir):
    return clean.inf_to_sentinel_columns(flows(spark, sf_dir).select("Flow ID", "Flow Bytes/s"), ["Flow Bytes/s"])


@register("inf_to_null_zero", fsql(
    f'SELECT "Flow ID", {sqlgen.inf_to_zero(q("Flow Bytes/s"))} AS "Flow Bytes/s" FROM flows'))
def q_inf_to_null_zero(spark, sf_dir):
    return clean.inf_to_zero_columns(flows(spark, sf_dir).select("Flow ID", "Flow Bytes/s"), ["Flow Bytes/s"])


@register("inf_to_zero", fsql(
    'SELECT "Flow ID", ' + ", ".join(f"{sqlgen.inf_to_zero(q(c))} AS {q(c)}" for c in DOUBLE_COLUMNS) + " FROM flows"))
def q_inf_to_zero(spark, sf_dir):
    return clean.inf_to_zero_columns(flows(spark, sf_dir).select("Flow ID", *DOUBLE_COLUMNS), DOUBLE_COLUMNS)


@register("fill_label_missing", fsql(
    "SELECT \"Flow ID\", coalesce(\"Label\", 'missing_value') AS \"Label\" FROM flows"))
def q_fill_label_missing(spark, sf_dir):
    return clean.fill_label_missing(flows(spark, sf_dir).select("Flow ID", "Label"))


@register("drop_null_labels", fsql(
    f'SELECT "Flow ID", {sqlgen.map_label(q("Label"))} AS y FROM flows WHERE {sqlgen.map_label(q("Label"))} IS NOT NULL'))
def q_drop_null_labels(spark, sf_dir):
    f = flows(spark, sf_dir).select("Flow ID", labels.map_label(qcol("Label")).alias("y"))
    return clean.drop_null_labels(f, "y")


_ALIGN = ["Tax", "Packets", "Missing Feature", "Bytes"]


@register("align_features", fsql(
    'SELECT "Flow ID", CAST("Tax" AS DOUBLE) AS "Tax", CAST("Packets" AS DOUBLE) AS "Packets", '
    '0.0 AS "Missing Feature", CAST("Bytes" AS DOUBLE) AS "Bytes" FROM flows'))
def q_align_features(spark, sf_dir):
    return clean.align_features(flows(spark, sf_dir), _ALIGN, keep=["Flow ID"])


@register("union_files", fsql("""
SELECT "Flow ID", "Packets", "Tax", NULL::DOUBLE AS "Bytes", 'a' AS part FROM flows WHERE "Protocol" = 6
UNION ALL SELECT "Flow ID", "Packets", NULL::DOUBLE, "Bytes", 'b' FROM flows WHERE "Protocol" <> 6"""))
def q_union_files(spark, sf_dir):
    f = flows(spark, sf_dir)
    a = f.where("Protocol = 6").select("Flow ID", "Packets", "Tax", F.lit("a").alias("part"))
    b = f.where("Protocol <> 6").select("Flow ID", "Packets", "Bytes", F.lit("b").alias("part"))
    return clean.union_by_name([a, b])


@register("row_index", fsql(
    'SELECT CAST(row_number() OVER (ORDER BY "Flow ID") - 1 AS BIGINT) AS idx, "Flow ID", "Label", "Packets", "Bytes", '
    '"Destination IP", "Protocol" FROM flows WHERE "Label" IS NOT NULL'))
def q_row_index(spark, sf_dir):
    f = flows(spark, sf_dir).where(qcol("Label").isNotNull()).select(
        "Flow ID", "Label", "Packets", "Bytes", "Destination IP", "Protocol")
    return clean.row_index(f, ["Flow ID"], "idx")


@register("binary_threshold", fsql(
    'SELECT "Flow ID", CAST("Discount" * 10 > 0.5 AS INTEGER) AS is_attack FROM flows'))
def q_binary_threshold(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select("Flow ID", numbers.binary_threshold(F.col("Discount") * 10, 0.5).alias("is_attack"))


# ------------------------------------------------------------------ 2.4 scalar encoders


@register("ipv4_to_int", fsql(
    f'SELECT "Flow ID", "Source IP", {sqlgen.ipv4_strict(q("Source IP"))} AS src_int, '
    f'{sqlgen.ipv4_strict(q("Destination IP"))} AS dst_int FROM flows'))
def q_ipv4_to_int(spark, sf_dir):
    return flows(spark, sf_dir).select("Flow ID", "Source IP", ipv4.ipv4_to_int(qcol("Source IP")).alias("src_int"),
                                       ipv4.ipv4_to_int(qcol("Destination IP")).alias("dst_int"))


@register("ipv4_to_int_null0", fsql(
    f'SELECT "Flow ID", {sqlgen.ipv4_null0(q("Source IP"))} AS src_int FROM flows'))
def q_ipv4_to_int_null0(spark, sf_dir):
    return flows(spark, sf_dir).select("Flow ID", ipv4.ipv4_to_int_null0(qcol("Source IP")).alias("src_int"))


@register("ipv4_to_int_safe", fsql(
    f'SELECT "Flow ID", {sqlgen.ipv4_safe(q("Source IP"))} AS src_int, '
    f'{sqlgen.ipv4_safe("CAST(\"Flow Bytes/s\" AS VARCHAR)")} AS rate_int FROM flows'))
def q_ipv4_to_int_safe(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.select("Flow ID", ipv4.ipv4_to_int_safe(qcol("Source IP")).alias("src_int"),
                    ipv4.ipv4_to_int_safe(qcol("Flow Bytes/s").cast("string")).alias("rate_int"))


@register("map_label_fixed", fsql(
    f'SELECT "Flow ID", "Label", {sqlgen.map_label(q("Label"))} AS y FROM flows'))
def q_map_label_fixed(spark, sf_dir):
    return flows(spark, sf_dir).select("Flow ID", "Label", labels.map_label(qcol("Label")).alias("y"))


def _inverse_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {v} THEN '{k}'" for k, v in ATTACK_MAPPING_V1.items())
    return f"coalesce(CASE {expr} {whens} END, CAST({expr} AS VARCHAR))"


@register("map_label_inverse", sql(*BASE_CTES, RULE_PAIRS_SQL, body=f"""
SELECT flow_id, p * 2 AS code, {_inverse_sql('p * 2')} AS name FROM pairs"""))
def q_map_label_inverse(spark, sf_dir):
    r = rule_pairs(spark, sf_dir).select("flow_id", (F.col("p") * 2).alias("code"))
    return r.select("flow_id", "code", labels.map_label_inverse("code").alias("name"))


@register("label_encode", fsql(
    'SELECT "Flow ID", "Label", CAST(dense_rank() OVER (ORDER BY "Label") - 1 AS INTEGER) AS code, "Label" AS decoded '
    'FROM flows WHERE "Label" IS NOT NULL'))
def q_label_encode(spark, sf_dir):
    f = flows(spark, sf_dir).where(qcol("Label").isNotNull()).select("Flow ID", "Label")
    classes = encode.label_encoder_fit(f, "Label")
    return encode.label_decode(encode.label_encode(f, "Label", classes, "code"), "code", classes, "decoded")


def _raw_label_spark(f):
    ok = F.split(qcol("Flow ID"), "-").getItem(0).cast("bigint")
    m = ok % 13
    return (F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit("")).when(m == 2, F.lit(" benign "))
            .when(m == 3, F.lower(qcol("Label"))).when(m == 4, F.lit("UDP-lag"))
            .when(m == 5, (ok % 15).cast("string")).when(m == 6, F.lit("3.7")).when(m == 7, F.lit("nan"))
            .when(m == 8, F.lit("-1")).when(m == 9, F.concat(qcol("Label"), F.lit("_x")))
            .otherwise(qcol("Label")))


_RAW_LABEL_SQL = """CASE CAST(split_part("Flow ID", '-', 1) AS BIGINT) % 13
  WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' benign ' WHEN 3 THEN lower("Label") WHEN 4 THEN 'UDP-lag'
  WHEN 5 THEN CAST(CAST(split_part("Flow ID", '-', 1) AS BIGINT) % 15 AS VARCHAR) WHEN 6 THEN '3.7'
  WHEN 7 THEN 'nan' WHEN 8 THEN '-1' WHEN 9 THEN "Label" || '_x' ELSE "Label" END"""


def _infer_sql(raw: str, fl: str) -> str:
    s = f"trim({raw})"
    up = f"upper({s})"
    num = f"TRY_CAST({s} AS DOUBLE)"
    tr = f"(CASE WHEN {num} IS NOT NULL AND NOT isnan({num}) AND abs({num}) < 1e9 THEN CAST(trunc({num}) AS INTEGER) END)"
    parts = [f"WHEN {raw} IS NULL OR {s} = '' THEN {fl}", f"WHEN contains({up}, 'BENIGN') THEN 0"]
    parts += [f"WHEN contains({up}, '{k.upper()}') THEN {v}" for k, v in ATTACK_MAPPING_V4.items() if k != "BENIGN"]
    ids = ", ".join(str(v) for v in sorted(set(ATTACK_MAPPING_V4.values())))
    parts.append(f"WHEN {tr} IN ({ids}) THEN {tr}")
    return "CAST(CASE " + " ".join(parts) + f" ELSE {fl} END AS INTEGER)"


_FILE_LABEL_SQL = ("coalesce(" + sqlgen.map_label("regexp_extract(source_file, '^(.*)\\.csv$', 1)", ATTACK_MAPPING_V4)
                   + ", 0)")


@register("infer_label", fsql(
    f"SELECT \"Flow ID\", raw, {_infer_sql('raw', 'file_label')} AS label_id FROM ("
    f"SELECT \"Flow ID\", {_RAW_LABEL_SQL} AS raw, {_FILE_LABEL_SQL} AS file_label FROM flows)"))
def q_infer_label(spark, sf_dir):
    f = flows(spark, sf_dir)
    stem = F.regexp_extract("source_file", r"^(.*)\.csv$", 1)
    f = f.select("Flow ID", _raw_label_spark(f).alias("raw"),
                 F.coalesce(labels.map_label(stem, ATTACK_MAPPING_V4), F.lit(0)).alias("file_label"))
    return f.select("Flow ID", "raw", labels.infer_label("raw", F.col("file_label")).alias("label_id"))


@register("one_hot_protocol", fsql(
    'SELECT "Flow ID", CAST(coalesce("Protocol" = 6, FALSE) AS INTEGER) AS "Protocol_6", '
    'CAST(coalesce("Protocol" = 17, FALSE) AS INTEGER) AS "Protocol_17" FROM flows'))
def q_one_hot_protocol(spark, sf_dir):
    f = flows(spark, sf_dir).select("Flow ID", "Protocol")
    return encode.one_hot(f, "Protocol", drop_first=True)


@register("one_hot_all", fsql(
    'SELECT "Flow ID", ' + ", ".join(f'CAST(coalesce("Protocol" = {v}, FALSE) AS INTEGER) AS proto_{v}'
                                      for v in (1, 6, 17)) + " FROM flows"))
def q_one_hot_all(spark, sf_dir):
    f = flows(spark, sf_dir).select("Flow ID", "Protocol")
    return encode.one_hot(f, "Protocol", drop_first=False, prefix="proto")


@register("clean_number", fsql("""
SELECT "Flow ID", txt, TRY_CAST(trim(CASE WHEN regexp_full_match(s, '-?[0-9]+,[0-9]+') THEN replace(s, ',', '.')
                                  ELSE replace(s, ',', '') END) AS DOUBLE) AS value
FROM (SELECT "Flow ID", txt, replace(replace(trim(txt), '%', ''), '–', '-') AS s FROM (
  SELECT "Flow ID", CASE CAST(split_part("Flow ID", '-', 2) AS INTEGER)
    WHEN 1 THEN CAST("Packets" AS VARCHAR) || '%'
    WHEN 2 THEN format('{:,}', CAST(round("Bytes") AS BIGINT))
    WHEN 3 THEN CAST(CAST("Size" AS BIGINT) AS VARCHAR) || ',' || CAST(CAST("Tax" * 100 AS BIGINT) AS VARCHAR)
    WHEN 4 THEN '–' || CAST("Discount" AS VARCHAR)
    WHEN 5 THEN 'x' || "Label"
    WHEN 6 THEN NULL
    ELSE CAST("Retail Price" AS VARCHAR) END AS txt FROM flows))"""))
def q_clean_number(spark, sf_dir):
    f = flows(spark, sf_dir)
    ln = F.split(qcol("Flow ID"), "-").getItem(1).cast("int")
    txt = (F.when(ln == 1, F.concat(qcol("Packets").cast("string"), F.lit("%")))
           .when(ln == 2, F.format_number(F.round("Bytes").cast("bigint"), 0))
           .when(ln == 3, F.concat(qcol("Size").cast("bigint").cast("string"), F.lit(","),
                                   (qcol("Tax") * 100).cast("bigint").cast("string")))
           .when(ln == 4, F.concat(F.lit("–"), qcol("Discount").cast("string")))
           .when(ln == 5, F.concat(F.lit("x"), qcol("Label")))
           .when(ln == 6, F.lit(None).cast("string"))
           .otherwise(qcol("Retail Price").cast("string")))
    g = f.select("Flow ID", txt.alias("txt"))
    return g.select("Flow ID", "txt", numbers.clean_number("txt").alias("value"))


@register("error_range_adjust", sql(*BASE_CTES, RULE_PAIRS_SQL, body=f"""
SELECT chunk_id, {sqlgen.round6('avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) - 0.05')} AS adjusted_accuracy
FROM pairs GROUP BY chunk_id"""))
def q_error_range_adjust(spark, sf_dir):
    from flowsieve.functions.util import round6
    r = rule_pairs(spark, sf_dir)
    acc = r.groupBy("chunk_id").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("acc"))
    return acc.select("chunk_id", round6(numbers.error_range_adjust("acc", 0.05)).alias("adjusted_accuracy"))
