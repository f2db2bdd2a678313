"""Shared building blocks of the registered queries (Spark side + DuckDB CTE text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.ipv4 import ipv4_split, ipv4_to_int_null0
from flowsieve.functions.labels import map_label
from flowsieve.functions.numbers import inf_to_zero
from flowsieve.functions.util import qcol
from flowsieve.plans import sqlgen
from flowsieve.plans.adapters import FEATURES, FLOWS_SQL, IP_COLUMNS, flows

PREP_FEATURES = FEATURES + IP_COLUMNS


def prepare(f: DataFrame, keep=()) -> DataFrame:
    """flows -> IPs as integers (invalid/missing 0) -> inf/NaN/null features 0 -> label id
    (fixed 11-class mapping) -> rows with a known label.

    Two projections: the first splits each address once, the second derives everything
    from the parts (the split is too costly to repeat per octet check)."""
    y = map_label(qcol("Label"))
    staged = f.select(
        qcol("Flow ID").alias("flow_id"), y.alias("y"), *keep,
        *[inf_to_zero(qcol(c)).alias(c) for c in FEATURES],
        *[ipv4_split(qcol(c)).alias(f"_parts_{i}") for i, c in enumerate(IP_COLUMNS)],
    ).where(F.col("y").isNotNull())
    return staged.select(
        "flow_id", "y", *keep, *[qcol(c) for c in FEATURES],
        *[ipv4_to_int_null0(None, F.col(f"_parts_{i}")).cast("double").alias(c) for i, c in enumerate(IP_COLUMNS)])


def prepared_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(flows(spark, sf_dir), ["Protocol", "source_file", "chunk_id"])


PREPARED_SQL = sqlgen.prepared_cte()

# Rule-based "model" output used by the metric queries: class from the packet count.
# Class 9 never occurs in the truth (a class with predictions but no support).
RULE_CLASSES = [0, 1, 2, 3, 4, 8, 9]


def rule_prediction(packets_col="Packets"):
    k = F.col(packets_col).cast("bigint") % 7
    out = None
    for i, c in enumerate(RULE_CLASSES):
        out = F.when(k == i, F.lit(c)) if out is None else out.when(k == i, F.lit(c))
    return out.cast("int")


RULE_SQL = "CAST(CASE CAST(\"Packets\" AS BIGINT) % 7 " + " ".join(
    f"WHEN {i} THEN {c}" for i, c in enumerate(RULE_CLASSES)) + " END AS INTEGER)"


def rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flow_id, chunk_id, source_file, y, p) with the rule-based prediction."""
    return prepared_flows(spark, sf_dir).select("flow_id", "chunk_id", "source_file", "y",
                                                rule_prediction().alias("p"))


RULE_PAIRS_SQL = f"""
pairs AS (SELECT flow_id, chunk_id, source_file, y, {RULE_SQL} AS p FROM prepared)"""

BASE_CTES = (FLOWS_SQL, PREPARED_SQL)
