"""Sampling / splitting / balancing queries over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.util import U32, qcol, round6
from flowsieve.operators import sampling as S
from flowsieve.plans import sqlgen
from flowsieve.plans.adapters import FLOWS_SQL, flows, sql
from flowsieve.plans.common import BASE_CTES, prepared_flows
from flowsieve.plans.registry import register

FRACTION = 1 / 30
THRESH = int(FRACTION * U32)
H = sqlgen.md5_u32('"Flow ID"')


@register("hash_sample", sql(FLOWS_SQL, body=f'SELECT "Flow ID", "Label" FROM flows WHERE {H} < {THRESH}'))
def q_hash_sample(spark, sf_dir):
    return S.hash_sample(flows(spark, sf_dir), qcol("Flow ID"), FRACTION).select("Flow ID", "Label")


@register("sample_per_chunk", sql(FLOWS_SQL, body=f"""
SELECT chunk_id, "Flow ID", "Label" FROM (
  SELECT chunk_id, "Flow ID", "Label", count(*) OVER (PARTITION BY chunk_id) AS cnt,
         row_number() OVER (PARTITION BY chunk_id ORDER BY {H}, "Flow ID") AS r FROM flows)
WHERE r <= greatest(1, floor(cnt / 30))"""))
def q_sample_per_chunk(spark, sf_dir):
    """The exact share of every chunk, rows returned."""
    f = flows(spark, sf_dir).select("chunk_id", "Flow ID", "Label")
    return S.sample_exact_per_group(f, "chunk_id", "Flow ID", FRACTION, minimum=1)


@register("sample_exact_per_file", sql(FLOWS_SQL, body=f"""
SELECT source_file, "Flow ID" FROM (
  SELECT source_file, "Flow ID", count(*) OVER (PARTITION BY source_file) AS cnt,
         row_number() OVER (PARTITION BY source_file ORDER BY {H}, "Flow ID") AS r FROM flows)
WHERE r <= greatest(1, floor(cnt / 30))"""))
def q_sample_exact_per_file(spark, sf_dir):
    f = flows(spark, sf_dir).select("source_file", "Flow ID")
    return S.sample_exact_per_group(f, "source_file", "Flow ID", 1 / 30, minimum=1)


@register("sample_bernoulli")
def q_sample_bernoulli(spark, sf_dir):
    """Rows-only: Spark's own Bernoulli sampler is not reproducible by another engine."""
    return S.sample_bernoulli(flows(spark, sf_dir).select("Flow ID"), 0.01, seed=42)


@register("shuffle_rows", sql(FLOWS_SQL, body='SELECT "Flow ID", "Label" FROM flows'))
def q_shuffle_rows(spark, sf_dir):
    return S.shuffle_rows(flows(spark, sf_dir).select("Flow ID", "Label"), qcol("Flow ID"))


@register("split_two", sql(FLOWS_SQL, body=f"""
SELECT "Flow ID", CASE WHEN {sqlgen.bucket100('"Flow ID"')} < 25 THEN 'test' ELSE 'train' END AS split FROM flows"""))
def q_split_two(spark, sf_dir):
    return flows(spark, sf_dir).select("Flow ID", S.split_two_label(qcol("Flow ID"), 25).alias("split"))


@register("split_three", sql(FLOWS_SQL, body=f"""
SELECT "Flow ID", CASE WHEN {sqlgen.bucket100('"Flow ID"')} < 25 THEN 'test'
                       WHEN {sqlgen.bucket100('"Flow ID"')} < 40 THEN 'val' ELSE 'train' END AS split FROM flows"""))
def q_split_three(spark, sf_dir):
    f = flows(spark, sf_dir).select("Flow ID")
    return f.withColumn("split", S.split_label(qcol("Flow ID"), 25, 20))


CLASSES = list(range(11))


@register("class_weights", sql(*BASE_CTES, f"""
cls AS (SELECT unnest(range(0, {len(CLASSES)})) AS c),
cnt AS (SELECT y AS c, count(*) AS cnt FROM prepared GROUP BY y),
tot AS (SELECT sum(cnt) AS total FROM cnt)""", body=f"""
SELECT CAST(cls.c AS INTEGER) AS c, CAST(coalesce(cnt.cnt, 0) AS BIGINT) AS count,
       {sqlgen.round6(f'CASE WHEN cnt.cnt > 0 THEN tot.total / ({len(CLASSES)} * cnt.cnt) ELSE 0.0 END')} AS weight
FROM cls LEFT JOIN cnt ON cls.c = cnt.c CROSS JOIN tot"""))
def q_class_weights(spark, sf_dir):
    w = S.class_weights(prepared_flows(spark, sf_dir), "y", CLASSES)
    return w.select("c", "count", round6("weight").alias("weight"))


@register("weighted_resample", sql(*BASE_CTES, f"""
cnt AS (SELECT y AS c, count(*) AS cnt FROM prepared GROUP BY y),
tot AS (SELECT sum(cnt) AS total FROM cnt),
w AS (SELECT p.flow_id, tot.total / ({len(CLASSES)} * cnt.cnt) AS weight FROM prepared p JOIN cnt ON p.y = cnt.c CROSS JOIN tot),
agg AS (SELECT count(*) AS n, sum(weight) AS tw FROM w),
reps AS (SELECT flow_id, weight * (agg.n / agg.tw) AS e FROM w CROSS JOIN agg),
r AS (SELECT flow_id, CAST(floor(e) + CASE WHEN e - floor(e) > {sqlgen.md5_u32("flow_id || '#r'")} / {float(U32)} THEN 1 ELSE 0 END AS INTEGER) AS k
      FROM reps)""", body="""
SELECT flow_id, CAST(unnest(generate_series(1, k)) AS INTEGER) AS replica FROM r WHERE k > 0"""))
def q_weighted_resample(spark, sf_dir):
    prep = prepared_flows(spark, sf_dir)
    weights = S.class_weights(prep, "y", CLASSES)
    pw = S.with_class_weight(prep.select("flow_id", "y"), "y", weights).select("flow_id", "weight")
    agg = pw.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("tw")).first()
    out = S.weighted_resample(pw, F.col("flow_id"), "weight", int(agg["n"]), float(agg["tw"]))
    return out.select("flow_id", F.col("replica").cast("int").alias("replica"))


@register("label_counts", sql(FLOWS_SQL, body='SELECT "Label" AS label, CAST(count(*) AS BIGINT) AS n FROM flows GROUP BY "Label"'))
def q_label_counts(spark, sf_dir):
    from flowsieve.operators.stats import label_counts
    return label_counts(flows(spark, sf_dir), "Label")


@register("distinct_labels", sql(FLOWS_SQL, body='SELECT DISTINCT "Label" AS label FROM flows'))
def q_distinct_labels(spark, sf_dir):
    from flowsieve.operators.stats import distinct_labels
    return distinct_labels(flows(spark, sf_dir), "Label")
