"""Model-evaluation queries and the flagship naive-Bayes flow classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import metrics as M
from flowsieve.operators import naive_bayes as nb
from flowsieve.operators.sampling import split_two
from flowsieve.plans import sqlgen
from flowsieve.plans.adapters import sql
from flowsieve.plans.common import (BASE_CTES, PREP_FEATURES, RULE_PAIRS_SQL, RULE_SQL, prepared_flows,
                                    rule_pairs, rule_prediction)
from flowsieve.plans.registry import register
from flowsieve.session import scratch_path

# ----------------------------------------------------------------------------------------
# Flagship: clean -> encode -> label map -> 75/25 hash split -> scaler -> Gaussian NB.


def nb_predictions(spark, sf_dir, keep_scores: bool = False):
    # prepared once in the shared folder, read by the fit and by the scoring
    path = scratch_path(spark, "prepared")
    prepared_flows(spark, sf_dir).select("flow_id", "y", *PREP_FEATURES).write.parquet(path)
    train, test = split_two(spark.read.parquet(path), "flow_id", 25)
    scaler, model = nb.fit_with_scaler(train, PREP_FEATURES, "y")
    return model.transform(scaler.transform(test), out="p", keep_scores=keep_scores)


def _nb_sql_ctes() -> str:
    k = len(PREP_FEATURES)
    fsel = ", ".join(f"{sqlgen.q(c)} AS f{i}" for i, c in enumerate(PREP_FEATURES))
    sc = ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(k))
    z = ", ".join(f"(f{i} - m{i}) / (CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0 ELSE s{i} END) AS z{i}"
                  for i in range(k))
    st = ", ".join(f"avg(z{i}) AS mu{i}, var_pop(z{i}) AS v{i}" for i in range(k))
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop(z{i})" for i in range(k)) + ")"
    const = " + ".join(f"ln(2 * pi() * (v{i} + e.e))" for i in range(k))
    quad = " + ".join(f"(z{i} - mu{i}) * (z{i} - mu{i}) / (v{i} + e.e)" for i in range(k))
    return f"""
feat AS (SELECT flow_id, y, {sqlgen.bucket100('flow_id')} AS b, {fsel} FROM prepared),
sc AS (SELECT {sc} FROM feat WHERE b >= 25),
ztrain AS (SELECT y, {z} FROM feat, sc WHERE b >= 25),
ztest AS (SELECT flow_id, y, {z} FROM feat, sc WHERE b < 25),
nbs AS (SELECT y AS c, count(*) AS n, {st} FROM ztrain GROUP BY y),
eps AS (SELECT {eps} AS e, count(*) AS total FROM ztrain),
scored AS (SELECT t.flow_id, t.y, n.c,
                  ln(n.n / e.total) - 0.5 * ({const}) - 0.5 * ({quad}) AS s
           FROM ztest t, nbs n, eps e),
nbpred AS (SELECT flow_id, y, c AS p FROM (
             SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY s DESC, c) AS r FROM scored) WHERE r = 1)"""


def nb_report(spark, sf_dir):
    return M.classification_report(nb_predictions(spark, sf_dir), "y", "p")


_rep_ctes, _rep_body = sqlgen.report_sql("nbpred")
NB_REPORT_SQL = sql(*BASE_CTES, _nb_sql_ctes(), _rep_ctes, body=_rep_body)


@register("gaussian_nb", sql(*BASE_CTES, _nb_sql_ctes(),
                             body="SELECT y, p, CAST(count(*) AS BIGINT) AS n FROM nbpred GROUP BY y, p"))
def q_gaussian_nb(spark, sf_dir):
    return M.confusion_counts(nb_predictions(spark, sf_dir), "y", "p").select(
        "y", "p", F.col("n").cast("bigint").alias("n"))


# ----------------------------------------------------------------------------------------
# Metrics over a rule-based prediction (deterministic, cheap, exercises odd classes).

_rc, _rb = sqlgen.report_sql("pairs")


@register("classification_report", sql(*BASE_CTES, RULE_PAIRS_SQL, _rc, body=_rb))
def q_classification_report(spark, sf_dir):
    return M.classification_report(rule_pairs(spark, sf_dir), "y", "p")


@register("confusion_matrix", sql(*BASE_CTES, RULE_PAIRS_SQL, """
cc AS (SELECT y, p, count(*) AS n FROM pairs GROUP BY y, p),
lab AS (SELECT y AS c FROM cc UNION SELECT p FROM cc)""", body="""
SELECT a.c AS y, b.c AS p, CAST(coalesce(cc.n, 0) AS BIGINT) AS n
FROM lab a CROSS JOIN lab b LEFT JOIN cc ON cc.y = a.c AND cc.p = b.c"""))
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(rule_pairs(spark, sf_dir), "y", "p")


_WIDE = list(range(11))


@register("confusion_matrix_wide", sql(*BASE_CTES, RULE_PAIRS_SQL, body="SELECT y.y, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE p = {v}) AS BIGINT) AS p_{v}" for v in _WIDE)
    + f" FROM (SELECT CAST(unnest(range(0, {len(_WIDE)})) AS INTEGER) AS y) y LEFT JOIN pairs ON pairs.y = y.y GROUP BY y.y"))
def q_confusion_matrix_wide(spark, sf_dir):
    """Fixed labels, one column per predicted class; classes without rows are zero."""
    return M.confusion_matrix_wide(rule_pairs(spark, sf_dir), _WIDE)


@register("accuracy", sql(*BASE_CTES, RULE_PAIRS_SQL, body=f"""
SELECT {sqlgen.round6('avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pairs"""))
def q_accuracy(spark, sf_dir):
    return M.accuracy(rule_pairs(spark, sf_dir), "y", "p")


_sc, _sb = sqlgen.summary_metrics_sql("pairs", [])


@register("f1_weighted", sql(*BASE_CTES, RULE_PAIRS_SQL, _sc, body=_sb))
def q_f1_weighted(spark, sf_dir):
    return M.summary_metrics(rule_pairs(spark, sf_dir), "y", "p")


@register("mre", sql(*BASE_CTES, RULE_PAIRS_SQL, body=f"""
SELECT {sqlgen.round6('coalesce(avg(CASE WHEN y <> 0 THEN abs((CAST(y AS DOUBLE) - p) / y) END), 0.0)')} AS mre,
       {sqlgen.round6('1.0 - coalesce(avg(CASE WHEN y <> 0 THEN abs((CAST(y AS DOUBLE) - p) / y) END), 0.0)')} AS mra
FROM pairs"""))
def q_mre(spark, sf_dir):
    return M.mre_mra(rule_pairs(spark, sf_dir), "y", "p")


_cc, _cb = sqlgen.summary_metrics_sql("pairs", ["chunk_id"])


@register("metrics_by_chunk", sql(*BASE_CTES, RULE_PAIRS_SQL, _cc, body=_cb))
def q_metrics_by_chunk(spark, sf_dir):
    return M.summary_metrics(rule_pairs(spark, sf_dir), "y", "p", by=["chunk_id"])


@register("metrics_mean_of_chunks", sql(*BASE_CTES, RULE_PAIRS_SQL, _cc, "perchunk AS (" + _cb + ")", body=f"""
SELECT CAST(sum(samples) AS BIGINT) AS total_samples, CAST(count(*) AS BIGINT) AS num_chunks,
       {sqlgen.round6('avg(accuracy) * 100')} AS accuracy_percent, {sqlgen.round6('avg(f1_weighted)')} AS f1,
       {sqlgen.round6('avg(mre)')} AS mre, {sqlgen.round6('avg(mra)')} AS mra FROM perchunk"""))
def q_metrics_mean_of_chunks(spark, sf_dir):
    per_chunk = M.summary_metrics(rule_pairs(spark, sf_dir), "y", "p", by=["chunk_id"])
    return M.metrics_mean_of_chunks(per_chunk)


@register("class0_row_metrics", sql(*BASE_CTES, RULE_PAIRS_SQL, _rc, "rep AS (" + _rb + ")", body="""
SELECT * FROM rep WHERE regexp_full_match(label, '-?[0-9]+')
ORDER BY CAST(label AS INTEGER) LIMIT 1"""))
def q_class0_row_metrics(spark, sf_dir):
    return M.class0_row_metrics(M.classification_report(rule_pairs(spark, sf_dir), "y", "p"))


@register("misclassified", sql(*BASE_CTES, RULE_PAIRS_SQL, body="""
SELECT * FROM (SELECT 'count' AS kind, CAST(count(*) AS BIGINT) AS n, NULL AS flow_id, NULL::INTEGER AS y,
                      NULL::INTEGER AS p FROM pairs WHERE y <> p)
UNION ALL
SELECT * FROM (SELECT 'example', NULL, flow_id, y, p FROM pairs WHERE y <> p ORDER BY flow_id LIMIT 5)"""))
def q_misclassified(spark, sf_dir):
    cnt, first = M.misclassified(rule_pairs(spark, sf_dir), "y", "p", order_col="flow_id", n=5)
    a = cnt.select(F.lit("count").alias("kind"), F.col("n_errors").alias("n"), F.lit(None).cast("string").alias("flow_id"),
                   F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("p"))
    b = first.select(F.lit("example").alias("kind"), F.lit(None).cast("bigint").alias("n"), "flow_id", "y", "p")
    return a.unionByName(b)


# Two "models" scored in one scan: the rule above and a second rule on the tax column.
MODEL2_SQL = "CAST(CASE WHEN \"Tax\" < 0.04 THEN 0 ELSE 8 END AS INTEGER)"


@register("model_comparison", sql(*BASE_CTES, """
stacked AS (
  SELECT 'rule_packets' AS model, y, """ + RULE_SQL + """ AS p FROM prepared
  UNION ALL
  SELECT 'rule_tax' AS model, y, """ + MODEL2_SQL + """ AS p FROM prepared)""",
    *sqlgen.summary_metrics_sql("stacked", ["model"])[:1], body=sqlgen.summary_metrics_sql("stacked", ["model"])[1]))
def q_model_comparison(spark, sf_dir):
    prep = prepared_flows(spark, sf_dir)
    wide = prep.select("y", rule_prediction().alias("rule_packets"),
                       F.when(F.col("Tax") < 0.04, 0).otherwise(8).cast("int").alias("rule_tax"))
    long = wide.unpivot(["y"], ["rule_packets", "rule_tax"], "model", "p")
    return M.summary_metrics(long, "y", "p", by=["model"])
