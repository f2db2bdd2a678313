"""Array / vector queries: score arrays from ``embeddings`` slices.

Model A's logits are elements 1..6 of each embedding (x10), model B's elements 7..12.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import vectors as V
from flowsieve.plans.adapters import FLOWS_SQL, flows, sql, table
from flowsieve.plans.registry import register

C = 6


def scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    return e.select("vec_id", "label",
                    F.transform(F.slice(emb, 1, C), lambda x: x * 10.0).alias("a"),
                    F.transform(F.slice(emb, C + 1, C), lambda x: x * 10.0).alias("b"))


SCORES_SQL = f"""
sc AS (SELECT vec_id, label,
              list_transform(list_slice(CAST(embedding AS DOUBLE[]), 1, {C}), lambda x: x * 10.0) AS a,
              list_transform(list_slice(CAST(embedding AS DOUBLE[]), {C + 1}, {2 * C}), lambda x: x * 10.0) AS b
       FROM embeddings)"""


def r6list(expr: str) -> str:
    return f"list_transform({expr}, lambda x: round(x, 6) + 0.0)"


def r6arr(c):
    return F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))


SOFTMAX_SQL = "list_transform(list_transform({a}, lambda x: exp(x - list_max({a}))), lambda y: y / list_sum(list_transform({a}, lambda x: exp(x - list_max({a})))))"


@register("assemble_features", sql(FLOWS_SQL, body="""
SELECT "Flow ID", [CAST("Packets" AS DOUBLE), "Bytes", "Tax", "Size"] AS features FROM flows"""))
def q_assemble_features(spark, sf_dir):
    return flows(spark, sf_dir).select("Flow ID", V.assemble(["Packets", "Bytes", "Tax", "Size"]).alias("features"))


@register("pad_to_square", sql(FLOWS_SQL, body="""
SELECT "Flow ID", list_concat([CAST("Packets" AS DOUBLE), "Bytes", "Tax", "Size", "Discount"], [0.0, 0.0, 0.0, 0.0])
       AS grid FROM flows"""))
def q_pad_to_square(spark, sf_dir):
    cols = ["Packets", "Bytes", "Tax", "Size", "Discount"]
    return flows(spark, sf_dir).select("Flow ID", V.pad_to_square(V.assemble(cols), len(cols)).alias("grid"))


@register("softmax", sql(SCORES_SQL, body=f"""
SELECT vec_id, {r6list(SOFTMAX_SQL.format(a='a'))} AS prob,
       round(list_sum({SOFTMAX_SQL.format(a='a')}), 6) + 0.0 AS total FROM sc"""))
def q_softmax(spark, sf_dir):
    s = scores(spark, sf_dir).select("vec_id", V.softmax("a").alias("pa"))
    return s.select("vec_id", r6arr(F.col("pa")).alias("prob"),
                    (F.round(F.aggregate("pa", F.lit(0.0), lambda acc, x: acc + x), 6) + F.lit(0.0)).alias("total"))


@register("argmax", sql(SCORES_SQL, body="""
SELECT vec_id, CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS class_a,
       CAST(list_position(b, list_max(b)) - 1 AS INTEGER) AS class_b FROM sc"""))
def q_argmax(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.select("vec_id", V.argmax("a").alias("class_a"), V.argmax("b").alias("class_b"))


@register("topk_scores", sql(SCORES_SQL, body=f"""
SELECT vec_id, {r6list(f"list_slice(list_reverse_sort({SOFTMAX_SQL.format(a='a')}), 1, 3)")} AS top3 FROM sc"""))
def q_topk_scores(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.select("vec_id", r6arr(V.topk_scores(V.softmax("a"), 3)).alias("top3"))


@register("weighted_vote", sql(SCORES_SQL, body="""
SELECT vec_id, label, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS voted,
       list_transform(v, lambda x: round(x, 6) + 0.0) AS combined, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS voted_prob
FROM (SELECT vec_id, label, list_transform(range(1, len(a) + 1), lambda i: 0.6 * a[i] + 0.4 * b[i]) AS v,
             list_transform(range(1, len(a) + 1), lambda i: 0.6 * pa[i] + 0.4 * pb[i]) AS w
      FROM (SELECT *, """ + SOFTMAX_SQL.format(a="a") + " AS pa, " + SOFTMAX_SQL.format(a="b") + """ AS pb FROM sc))"""))
def q_weighted_vote(spark, sf_dir):
    s = scores(spark, sf_dir).select("vec_id", "label", V.weighted_vote("a", "b").alias("v"),
                                     V.weighted_vote_class("a", "b", on="probability").alias("voted_prob"))
    return s.select("vec_id", "label", V.argmax("v").alias("voted"), r6arr(F.col("v")).alias("combined"), "voted_prob")
