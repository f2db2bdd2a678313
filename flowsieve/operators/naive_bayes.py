"""Gaussian naive Bayes as DataFrame code.

Fit = one ``groupBy(label)`` with count / avg / var_pop per feature (partial aggregation,
C x F numbers come back), plus one global var_pop for the smoothing term
(1e-9 x largest feature variance). Predict = a projection: per-class joint
log-likelihood built from literals, then argmax (ties -> smallest class).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.util import qcol
from flowsieve.functions.vectors import argmax

VAR_SMOOTHING = 1e-9


@dataclass
class GaussianNBModel:
    features: list[str]
    classes: list[int]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    def score_array(self):
        """array<double> of joint log-likelihoods, one per class (class order = ``classes``)."""
        per_class = []
        for k in range(len(self.classes)):
            const = math.log(self.priors[k]) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in self.variances[k])
            quad = None
            for i, f in enumerate(self.features):
                d = qcol(f) - F.lit(self.means[k][i])
                t = d * d / F.lit(self.variances[k][i])
                quad = t if quad is None else quad + t
            per_class.append(F.lit(const) - F.lit(0.5) * quad)
        return F.array(*per_class)

    def transform(self, df: DataFrame, out: str = "prediction", keep_scores: bool = False) -> DataFrame:
        cls = F.array(*[F.lit(c) for c in self.classes])
        scored = df.withColumn("_nb_scores", self.score_array())
        res = scored.withColumn(out, F.element_at(cls, argmax("_nb_scores") + 1).cast("int"))
        return res if keep_scores else res.drop("_nb_scores")


def fit_with_scaler(df: DataFrame, features: list[str], label: str):
    """Standardiser + Gaussian NB on the standardised features from ONE grouped aggregate.

    Per-class count/mean/var_pop of the raw features are enough: the global mean and
    population variance follow from the law of total variance (within + between class,
    numerically stable form), and standardising is affine, so class means/variances of
    the scaled features are (m - M) / S and v / S**2. Every scaled feature has variance 1
    (or 0 when constant), hence the smoothing term is 1e-9 * max(var).
    """
    from flowsieve.operators.stats import ScalerModel

    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(features):
        aggs += [F.avg(qcol(f)).alias(f"m{i}"), F.var_pop(qcol(f)).alias(f"v{i}")]
    rows = sorted(df.groupBy(qcol(label).alias("_c")).agg(*aggs).collect(), key=lambda r: r["_c"])
    total = sum(r["_n"] for r in rows)
    k = len(features)
    gm, gs = [], []
    for i in range(k):
        m = sum(r["_n"] * r[f"m{i}"] for r in rows) / total
        v = sum(r["_n"] * (r[f"v{i}"] + (r[f"m{i}"] - m) ** 2) for r in rows) / total
        gm.append(m)
        gs.append(math.sqrt(max(v, 0.0)))
    div = [s if s > 0 else 1.0 for s in gs]
    zvar = [(gs[i] / div[i]) ** 2 for i in range(k)]
    eps = VAR_SMOOTHING * max(zvar) if zvar else 0.0
    scaler = ScalerModel(list(features), gm, gs)
    model = GaussianNBModel(
        features=list(features),
        classes=[int(r["_c"]) for r in rows],
        priors=[r["_n"] / total for r in rows],
        means=[[(r[f"m{i}"] - gm[i]) / div[i] for i in range(k)] for r in rows],
        variances=[[r[f"v{i}"] / div[i] ** 2 + eps for i in range(k)] for r in rows],
    )
    return scaler, model
