"""Feature statistics: scaler, variance filter, label histograms, feature discovery, summaries.

Fitting collects only one aggregate row (a few numbers per feature) to the driver;
applying a fitted model is a pure projection with literal constants (codegen, no join).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.util import qcol, round6
from flowsieve.operators.medians import exact_medians


@dataclass
class ScalerModel:
    """Mean / population-std standardiser; std 0 (or undefined) divides by 1."""
    columns: list[str]
    means: list[float]
    stds: list[float]

    def expr(self, c: str):
        i = self.columns.index(c)
        sd = self.stds[i]
        sd = 1.0 if (sd is None or sd == 0.0 or sd != sd) else sd
        mu = self.means[i] if self.means[i] is not None else 0.0
        return (qcol(c) - F.lit(mu)) / F.lit(sd)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Replace (or add, with ``suffix``) each column by its standardised value, in one select."""
        cols = []
        for name in df.columns:
            if name in self.columns and not suffix:
                cols.append(self.expr(name).alias(name))
            else:
                cols.append(qcol(name))
        if suffix:
            cols += [self.expr(c).alias(c + suffix) for c in self.columns]
        return df.select(*cols)


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-pass mean and population std of each column, as a (feature, mean, std) table.

    The aggregate is a single global partial/final aggregation; the result is unpivoted
    with ``stack`` so it stays a DataFrame (no collect)."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(qcol(c)).alias(f"m{i}"), F.stddev_pop(qcol(c)).alias(f"s{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', m{i}, s{i}" for i, c in enumerate(columns))
    return wide.selectExpr(f"stack({len(columns)}, {stack}) as (feature, mean, std)")


def scaler_fit(df: DataFrame, columns: list[str]) -> ScalerModel:
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(qcol(c)).alias(f"m{i}"), F.stddev_pop(qcol(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return ScalerModel(list(columns), [row[f"m{i}"] for i in range(len(columns))],
                       [row[f"s{i}"] for i in range(len(columns))])


def zero_variance_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance, keep) for each column; keep = sample variance > 0.

    One global aggregate for all columns. A NaN poisons the variance, so clean first."""
    wide = df.agg(*[F.var_samp(qcol(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    stack = ", ".join(f"'{c}', v{i}" for i, c in enumerate(columns))
    long = wide.selectExpr(f"stack({len(columns)}, {stack}) as (feature, variance)")
    return long.select("feature", round6("variance").alias("variance"),
                       (F.coalesce(F.col("variance"), F.lit(0.0)) != 0).alias("keep"))


def zero_variance_filter(df: DataFrame, columns: list[str], keep_also: list[str] | None = None) -> DataFrame:
    """Drop numeric columns whose sample variance is 0 (a tiny one-row aggregate drives the select)."""
    v = zero_variance_columns(df, columns).where("keep").select("feature").collect()
    keep = {r[0] for r in v}
    out = [c for c in df.columns if c not in columns or c in keep]
    return df.select(*[qcol(c) for c in out])


def label_counts(df: DataFrame, label: str = "Label", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), qcol(label).alias("label")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def distinct_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.select(qcol(label).alias("label")).distinct()


def summary_by_group(df: DataFrame, keys: list[str], metrics: dict[str, str]) -> DataFrame:
    """count, mean and exact median per metric per group; null keys form their own group. Medians are found by
    refining histograms, so that no group has to fit one aggregation buffer."""
    means = [round6(F.avg(c)).alias(f"mean_{out}") for out, c in metrics.items()]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("count_files"), *means)
    found = exact_medians(df, keys, list(metrics.values()))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_{out}") for out, c in metrics.items()])
    same = [counts[k].eqNullSafe(wide[k]) for k in keys]
    medians = [round6(wide[f"_{out}"]).alias(f"median_{out}") for out in metrics]
    both = counts.join(wide, same, "left").select(*[counts[k] for k in keys], "count_files", *[f"mean_{out}" for out in metrics], *medians)
    order = [*keys, "count_files", *[f"{kind}_{out}" for out in metrics for kind in ("mean", "median")]]
    return both.select(*order)


def comparison_matrix(df: DataFrame, row: str, col: str, value: str, most: int = 1000) -> DataFrame:
    """row x col matrix of the mean ``value`` per cell, missing cells -> 0. The columns are the values
    found in the data; more than ``most`` of them is an error, never a cut."""
    found = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different values of {col}")
    wide = df.groupBy(row).pivot(col, sorted(found)).agg(round6(F.avg(value)))
    return wide.na.fill(0.0, found)


def diff_within_group(df: DataFrame, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """value - previous value in (part, order); the first row of a group keeps its value."""
    w = Window.partitionBy(part).orderBy(*[F.col(o).asc_nulls_last() for o in order])
    return df.withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(w), F.col(value)))


def column_profile(df: DataFrame) -> DataFrame:
    """(column_name, position, non_null) for every column, from one aggregate."""
    n = len(df.columns)
    wide = df.agg(*[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    stack = ", ".join(f"'{c}', {i}, n{i}" for i, c in enumerate(df.columns))
    return wide.selectExpr(f"stack({n}, {stack}) as (column_name, position, non_null)")


def discover_features(df: DataFrame, file_col: str, exclude: list[str]) -> DataFrame:
    """(feature): numeric columns that hold a value in at least one file, sorted. A column that a file
    lacks is null in all its rows."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint", "boolean"}
    names = sorted(f.name for f in df.schema.fields
                   if f.dataType.simpleString() in numeric and f.name not in exclude and f.name != file_col)
    per_file = df.groupBy(qcol(file_col)).agg(*[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(names)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(names))
    return per_file.selectExpr(f"stack({len(names)}, {stack}) as (feature, n)").where("n > 0").select("feature").distinct()
