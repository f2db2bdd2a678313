"""Feature moments (count, mean, sum of squared deviations) that are kept per file and merged: files that arrive later
are read once and added, files seen before are not read again.

The store is a folder of parquet batches, one row a file and feature. A file is known by path, size and time of
change; one that was rewritten is read again and its latest moments count. Merging shifts every file's mean
to the common one, so nothing is lost to cancellation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions.util import qcol
from flowsieve.operators.stats import ScalerModel
from flowsieve.sources.flows import read_flow_csv

STORE = "file string, size bigint, changed timestamp, feature string, n bigint, mean double, m2 double"


def file_moments(df: DataFrame, columns: list[str], file_col: str = "file_path") -> DataFrame:
    """(file, feature, n, mean, m2) over the values of each file that are not null, from one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"s{i}")]
    stack = ", ".join(f"'{c.replace(chr(39), chr(92) + chr(39))}', n{i}, m{i}, s{i}" for i, c in enumerate(columns))
    return df.groupBy(F.col(file_col).alias("file")).agg(*aggs).selectExpr("file", f"stack({len(columns)}, {stack}) as (feature, n, mean, m2)")


def _listing(spark: SparkSession, path) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    return found.select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_modification_time").alias("changed"))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The moments of every file as last read."""
    w = Window.partitionBy("file", "feature").orderBy(F.desc("changed"), F.desc("batch"))
    d = spark.read.schema(STORE + ", batch string").parquet(store)
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")


def add_files(spark: SparkSession, path, store: str, columns: list[str], prepare=lambda df: df) -> list[str]:
    """Read the flow CSVs under ``path`` that the store does not hold yet and add their moments; returns these
    files. ``prepare`` turns the scanned rows into the columns, keeping ``file_path``."""
    listing = _listing(spark, path)
    fs = spark.read.schema(STORE + ", batch string").option("pathGlobFilter", "*.parquet")
    known = None
    try:
        known = fs.parquet(store).select("file", "size", "changed").distinct()
    except Exception as missing:  # nothing stored so far
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    new = listing if known is None else listing.join(known, ["file", "size", "changed"], "left_anti")
    rows = new.collect()  # one row a file, as in any listing
    if not rows:
        return []
    df = prepare(read_flow_csv(spark, [r.path for r in rows if r.size > 0])) if any(r.size > 0 for r in rows) else None
    seen = spark.createDataFrame([(r.file, r.size, r.changed) for r in rows], "file string, size bigint, changed timestamp")
    features = spark.createDataFrame([(c,) for c in columns], "feature string")
    # files without rows are known too
    each = seen.join(F.broadcast(features))
    if df is not None:
        each = each.join(file_moments(df, columns), ["file", "feature"], "left")
        each = each.select("file", "size", "changed", "feature", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))
    else:
        each = each.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    each.coalesce(1).write.parquet(f"{store}/batch={uuid.uuid4().hex}")
    return [r.path for r in rows]


def merged(moments: DataFrame) -> DataFrame:
    """(feature, n, mean, std): population statistics over all files."""
    origin = moments.where("n > 0").groupBy("feature").agg(F.min("mean").alias("_from"))
    away = F.sum(F.col("n") * (F.col("mean") - F.col("_from"))) / F.sum("n")
    total = moments.join(origin, "feature").groupBy("feature", "_from").agg(F.sum("n").alias("n"), away.alias("away"))
    total = total.select("feature", "n", (F.col("_from") + F.col("away")).alias("mean"))
    shift = moments.select("feature", F.col("n").alias("_n"), F.col("mean").alias("_mean"), "m2").join(total, "feature")
    m2 = F.sum(F.col("m2") + F.col("_n") * (F.col("_mean") - F.col("mean")) * (F.col("_mean") - F.col("mean")))
    return shift.groupBy("feature", "n", "mean").agg(F.sqrt(m2 / F.col("n")).alias("std"))


def scaler_of(spark: SparkSession, store: str, columns: list[str]) -> ScalerModel:
    """The scaler of everything the store holds."""
    found = {r.feature: r for r in merged(read_store(spark, store)).collect()}
    pick = lambda c, k: found[c][k] if c in found and found[c]["n"] else None
    return ScalerModel(list(columns), [pick(c, "mean") for c in columns], [pick(c, "std") for c in columns])
