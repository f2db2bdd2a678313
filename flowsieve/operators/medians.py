"""Exact medians of groups of any size by histogram refinement.

Every group looks for its two middle ranks. A pass counts the values between the bounds of each search in bins,
map-side combined; the bin that holds the rank becomes the new bounds (its least and greatest value). The first
pass bins by sign and power of two, so that outliers cost nothing; the later ones cut the bounds into 4,096 equal
parts. It ends when all bounds have met: five or six passes for arbitrary doubles, two or three for values
that repeat. No group is ever in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import scratch_path

BINS = 4096
MOST_SEARCHES = 1 << 18  # bounds that may be broadcast, some 60 bytes each


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _narrowed(values: DataFrame, searches: DataFrame, first: bool) -> DataFrame:
    """One pass: (g, rank, low, high, below) with tighter bounds."""
    x, lo, hi = F.col("x"), F.col("low"), F.col("high")
    if first:
        power = F.when(F.isnan(x), F.lit(4001.0)).when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (2000 + F.greatest(F.lit(-1100.0), F.least(F.floor(F.log2(F.abs(x))).cast("double"), F.lit(1100.0)))))
        number = power.cast("int")
    else:
        half = x / 2 - lo / 2  # halves: the difference of two doubles may leave their range
        number = F.least(F.floor(half / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1)).cast("int")
        number = F.when(x == hi, BINS).when(x == lo, -1).otherwise(number)
    small = searches.count() <= MOST_SEARCHES
    s = searches.select(F.col("g").alias("_g"), "rank", "low", "high", "below")
    inside = values.join(F.broadcast(s) if small else s, (F.col("g") == F.col("_g")) & (x >= lo) & (x <= hi))
    bins = inside.groupBy("g", "rank", "below", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    w = Window.partitionBy("g", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.col("below") + F.sum("n").over(w))
    return bins.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(
        "g", "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below"))


def exact_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, median) for every group and column; null values do not count, NaN is the greatest value, and a
    group without values has no row. Null keys are keys."""
    g = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col("column")), {"ignoreNullFields": "false"})
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(names).alias("_v")).select(*[F.col(f"`{k}`") for k in keys], "_v.column", "_v.x")
    rows = _stored(rows.where(F.col("x").isNotNull()).withColumn("g", F.xxhash64(g)).withColumn("text", g), "median-values")
    groups = _stored(rows.groupBy("g", "text", *keys, "column").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "median-groups")
    if groups.groupBy("g").count().where("count > 1").limit(1).count():
        raise ValueError("two groups of one hash")
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    searches = groups.select("g", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("bigint").alias("below"))
    values, done, first = rows.select("g", "x"), None, True
    while True:
        met = searches.where("low = high").select("g", "low")
        done = met if done is None else done.unionByName(met)
        searches = _stored(searches.where("low <> high"), "median-bounds")
        if not searches.limit(1).count():
            break
        searches, first = _stored(_narrowed(values, searches, first), "median-bounds"), False
    medians = done.groupBy("g").agg((F.min("low") / 2 + F.max("low") / 2).alias("halves"), (F.min("low") + F.max("low")).alias("sum"))
    # the mean of the two middle values; by halves where their sum leaves the range of a double
    value = F.when(F.abs("sum") == float("inf"), F.col("halves")).otherwise(F.col("sum") / 2)
    return groups.join(medians, "g").select(*[F.col(f"`{k}`") for k in keys], "column", value.alias("median"))
