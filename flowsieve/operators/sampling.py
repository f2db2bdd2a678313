"""Deterministic sampling, splitting and class balancing.

Randomness comes from md5 of a row key (``md5_u32``) so any engine reproduces the
same rows and reruns after executor loss select exactly the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.util import U32, as_col, md5_u32
from flowsieve.session import scratch_path


def hash_bucket(key, buckets: int):
    return (md5_u32(key) % F.lit(buckets)).cast("int")


def hash_sample(df: DataFrame, key, fraction: float) -> DataFrame:
    """Keep rows whose key hash falls below ``fraction`` of the 32-bit range."""
    return df.where(md5_u32(key) < F.lit(int(fraction * U32)))


def sample_bernoulli(df: DataFrame, p: float, seed: int = 42) -> DataFrame:
    """Independent keep-with-probability-p (Spark's own sampler; not engine-reproducible)."""
    return df.sample(withReplacement=False, fraction=p, seed=seed)


def split_two(df: DataFrame, key, test_percent: int = 25):
    """(train, test) by key hash into 100 buckets; test = buckets < test_percent."""
    b = hash_bucket(key, 100)
    return df.where(b >= F.lit(test_percent)), df.where(b < F.lit(test_percent))


def split_two_label(key, test_percent: int = 25):
    """'test' | 'train' as a column: both parts from one pass."""
    return F.when(hash_bucket(key, 100) < F.lit(test_percent), F.lit("test")).otherwise(F.lit("train"))


def split_label(key, test_percent: int = 25, val_percent_of_rest: int = 20):
    """'test' | 'val' | 'train' (25 / 15 / 60 with defaults) from nested hash thresholds."""
    b = hash_bucket(key, 100)
    val_hi = test_percent + (100 - test_percent) * val_percent_of_rest // 100
    return (F.when(b < F.lit(test_percent), F.lit("test"))
            .when(b < F.lit(val_hi), F.lit("val")).otherwise(F.lit("train")))


def split_three(df: DataFrame, key, test_percent: int = 25, val_percent_of_rest: int = 20):
    s = df.withColumn("_split", split_label(key, test_percent, val_percent_of_rest))
    return tuple(s.where(F.col("_split") == F.lit(n)).drop("_split") for n in ("train", "val", "test"))


def shuffle_rows(df: DataFrame, key, partitions: int | None = None) -> DataFrame:
    """A deterministic permutation: hash-partition, then order by key hash within partitions.

    No global sort (no single ordered stream is needed by any consumer)."""
    h = md5_u32(key)
    out = df.withColumn("_h", h)
    out = out.repartition(partitions, "_h") if partitions else out.repartition("_h")
    return out.sortWithinPartitions("_h").drop("_h")


def class_weights(df: DataFrame, label: str, classes: list[int]) -> DataFrame:
    """weight = total / (C * count); 0 for a class that does not occur."""
    spark = df.sparkSession
    cls = spark.createDataFrame([(int(c),) for c in classes], "c int")
    cnt = df.groupBy(F.col(label).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("cnt"))
    # total over all rows, also those of labels outside ``classes`` (a window over the count table)
    cnt = cnt.withColumn("total", F.sum("cnt").over(Window.partitionBy()))
    j = cls.join(cnt, "c", "left")
    w = F.when(F.col("cnt") > 0, F.col("total") / (F.lit(len(classes)) * F.col("cnt"))).otherwise(F.lit(0.0))
    return j.select("c", F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("count"), w.alias("weight"))


def with_class_weight(df: DataFrame, label: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    """Attach the weight column (``weightCol`` for Spark ML); the weight table has C rows."""
    return df.join(F.broadcast(weights.select(F.col("c").alias(label), F.col("weight").alias(out))), label, "left")


def weighted_resample(df: DataFrame, key, weight: str, n: int, total_weight: float) -> DataFrame:
    """Sample with replacement, P(row) proportional to ``weight``; expected n rows in total.

    Each row gets a replica count floor(e) + [frac(e) > u] with e = n*w/sum(w) and u a key
    hash in [0,1); replicas come from ``explode(sequence)`` - no shuffle, no driver."""
    e = F.col(weight) * F.lit(float(n) / float(total_weight))
    u = md5_u32(F.concat(as_col(key).cast("string"), F.lit("#r"))) / F.lit(float(U32))
    reps = (F.floor(e) + (F.lit(1) * ((e - F.floor(e)) > u).cast("int"))).cast("int")
    return (df.withColumn("_reps", reps).where("_reps > 0")
            .withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("_reps")))).drop("_reps"))


# --------------------------------------------------------------------------------------
# Exact bounded rank per group without sorting a whole group in one task.
# --------------------------------------------------------------------------------------

BOUNDARY_BYTES = 64 << 20  # of boundaries of groups that may be broadcast


def _sent_if_small(boundaries: DataFrame, group: str) -> DataFrame:
    """Boundaries written once, and broadcast while their size is bounded: rows are then filtered where they are
    read. Left to the planner, some 100,000 groups would be joined by a shuffle of all rows."""
    path = scratch_path(boundaries.sparkSession, "group-boundaries")
    boundaries.write.parquet(path)
    boundaries = boundaries.sparkSession.read.schema(boundaries.schema).parquet(path)
    size = boundaries.agg(F.sum(F.coalesce(F.octet_length(F.col(group).cast("string")), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(boundaries) if size <= BOUNDARY_BYTES else boundaries


def bounded_rank_filter(df: DataFrame, group: str, order_hash: str, tiebreak: str, limit,
                        levels: int = 16, many_groups: bool = False) -> DataFrame:
    """Keep, in each group, the rows ranked <= quota by (order_hash, tiebreak).

    ``order_hash`` is a 32-bit value. ``limit`` is either a column name holding the group's
    quota or a function count_column -> quota column (the group size then comes from the
    histogram, saving a pass). A group can hold a third of the data, so we never window
    over a whole group:

    1. histogram (group, order_hash >> levels) -> counts; tiny, partially aggregated.
    2. cumulative counts per group over that histogram (a window over the histogram,
       at most 2**(32-levels) rows per group) find the boundary bucket.
    3. rows below the boundary bucket are kept outright; only rows *in* the boundary
       bucket (about 2**-(32-levels) of the group) are ranked with ``row_number``.

    ``many_groups``: groups are many and small. Give them fewer buckets (more ``levels``) than rows, or the histogram
    is as large as the data; their boundaries are written once and broadcast.
    """
    b = F.shiftright(F.col(order_hash), levels)
    if callable(limit):
        hist = df.groupBy(group, b.alias("_b")).agg(F.count(F.lit(1)).alias("_cnt"))
        hist = hist.withColumn("_lim", limit(F.sum("_cnt").over(Window.partitionBy(group))))
    else:
        hist = df.groupBy(group, b.alias("_b")).agg(F.count(F.lit(1)).alias("_cnt"), F.first(limit).alias("_lim"))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(w)).withColumn("_before", F.col("_cum") - F.col("_cnt"))
    # boundary: first bucket whose cumulative count reaches the quota (null -> group fits entirely)
    bnd = (hist.where(F.col("_cum") >= F.col("_lim"))
           .groupBy(group).agg(F.min(F.struct("_b", "_before", "_lim")).alias("_m"))
           .select(group, F.col("_m._b").alias("_bb"), F.col("_m._before").alias("_bbefore"),
                   F.col("_m._lim").alias("_blim")))
    # null is a group like any other; rows above the boundary go at once, and only rows in it share
    # a window partition: all others are spread by their hash
    bnd = bnd.withColumnRenamed(group, "_g")
    bnd = _sent_if_small(bnd, "_g") if many_groups else bnd
    d = df.withColumn("_b", b).join(bnd, F.col(group).eqNullSafe(F.col("_g")), "left")
    d = d.where(F.col("_bb").isNull() | (F.col("_b") <= F.col("_bb")))
    at_edge = F.coalesce(F.col("_b") == F.col("_bb"), F.lit(False))
    we = Window.partitionBy(group, "_b", F.when(~at_edge, F.col(order_hash))).orderBy(order_hash, tiebreak)
    return (d.withColumn("_r", F.row_number().over(we)).where(~at_edge | (F.col("_r") + F.col("_bbefore") <= F.col("_blim")))
            .drop("_b", "_bb", "_bbefore", "_blim", "_g", "_r"))


def sample_exact_per_group(df: DataFrame, group: str, key: str, fraction: float, minimum: int = 1, **ranked) -> DataFrame:
    """Exactly max(minimum, floor(count * fraction)) rows of each group, chosen by key hash. ``ranked``: how
    ``bounded_rank_filter`` goes about it, at no change of the rows."""
    d = df.withColumn("_h", md5_u32(key)).withColumn("_k", as_col(key).cast("string"))
    quota = lambda n: F.greatest(F.lit(minimum), F.floor(n * F.lit(fraction) + F.lit(1e-9))).cast("bigint")
    return bounded_rank_filter(d, group, "_h", "_k", quota, **ranked).drop("_h", "_k")
