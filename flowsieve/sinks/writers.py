"""Writers: predictions / metrics tables, bucketed re-chunking, two-table result export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.labels import map_label_inverse
from flowsieve.functions.util import md5_u32
from flowsieve.functions.vectors import softmax, topk_scores
from flowsieve.operators.clean import row_index


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV with a header line in every part file (an empty frame still writes one part)."""
    df.write.mode("overwrite").option("header", header).csv(path)


def prediction_output(df: DataFrame, id_col: str, y: str, p: str, scores: str, model: str, k: int = 3, digits: int = 3) -> DataFrame:
    """The full prediction table: idx (by ``id_col``), id, true and predicted class and name, whether they
    agree, the ``k`` highest class probabilities (softmax of ``scores``, rounded), model."""
    top = F.transform(topk_scores(softmax(scores), k), lambda x: F.round(x, digits) + F.lit(0.0))
    out = df.select(F.col(id_col), y, p, map_label_inverse(y).alias("true_name"), map_label_inverse(p).alias("predicted_name"),
                    (F.col(y) == F.col(p)).alias("correct"), top.alias("_top"))
    out = out.select(*[c for c in out.columns if c != "_top"], *[F.get("_top", F.lit(i)).alias(f"top{i + 1}") for i in range(k)])
    return row_index(out, [id_col]).withColumn("model", F.lit(model))


def write_predictions(df: DataFrame, path: str) -> None:
    """One combined folder with a folder for each model."""
    df.write.mode("overwrite").option("header", True).partitionBy("model").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def rechunk(df: DataFrame, key, path: str, buckets: int = 20) -> None:
    """Deterministic shuffle of rows into ``buckets`` directories (bucket=<b>) in one pass.

    bucket = md5(key) mod buckets; rows are dealt to writers by (bucket, salt), as many salts as
    the session's shuffle partitions give room for, so a bucket is several files written by several
    tasks, and later reads prune by bucket."""
    h = md5_u32(key)
    b = (h % F.lit(buckets)).cast("int").alias("bucket")
    room = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-room // buckets))
    salt = (F.floor(h / F.lit(buckets)) % F.lit(salts)).alias("_salt")
    df.select("*", b, salt).repartition(max(room, buckets), "bucket", "_salt").drop("_salt") \
        .write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Buckets first..last (inclusive) - a partition filter, so other buckets are never listed/read."""
    return spark.read.parquet(path).where((F.col("bucket") >= first) & (F.col("bucket") <= last))


def write_two_tables(raw: DataFrame, summary: DataFrame, path: str) -> tuple[str, str]:
    """The raw rows and their summary as two parquet tables under ``path``."""
    rp, sp = f"{path}/raw", f"{path}/summary"
    raw.write.mode("overwrite").parquet(rp)
    summary.write.mode("overwrite").parquet(sp)
    return rp, sp
