"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def position(df: DataFrame, name: str) -> int:
    """Place of a column by its exact name, else by the only one that differs in case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    alike = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact and len(alike) != 1:
        raise ValueError(f"no column {name}")
    return alike[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under new names; all others, also those whose names clash or
    differ in case only, are left behind."""
    at = {new: position(df, name) for new, name in columns.items()}
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return inner.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


class Sealed:
    """``df`` with its columns as c0, c1, ..., so that an operator's own columns cannot clash with
    them; ``open`` gives them back under their names, whatever these are."""

    def __init__(self, df: DataFrame):
        self.names, self.source = df.columns, df
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def column(self, name: str) -> str:
        return f"c{position(self.source, name)}"

    def open(self, df: DataFrame, *more: str, without: tuple[str, ...] = ()) -> DataFrame:
        """All columns but those of the inner names ``without``, then the new ones ``more`` (an old
        column of the same name gives way)."""
        kept = [i for i, n in enumerate(self.names) if f"c{i}" not in without and n.lower() not in more]
        return df.select(*[F.col(f"c{i}") for i in kept], *more).toDF(*[self.names[i] for i in kept], *more)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts lineage,
    survives lost executors, and every later branch reads the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row (nested ones as JSON text)."""
    cols = [F.to_json(F.struct(named(c))) if kind.startswith(("map", "struct", "array", "variant")) else named(c)
            for c, kind in df.dtypes]
    return F.xxhash64(*cols)
