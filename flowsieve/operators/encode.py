"""Categorical encoders whose categories are learnt once (at fit) and then applied as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.util import qcol


MAX_CATEGORIES = 10_000


def learn_categories(df: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list:
    """Distinct non-null values, sorted. The distinct runs distributed (partial aggregation); at most
    ``most`` values reach the driver, and a column with more is an error, never a cut."""
    found = [r[0] for r in df.select(qcol(column)).where(qcol(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"column {column} has more than {most} categories")
    return sorted(found)


def one_hot(df: DataFrame, column: str, categories: list | None = None, drop_first: bool = True,
            prefix: str | None = None, keep_source: bool = False) -> DataFrame:
    """0/1 int indicator columns ``{prefix}_{value}``; the lowest category is dropped by default."""
    cats = learn_categories(df, column) if categories is None else list(categories)
    if drop_first:
        cats = cats[1:]
    prefix = prefix or column
    ind = [F.coalesce(qcol(column) == F.lit(v), F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in cats]
    base = [qcol(c) for c in df.columns if keep_source or c != column]
    return df.select(*base, *ind)


def label_encoder_fit(df: DataFrame, column: str) -> list[str]:
    """Alphabetical class list (index = position)."""
    return learn_categories(df, column)


def label_encode(df: DataFrame, column: str, classes: list[str], out: str) -> DataFrame:
    """name -> alphabetical ordinal via a literal CASE; unseen -> null."""
    e = None
    for i, v in enumerate(classes):
        e = F.when(qcol(column) == F.lit(v), F.lit(i)) if e is None else e.when(qcol(column) == F.lit(v), F.lit(i))
    return df.withColumn(out, e.cast("int") if e is not None else F.lit(None).cast("int"))


def label_decode(df: DataFrame, column: str, classes: list[str], out: str) -> DataFrame:
    arr = F.array(*[F.lit(v) for v in classes])
    return df.withColumn(out, F.try_element_at(arr, qcol(column) + 1))
