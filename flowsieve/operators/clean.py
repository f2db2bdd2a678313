"""Projections, filters and cleaning policies for flow tables.

Every multi-column transformation is emitted as ONE ``select`` (never ``withColumn``
in a loop) so an 80-column flow table produces one flat projection in codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.labels import known_label
from flowsieve.functions.numbers import inf_to_sentinel, inf_to_zero
from flowsieve.functions.util import qcol
from flowsieve.schema import NON_FEATURE_COLUMNS
from flowsieve.session import scratch_path

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def trim_column_names(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_missing_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any null or NaN (Infinity is kept)."""
    return df.na.drop(how="any", subset=subset)


def filter_known_labels(df: DataFrame, label: str = "Label", mapping: dict | None = None) -> DataFrame:
    return df.where(known_label(qcol(label), mapping))


def filter_one_attack(df: DataFrame, attack: str, label: str = "Label") -> DataFrame:
    return df.where(qcol(label) == F.lit(attack))


def drop_columns_if_exist(df: DataFrame, names=NON_FEATURE_COLUMNS) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric and boolean columns (booleans count as 0/1 features)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC + (T.BooleanType,)) and f.name not in exclude]


def select_numeric(df: DataFrame, exclude=(), keep=()) -> DataFrame:
    """Keep numeric columns (booleans cast to int) plus ``keep``; schema-driven, no data read."""
    out = [qcol(k) for k in keep]
    for f in df.schema.fields:
        if f.name in exclude or f.name in keep:
            continue
        if isinstance(f.dataType, T.BooleanType):
            out.append(qcol(f.name).cast("int").alias(f.name))
        elif isinstance(f.dataType, _NUMERIC):
            out.append(qcol(f.name))
    return df.select(*out)


def unparseable_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bad) where bad = number of non-null values that do not parse as double.

    One global aggregate for all columns, unpivoted with ``stack``."""
    aggs = [F.sum((qcol(c).isNotNull() & qcol(c).cast("string").try_cast("double").isNull()).cast("bigint"))
            .alias(f"b{i}") for i, c in enumerate(columns)]
    stack = ", ".join(f"'{c}', b{i}" for i, c in enumerate(columns))
    return df.agg(*aggs).selectExpr(f"stack({len(columns)}, {stack}) as (column_name, bad)") \
        .select("column_name", F.coalesce(F.col("bad"), F.lit(0)).cast("bigint").alias("bad"))


def drop_unparseable_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast-or-drop: columns with any unparseable value are dropped, the rest cast to double."""
    bad = {r[0] for r in unparseable_counts(df, columns).where("bad > 0").collect()}
    out = []
    for c in df.columns:
        if c in columns:
            if c not in bad:
                out.append(qcol(c).cast("string").try_cast("double").alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def apply_to_columns(df: DataFrame, columns: list[str], fn) -> DataFrame:
    """Apply a column function to the listed columns in one projection."""
    cs = set(columns)
    return df.select(*[fn(qcol(c)).alias(c) if c in cs else qcol(c) for c in df.columns])


def inf_to_sentinel_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_to_columns(df, columns, inf_to_sentinel)


def inf_to_zero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_to_columns(df, columns, inf_to_zero)


def fill_label_missing(df: DataFrame, label: str = "Label", value: str = "missing_value") -> DataFrame:
    return apply_to_columns(df, [label], lambda c: F.coalesce(c, F.lit(value)))


def drop_null_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.where(qcol(label).isNotNull())


def align_features(df: DataFrame, features: list[str], keep=()) -> DataFrame:
    """Exactly ``features`` in order (absent ones as 0.0), plus ``keep``; extras dropped."""
    have = set(df.columns)
    cols = [qcol(k) for k in keep]
    cols += [qcol(f).cast("double").alias(f) if f in have else F.lit(0.0).alias(f) for f in features]
    return df.select(*cols)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def part_order(file_name: str):
    """The number of a part file: names are padded to five digits only, so they do not sort beyond that."""
    return F.regexp_extract(file_name, r"^part-(\d+)", 1).cast("bigint")


def row_index(df: DataFrame, order_cols: list[str], out: str = "idx") -> DataFrame:
    """0-based running index in ``order_cols`` order without a single-partition window.

    The rows are range-sorted once and written to the shared folder: part files follow each
    other in order and every file is sorted. A row's index is the number of rows in earlier files
    (a window over one row per file) plus its position in its file, both fixed by what was
    written, so no second shuffle or retry can see other positions. Rows that are equal on
    ``order_cols`` follow a hash of the whole row, which also splits a hot key's range."""
    path, rows = scratch_path(df.sparkSession, "row-index"), scratch_path(df.sparkSession, "row-index-rows")
    tie = F.xxhash64(*[qcol(c) for c, kind in df.dtypes if not kind.startswith("map")])
    # written first: the range sort reads its input twice (for the bounds, then for the rows)
    df.write.parquet(rows)
    df.sparkSession.read.schema(df.schema).parquet(rows).orderBy(*order_cols, tie).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path).select(
        *[qcol(c) for c in df.columns], F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = back.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(part_order("_file")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return back.join(offsets, "_file").withColumn(out, (F.col("_before") + F.col("_at")).cast("bigint")) \
        .drop("_file", "_at", "_before")
