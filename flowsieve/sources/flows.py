"""Flow CSV / parquet scans and file-derived columns.

CSV headers of flow exports are padded with spaces, may repeat, and differ from file to file in
order and set: files are grouped by header and joined by column name. Types are never inferred;
columns are cast by name from an explicit type map in one projection. Where records start and which row
of its file each is (quoted line breaks, chunks by row, first rows of a file) is found in ``records``.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.labels import map_label
from flowsieve.functions.util import qcol
from flowsieve.operators.clean import unparseable_counts
from flowsieve.sources.records import count_rows, csv_files, first_lines, literal_path, positioned, records, stored

# Explicit types by (trimmed) name; a column without one stays text unless asked for.
FLOW_TYPES = {
    "Flow ID": "string", "Source IP": "string", "Destination IP": "string", "Timestamp": "timestamp_ntz",
    "SimillarHTTP": "string", "Label": "string", "Protocol": "int", "Inbound": "int",
    "source_file": "string", "chunk_id": "int", "Packets": "double", "Bytes": "double", "Discount": "double",
    "Tax": "double", "Size": "double", "Retail Price": "double", "Flow Bytes/s": "double",
}


def unique_names(header: list[str]) -> list[str]:
    """Trimmed column names; a name that repeats (also only after trimming) gets ``.1``, ``.2``, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in (h.strip() for h in header):
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(f"{name}.{k}" if k else name)
    return out


def file_headers(spark: SparkSession, path) -> list[tuple[list[str], list[str]]]:
    """(trimmed unique column names, files that have them), for each header that occurs under a folder or
    glob, or in a list of files.

    Each file's first line is read by a task that stops there; the driver gets one row a file, as it does
    from any file listing."""
    files = csv_files(spark, path) if isinstance(path, str) else list(path)
    groups: dict[str, list[str]] = {}
    for frame in first_lines(spark, files, 1):
        for r in sorted(frame.collect(), key=lambda r: r.file):
            groups.setdefault(r.value, []).append(r.file)
    return [(unique_names(next(csv.reader([h]))), files) for h, files in groups.items()]


def parsed(rows: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """CSV records in ``value`` as text columns, and the columns ``keep``."""
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))))
    return rows.select(*keep, fields.alias("_r")).select(*keep, *[F.col(f"_r.c{i}").alias(n) for i, n in enumerate(names)])


def typed(df: DataFrame, types: dict, string_columns=(), undeclared: str = "text") -> DataFrame:
    """Text columns cast by name; columns without a declared type stay text, or become double where
    every value parses (``undeclared="numeric"``: one more pass over them)."""
    free = [c for c in df.columns if c not in types and c not in string_columns and c != "file_path"]
    numeric = set()
    if undeclared == "numeric" and free:
        numeric = {r.column_name for r in unparseable_counts(df, free).where("bad = 0").collect()}
    out = []
    for c in df.columns:
        t = "string" if c in string_columns or c == "file_path" else types.get(c, "double" if c in numeric else "string")
        out.append(qcol(c) if t == "string" else qcol(c).try_cast(t).alias(c))
    return df.select(*out)


def read_flow_csv(spark: SparkSession, path, types: dict | None = None, string_columns=(), undeclared: str = "text",
                  multiline: bool = False, positions: bool = False) -> DataFrame:
    """Flow CSVs of a directory, glob or list of files, joined BY COLUMN NAME, plus ``file_path``.

    Files may differ in the order and set of their columns: each distinct header is one scan with
    that header's schema, and the scans are united by name (absent columns are null). Names are
    trimmed and made unique; types come from the declared map, never from inference. ``multiline``: quoted
    fields may hold line breaks; such files stay split. ``positions`` adds ``position``, the 0-based row
    of the logical file (a plain file, or a folder ``<name>.csv`` of part files); records with line breaks are written
    once in the shared folder, so that the numbers hold, other lines are read a second time."""
    types = dict(FLOW_TYPES, **(types or {}))
    df = None
    for names, files in file_headers(spark, path):
        if multiline or positions:
            rows, logical = records(spark, files, multiline), F.regexp_extract("file", LOGICAL_FILE, 1)
            if multiline:
                rows = positioned(stored(parsed(rows, names, "file", "block", "at"), "flow-records"), logical)
            else:  # lines are numbered as they are read, twice: no copy of the files
                rows = parsed(positioned(rows, logical), names, "file", "position")
            rows = rows.withColumnRenamed("file", "file_path")
            part = rows if positions else rows.drop("position")
        else:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            part = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv([literal_path(f) for f in files])
            part = part.select(*[qcol(c) for c in part.columns], F.col("_metadata.file_path").alias("file_path"))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if df is None:
        raise FileNotFoundError(f"no CSV files under {path}")
    return typed(df, dict(types, position="bigint") if positions else types, string_columns, undeclared)


def with_chunks(df: DataFrame, rows: int, position: str = "position") -> DataFrame:
    """``chunk_id``: the chunk of ``rows`` consecutive rows of its file that a row belongs to."""
    return df.withColumn("chunk_id", F.expr(f"`{position}` div {int(rows)}").cast("int"))


def head_rows(spark: SparkSession, path, n: int, types: dict | None = None, string_columns=()) -> DataFrame:
    """The first ``n`` rows of every logical file, in file order, with ``position``. A file is read up to its
    n-th row and no further; a quoted line break ends a row here."""
    types, df = dict(FLOW_TYPES, position="bigint", **(types or {})), None
    for names, files in file_headers(spark, path):
        for frame in first_lines(spark, files, n + 1):
            rows = stored(parsed(frame.withColumn("block", F.lit(0).cast("bigint")), names, "file", "block", "at"), "flow-heads")
            df = rows if df is None else df.unionByName(rows, allowMissingColumns=True)
    if df is None:
        raise FileNotFoundError(f"no CSV files under {path}")
    df = positioned(df, F.regexp_extract("file", LOGICAL_FILE, 1)).where(F.col("position") < n)
    return typed(df.withColumnRenamed("file", "file_path"), types, string_columns)


def write_flow_csv(df: DataFrame, path: str, pad: str = " ", partition_by: str | None = None) -> None:
    """Write flows as CSV with padded header names (the export layout of flow tools)."""
    cols = [c for c in df.columns if c != partition_by]
    w = df.select(*[qcol(c).alias(pad + c) for c in cols], *([qcol(partition_by)] if partition_by else []))
    wr = w.write.mode("overwrite").option("header", True)
    if partition_by:
        wr = wr.partitionBy(partition_by)
    wr.csv(path)


# tried at the starts of path components only: the same match, in time linear in the path
FILE_STEM_PATTERN = r"(?:^|[/=])([^/=]+?)\.csv(?:/|$)"
LOGICAL_FILE = r"^(.*?\.csv)(?:/|$)"  # a file, or the folder of its part files


def file_stem(path_col="file_path"):
    """Stem of the first ``<name>.csv`` path component (plain files or Spark partition dirs)."""
    return F.regexp_extract(F.col(path_col), FILE_STEM_PATTERN, 1)


def label_from_filename(df: DataFrame, mapping: dict, path_col: str = "file_path", out: str = "file_label"):
    """(labelled rows, skipped-files report): rows of files whose stem is not in the mapping are
    dropped; the report lists those files with their row counts (an anti-join result)."""
    d = df.withColumn("_stem", file_stem(path_col)).withColumn(out, map_label(F.col("_stem"), mapping))
    kept = d.where(F.col(out).isNotNull()).drop("_stem")
    skipped = d.where(F.col(out).isNull()).groupBy(F.col("_stem").alias("file")).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"))
    return kept, skipped


def read_labelled(spark: SparkSession, path, mapping: dict, out: str = "file_label", **options) -> tuple[DataFrame, DataFrame]:
    """``label_from_filename`` over the files themselves: files of known classes are scanned once, of the others only
    the records are counted."""
    files = csv_files(spark, path) if isinstance(path, str) else list(path)
    stems = {f: (m[1] if (m := re.search(FILE_STEM_PATTERN, f)) else "") for f in files}
    known = [f for f in files if stems[f] in mapping]
    other = [f for f in files if stems[f] not in mapping]
    kept, _ = label_from_filename(read_flow_csv(spark, known or files, **options), mapping, out=out)
    skipped = count_per_file(spark, other) if other else spark.createDataFrame([], "file string, rows bigint")
    return kept, skipped.where("rows > 0")


def rows_per_file(df: DataFrame, path_col: str = "file_path") -> DataFrame:
    return df.groupBy(file_stem(path_col).alias("file")).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


def count_per_file(spark: SparkSession, path) -> DataFrame:
    """(file, rows) from the files themselves, line breaks in quotes respected; nothing is parsed."""
    files = csv_files(spark, path) if isinstance(path, str) else list(path)
    return count_rows(spark, files).groupBy(file_stem("file").alias("file")).agg(F.sum("rows").cast("bigint").alias("rows"))


def head_per_file(df: DataFrame, n: int, order_cols: list[str], path_col: str = "file_path") -> DataFrame:
    """First ``n`` rows of every file by ``order_cols``, at any ``n``.

    A first rank inside (file, input partition) drops what can't be among the first n of its file, so
    the second one, over the whole file, sees at most n rows of each input task."""
    from pyspark.sql import Window
    d = df.withColumn("_file", file_stem(path_col)).withColumn("_task", F.spark_partition_id())
    for part in (["_file", "_task"], ["_file"]):
        w = Window.partitionBy(*part).orderBy(*order_cols)
        d = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return d.drop("_task")
