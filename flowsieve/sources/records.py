"""CSV records in file order: where they start, which row of its file each one is, and the first few of a file.

Files stay split. A quoted field may hold line breaks, so a split cannot know whether it begins inside one:
every split counts its quotes and, for both cases, the records that start in it; the running parity over the
splits of a file then says which case holds (one row a split). Records that reach over a split's end leave
fragments, at most two a split, which are put together by owner. Quotes stand around fields or are
escaped by a backslash or by doubling, as the CSV reader expects them.

Row positions need no sort: a split's rows are numbered as they are read, and what lies before a split is a
prefix sum over the table of splits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.session import scratch_path

MOST_SPLITS = 1 << 20  # rows of a table of splits that may be broadcast, 32 bytes each
FILES_A_JOB = 128  # scans in one union


def literal_path(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def csv_files(spark: SparkSession, path) -> list[str]:
    """The CSV files under a folder, glob or list of them, by name; nothing of their content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    return sorted(r.path for r in found.where("length > 0").select("path").collect())


def file_readers(spark: SparkSession) -> SparkSession:
    """A session whose scans give a file to one task, so that a limit on it stops after that many lines."""
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, str(1 << 50))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def first_lines(spark: SparkSession, files: list[str], n: int):
    """Frames (file, at, value) of the first ``n`` non-blank lines of each file, ``FILES_A_JOB`` files a frame.
    A task reads one file and stops after those lines."""
    own = file_readers(spark)
    for i in range(0, len(files), FILES_A_JOB):
        frame = None
        for f in files[i:i + FILES_A_JOB]:
            one = own.read.text(literal_path(f)).where(F.trim("value") != "").limit(n)
            one = one.select(F.lit(f).alias("file"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at"), "value")
            frame = one if frame is None else frame.unionAll(one)
        yield frame


def lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, value): lines as the CSV reader cuts them, with the split that each starts in."""
    d = spark.read.text([literal_path(f) for f in files])
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _quotes() -> Column:
    """Number of quotes of a line that are not escaped by a backslash."""
    bare = F.when(F.instr("value", "\\") > 0, F.regexp_replace("value", r"\\.", "")).otherwise(F.col("value"))
    return (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))).cast("int")


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(key)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True)) if len(key) else []


def _key() -> Column:
    return F.xxhash64("file", "block")


def split_table(text: DataFrame) -> DataFrame:
    """(file, block, opens, n): whether a split begins inside a quoted field, and how many records start in it."""
    d = text.select(_key().alias("key"), "file", "block", _quotes().alias("q"), (F.trim("value") != "").alias("full"))

    def count(batches):
        key, now = None, None
        for b in batches:
            keys, q, full = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "q", "full"))
            for lo, hi in _runs(keys):
                if keys[lo] != key:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([now])
                    key, now = keys[lo], {"file": b.column("file")[lo].as_py(), "block": b.column("block")[lo].as_py(), "odd": 0, "closed": 0, "opened": 0}
                inside = (now["odd"] + np.cumsum(q[lo:hi]) - q[lo:hi]) & 1
                now["closed"] += int((full[lo:hi] & (inside == 0)).sum())
                now["opened"] += int((full[lo:hi] & (inside == 1)).sum())
                now["odd"] = int((now["odd"] + q[lo:hi].sum()) & 1)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now])

    each = d.mapInArrow(count, "file string, block long, odd long, closed long, opened long")
    before = F.coalesce(F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    return each.select("file", "block", (before == 1).alias("opens"), F.when(before == 1, F.col("opened")).otherwise(F.col("closed")).alias("n"))


def by_split(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``df`` with columns of its split: a broadcast of fixed-size rows while the table is small, a join beyond it.
    Files that were cut otherwise in the pass that made the table (the session's settings or its cores changed
    meanwhile) are an error, never lost rows."""
    small = table.select(_key().alias("_split"), F.lit(True).alias("_known"), *columns)
    small = F.broadcast(small) if table.count() <= MOST_SPLITS else small
    both = df.withColumn("_split", _key()).join(small, "_split", "left")
    known = F.coalesce("_known", F.raise_error(F.lit("files were cut into other splits than before: read them again")).cast("boolean"))
    return both.where(known).drop("_split", "_known")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


COMPLETE, HEAD, TAIL = 0, 1, 2


def whole_records(text: DataFrame) -> DataFrame:
    """(file, block, at, value): records with their line breaks; ``at`` numbers those that start in a split."""
    table = stored(split_table(text), "csv-splits")
    d = by_split(text, table, "opens").select(_key().alias("key"), "file", "block", "opens", "value", _quotes().alias("q"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("value", pa.string())])

    def rows(file, block, some):
        return pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), pa.array([block] * len(some), pa.int64()),
                                           *(pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True))], schema=schema)

    def assemble(batches):
        key, place, inside, started, held, held_at = None, None, 0, 0, [], -1
        for b in batches:
            keys, q, value = b.column("key").to_numpy(), b.column("q").to_numpy().astype(np.int64), b.column("value")
            for lo, hi in _runs(keys):
                if keys[lo] != key:
                    if held:
                        yield rows(*place, [(held_at, HEAD if held_at >= 0 else TAIL, "\n".join(held))])
                    key, place = keys[lo], (b.column("file")[lo].as_py(), b.column("block")[lo].as_py())
                    inside, started, held, held_at = int(b.column("opens")[lo].as_py()), 0, [], -1
                part = value.slice(lo, hi - lo)
                before = (inside + np.cumsum(q[lo:hi]) - q[lo:hi]) & 1
                after = (before + q[lo:hi]) & 1
                full = np.array(pc.not_equal(pc.utf8_trim(part, " \t"), ""))
                starts = (before == 0) & full
                at = started + np.cumsum(starts) - 1
                alone = np.flatnonzero(starts & (after == 0))
                if len(alone):
                    yield pa.RecordBatch.from_arrays([pa.array([place[0]] * len(alone), pa.string()), pa.array(np.full(len(alone), place[1])), pa.array(at[alone]),
                                                      pa.array(np.full(len(alone), COMPLETE, np.int32)), part.take(pa.array(alone))], schema=schema)
                broken, joined = np.flatnonzero((before == 1) | (after == 1)), []
                for first, last, number, line in zip((before[broken] == 0).tolist(), (after[broken] == 0).tolist(), at[broken].tolist(),
                                                     part.take(pa.array(broken)).to_pylist(), strict=True):
                    if first:
                        held, held_at = [], number
                    held.append(line)
                    if last:
                        joined.append((held_at, COMPLETE if held_at >= 0 else TAIL, "\n".join(held)))
                        held, held_at = [], -1
                if joined:  # one batch for all of them, no larger than the lines that came
                    yield rows(*place, joined)
                inside, started = int(after[-1]), started + int(starts.sum())
        if held:
            yield rows(*place, [(held_at, HEAD if held_at >= 0 else TAIL, "\n".join(held))])

    out = stored(d.mapInArrow(assemble, "file string, block long, at long, kind int, value string"), "csv-records")
    parts = out.where(F.col("kind") != COMPLETE)
    # of a split's fragments the tail of an earlier record comes first
    owner = F.last(F.when(F.col("kind") == HEAD, F.col("block")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    pieces = F.array_sort(F.collect_list(F.struct(F.col("piece").alias("block"), "value")))
    joined = parts.select("file", owner.alias("block"), F.col("block").alias("piece"), "at", "value").groupBy("file", "block").agg(
        F.max("at").alias("at"), F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value"))
    return out.where(F.col("kind") == COMPLETE).select("file", "block", "at", "value").unionByName(joined.select("file", "block", "at", "value"))


def records(spark: SparkSession, files: list[str], multiline: bool) -> DataFrame:
    """(file, block, at, value): the records of the files, headers among them."""
    text = lines(spark, files)
    if multiline:
        return whole_records(text)
    # the filter stays below the numbering: only rows that pass are numbered
    return text.where(F.trim("value") != "").select("file", "block", F.monotonically_increasing_id().alias("at"), "value")


def count_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, rows) without headers, quoted line breaks respected; one pass, no file in one task."""
    return split_table(lines(spark, files)).groupBy("file").agg((F.sum("n") - 1).cast("bigint").alias("rows"))


def part_number(file: Column) -> Column:
    """The number of a part file, 0 for a file that is no part of a folder."""
    return F.coalesce(F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).try_cast("bigint"), F.lit(0))


def positioned(rows: DataFrame, logical: Column) -> DataFrame:
    """``rows`` (with file, block, at; headers included) without headers, plus ``position``, the 0-based row of
    the logical file: a plain file, or a folder of part files in the order of their numbers.

    Both passes have to see the same numbers: ``rows`` are written already, or read a second time from files cut and
    dealt to tasks as before. A row that is numbered otherwise (the session's settings or its cores changed
    meanwhile) is an error, never a wrong position."""
    table = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = table.withColumn("skip", F.when(F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1, 1).otherwise(0)) \
        .withColumn("n", F.col("n") - F.col("skip")).withColumn("logical", logical)
    before = earlier(Window.partitionBy("logical").orderBy(part_number(F.col("file")), "file", "block"))
    table = stored(inside.select("file", "block", "first", "last", (before - F.col("first") - F.col("skip")).alias("shift"), F.when(F.col("skip") == 1, F.col("first")).alias("header")), "csv-positions")
    same = F.when(F.col("at").between(F.col("first"), F.col("last")), F.lit(True)).otherwise(
        F.raise_error(F.lit("rows were numbered otherwise than before: read the files again")).cast("boolean"))
    d = by_split(rows, table, "first", "last", "shift", "header").where(same).where(F.col("header").isNull() | (F.col("at") != F.col("header")))
    return d.withColumn("position", (F.col("at") + F.col("shift")).cast("bigint")).drop("at", "block", "first", "last", "shift", "header")
