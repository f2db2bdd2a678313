"""Whole-text and line-text scans."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that Spark escapes in the names of partition folders.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
BATCH_BYTES = 8 << 20  # of paths and texts that leave a task together
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _tasks(spark: SparkSession) -> int:
    """Tasks for work that is a file a text, not bytes: left to the sizes of the files it would be a few tasks or, in a
    scan, one for every 32 files."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_whole_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text): one row per file, recursive; undecodable bytes are replaced, not fatal.

    In a ``file:`` folder the tasks list and read the files below its entries themselves: Spark's listing keeps every
    file on the driver, and its whole-text reader sets up a Hadoop job for each."""
    folder = None if re.search(r"[{}\[\]*?\\]", path) or not re.fullmatch(r"\*?[\w.-]+", glob) else local_folder(path)
    if folder is not None and os.path.isdir(folder):
        return _read_local(spark, folder.rstrip("/"), glob)
    # (the wholetext flag must go through text(): its keyword default would override an option())
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).coalesce(_tasks(spark))


def _hidden(name: str) -> bool:
    """Does Spark's listing pass over a file or folder of this name?"""
    return name.startswith(".") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")) or name.endswith("._COPYING_")


def _uri(path: str) -> str:
    """A local path as ``_metadata.file_path`` shows it: ASCII characters are quoted as Java's URI does."""
    return "file:" + re.sub(r"[\x00-\x7f]+", lambda m: quote(m[0], safe="/-_.~!*'();:@&=+$,"), path)


def _read_local(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    def files(at):
        if os.path.isdir(at):
            for name in sorted(os.listdir(at)):
                if not _hidden(name):
                    yield from files(f"{at}/{name}")
        elif at.endswith(glob[1:]) if glob[0] == "*" else os.path.basename(at) == glob:
            yield at

    def read(batches):
        for b in batches:
            paths, texts, size = [], [], 0
            for at in (f for entry in b.column("entry").to_pylist() for f in files(f"{folder}/{entry}")):
                with open(at, "rb") as f:
                    text = f.read()
                if not text:  # Spark's scans leave empty files out
                    continue
                if paths and size + len(text) > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], ["path", "text"])
                    paths, texts, size = [], [], 0
                paths.append(_uri(at))
                texts.append(text)
                size += len(text) + len(at)
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], ["path", "text"])

    entries = [(name,) for name in sorted(os.listdir(folder)) if not _hidden(name)]
    dealt = spark.createDataFrame(entries, "entry string").repartition(_tasks(spark))
    return dealt.mapInArrow(read, "path string, text binary").select("path", F.col("text").cast("string").alias("text"))


def local_folder(path: str) -> str | None:
    """The folder that a ``file:`` path names (Hadoop's paths are not percent-encoded), None in any other store."""
    m = re.match(r"file:(?://)?(/[^/].*)$", path, re.DOTALL)
    return m and m[1]


def _escaped(name: str) -> str:
    return ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name)


def write_texts(df: DataFrame, path: str, partition_by: list[str], text_col: str = "text") -> None:
    """One text per partition directory (e.g. model=<m>/attack=<a>/part-*.txt).

    The work is a file a text, not bytes, so the number of tasks is given: left open, the small texts would be
    merged into a few tasks. If the first column has values enough, each of its folders is one task's, and is
    committed by one rename instead of one for each file.

    In a ``file:`` folder, Hadoop's client starts a process (chmod) for every file, checksum file and folder
    it makes, which takes nearly all the time: there the tasks write the same files themselves."""
    spark = df.sparkSession
    tasks = _tasks(spark)
    many = len(partition_by) > 1 and df.select(partition_by[0]).distinct().limit(tasks).count() == tasks
    rows = df.select(F.col(text_col).alias("value"), *partition_by).repartition(tasks, *(partition_by[:1] if many else partition_by))
    folder = local_folder(path)
    if folder is None:
        rows.write.mode("overwrite").partitionBy(*partition_by).text(path)
    else:
        _write_local(rows, folder, partition_by)


def _write_local(rows: DataFrame, folder: str, partition_by: list[str]) -> None:
    """What Spark's text writer leaves in ``folder``, without checksum files. Tasks write below ``_temporary``, each
    file under a name of its attempt until it is whole; the driver commits the folders of the first column."""
    staged, job = f"{folder}/_temporary/{uuid.uuid4()}", str(uuid.uuid4())
    shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(staged)
    names = [_escaped(c) for c in partition_by]

    def write(batches):
        at = TaskContext.get()
        file = f"part-{at.partitionId():05d}-{job}.c000.txt"
        key, out, n = None, None, 0

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), file))
        for b in batches:
            values = [b.column(f"_{i}").to_pylist() for i in range(len(names))]
            for text, *now in zip(b.column("value").to_pylist(), *values, strict=True):
                if out is None or now != key:
                    close()
                    where = os.path.join(staged, *(f"{c}={NO_VALUE if v is None else _escaped(v)}" for c, v in zip(names, now, strict=True)))
                    os.makedirs(where, exist_ok=True)
                    key, out = now, open(os.path.join(where, f".{at.taskAttemptId()}.{file}"), "wb")
                out.write((text or b"") + b"\n")
                n += 1
        close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    def value(c):
        return F.nullif(F.col(c).cast("string"), F.lit(""))
    parts = [f"_{i}" for i in range(len(names))]
    done = rows.select(F.col("value").cast("binary").alias("value"), *[value(c).alias(p) for c, p in zip(partition_by, parts, strict=True)]) \
        .sortWithinPartitions(*parts).mapInArrow(write, "n long")
    done.agg(F.sum("n")).collect()
    for name in os.listdir(staged):
        os.rename(f"{staged}/{name}", f"{folder}/{name}")
    shutil.rmtree(f"{folder}/_temporary")
    open(f"{folder}/_SUCCESS", "w").close()
