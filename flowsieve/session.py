"""Session construction and the shared scratch location.

Scratch data (round-trip files, checkpoints) always lives under the folder the
cluster names in ``spark.checkpoint.dir``.  Only when that setting is absent (local
tests) do we create one ourselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.parquet.filterPushdown": "true",
    # Flow tables are wide; a whole-stage method above the JVM's 8000-byte JIT limit runs
    # interpreted (5x slower here). Fall back to per-operator codegen instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Session-level SQL settings that are safe to apply to a session someone else built.
RUNTIME_SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows that go to Python hold whole texts or packed blocks: batches end by bytes, not by 10,000 rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def apply_runtime_conf(spark: SparkSession) -> None:
    """Defaults for settings that whoever built the session left open; what they set stays."""
    given = spark.sparkContext.getConf()
    for k, v in RUNTIME_SQL_CONF.items():
        if not given.contains(k):
            spark.conf.set(k, v)


def get_spark(master: str | None = None, app: str = "flowsieve",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every flowsieve job assumes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if none is configured."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        # Unset: a test or a local run. On a cluster a machine-local folder would lose data.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="flowsieve-ckpt-", dir=os.environ.get("FLOWSIEVE_TMP", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes in this block give the disk of their shuffles back when they end, not when the driver's garbage
    collector next finds them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once a context): they may run in another folder
    or on another machine than the driver. Spark's own file distribution carries the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_flowsieve_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="flowsieve-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "flowsieve.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._flowsieve_shipped = True
