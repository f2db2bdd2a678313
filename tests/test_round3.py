"""Work that grew faster than the input, or was done more than once."""

import glob
import os
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowsieve.functions.vectors import softmax, topk_scores
from flowsieve.operators import knn
from flowsieve.operators.clean import row_index
from flowsieve.sources import flows as FS
from flowsieve.sources import records, texts


def _counted(df, seen):
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


def test_file_stem_is_linear_in_the_path(spark):
    paths = ["a/x.csv", "x.csv", "/d/k=Syn.csv/part-0.csv", "a=b=c.csv", "/x.csv=y.csv/z", "/.csv/q.csv", "/.csv.csv", "/x.csvy/z.csv", "none", "", "/a.b.csv/c",
             "file:/a b/é=ü.csv/p"]
    old = r"([^/=]+?)\.csv(?:/|$)"
    got = spark.createDataFrame([(p,) for p in paths], "file_path string").select("file_path", FS.file_stem().alias("s")).collect()
    assert {r.file_path: r.s for r in got} == {p: (m[1] if (m := re.search(old, p)) else "") for p in paths}
    t0 = time.time()
    long = spark.range(100).select(F.concat(F.repeat(F.lit("x"), F.lit(30_000)), F.lit("/"), F.col("id").cast("string"), F.lit(".csv")).alias("file_path"))
    assert long.select(FS.file_stem().alias("s")).distinct().count() == 100
    assert time.time() - t0 < 15


def test_joined_records_leave_in_few_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("h,v\n" + '1,"x\ny"\n' * 50)
    kind = type(spark.range(0))
    found, plain = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: found.append(f) or plain(self, f, *a, **k))
    whole = records.whole_records(records.lines(spark, [str(tmp_path / "a.csv")]))
    assert [r.value for r in whole.orderBy("at").collect()] == ["h,v"] + ['1,"x\ny"'] * 50
    n = 100
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(["f"] * n), pa.array([0] * n), pa.array([False] * n),
                                        pa.array(['1,"x', 'y"'] * (n // 2)), pa.array([1] * n, pa.int32())], ["key", "file", "block", "opens", "value", "q"])
    out = list(next(f for f in found if f.__name__ == "assemble")(iter([batch])))
    assert sum(b.num_rows for b in out) == 50 and len(out) <= 2


def test_texts_are_written_by_many_tasks(spark, tmp_path):
    rows = [(f"t{i}-{m}", i, m) for i in range(60) for m in "ab"]
    texts.write_texts(spark.createDataFrame(rows, "text string, run int, model string"), str(tmp_path / "o"), ["run", "model"])
    files = glob.glob(str(tmp_path / "o/*/*/part-*.txt"))
    assert {(open(f).read(), f.split("/")[-3], f.split("/")[-2]) for f in files} == {(f"{t}\n", f"run={r}", f"model={m}") for t, r, m in rows}
    tasks = {}
    for f in files:
        tasks.setdefault(f.split("/")[-3], set()).add(os.path.basename(f).split("-")[1])
    assert len(set().union(*tasks.values())) > 4 and {len(t) for t in tasks.values()} == {1}


def test_softmax_and_top_scores_are_computed_once_a_row(spark):
    x = np.random.default_rng(3).normal(size=(50, 300))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, a array<double>")
    t0 = time.time()
    got = np.array([r.t for r in df.select("id", topk_scores(softmax("a"), 3).alias("t")).orderBy("id").collect()])
    assert time.time() - t0 < 15
    e = np.exp(x - x.max(axis=1, keepdims=True))
    assert np.allclose(got, -np.sort(-e / e.sum(axis=1, keepdims=True), axis=1)[:, :3])
    odd = spark.createDataFrame([(None,), ([],), ([1.0, None],)], "a array<double>")
    assert [r.s for r in odd.select(softmax("a").alias("s")).collect()][:2] == [None, []]


def test_row_index_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)
    out = row_index(_counted(spark.range(0, 1000, 1, 4), seen), ["id"])
    assert out.where("id = idx").count() == 1000 and seen.value == 1000


def test_telemetry_state_has_two_partitions_a_core(spark, tmp_path):
    from flowsieve.streaming import running as SR
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts, 1L AS pps, 1 AS n, 1.0D AS cpu, 1.0D AS ram").write.parquet(str(tmp_path / "in"))
    stream = lambda s: spark.readStream.schema(s).parquet(str(tmp_path / "in"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        SR.telemetry_join_stream(stream("ts timestamp, pps long"), stream("ts timestamp, n int, cpu double, ram double"), str(tmp_path / "o"), str(tmp_path / "ck"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [p for p in os.listdir(tmp_path / "ck/state/0") if p.isdigit()]
    assert len(parts) == 2 * spark.sparkContext.defaultParallelism


def test_knn_routes_hold_little(monkeypatch):
    """Rows x cells looked at together are bounded, and rows x blocks too."""
    rng = np.random.default_rng(4)
    cells = knn.Cells(rng.normal(size=(2000, 16)))
    cells.fill({j: (9000, 9.0) for j in range(2000)}, 1000)
    x = rng.normal(size=(10_000, 16))
    assert max(j - i for i, j in cells.steps(len(x))) * cells.blocks.sum() <= knn.MATRIX_ELEMENTS
    tracemalloc.start()
    i, j = next(iter(cells.steps(len(x))))
    d = cells.distances(x[i:j])
    cells.reachable(x[i:j], d, cells.nearest(d), np.full(j - i, 9.0), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
