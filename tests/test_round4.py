"""The whole job at size: what models are fitted to, files of texts, positions without copies, neighbours of many rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import knn
from flowsieve.operators import models as ML
from flowsieve.operators import sampling as S
from flowsieve.sources import flows as FS
from flowsieve.sources import records, texts


def _prepared(spark, n):
    from flowsieve.plans.q_models import PREP_FEATURES
    rows = [(f"f{i}", 3 * (i % 2), *(float((i * (7 + j)) % 11 + 5 * (i % 2)) for j in range(len(PREP_FEATURES)))) for i in range(n)]
    return spark.createDataFrame(rows, "flow_id string, y int, " + ", ".join(f"`{c}` double" for c in PREP_FEATURES))


def test_network_is_fitted_to_all_training_rows(spark, monkeypatch):
    from flowsieve.plans import q_models as Q
    df, seen, fit = _prepared(spark, 400), [], ML.fit_pipeline
    monkeypatch.setattr(Q, "MAX_TRAIN_ROWS", 20)
    monkeypatch.setattr(Q, "prepared_flows", lambda *a: df)
    monkeypatch.setattr(ML, "fit_pipeline", lambda train, *a, **k: seen.append(train.count()) or fit(train, *a, **k))
    out = Q.q_mlp_classify(spark, "")
    train, test = Q.split_two(df, "flow_id", 25)
    assert seen == [train.count()] and seen[0] > 20
    assert {r.flow_id for r in out.collect()} == {r.flow_id for r in test.collect()}


def _tree(folder):
    out = {}
    for at, _, names in os.walk(folder):
        for n in (n for n in names if n.startswith("part-")):
            out.setdefault(os.path.relpath(at, folder), []).append(open(f"{at}/{n}", "rb").read())
    return {k: sorted(v) for k, v in out.items()}


def test_text_folders_are_those_of_sparks_writer(spark, tmp_path):
    """Escaped, missing and repeated values, several lines in a file; and nothing but a file a text."""
    odd = ["a b", "x/y=1%", "é:ü", "", None, "[q]*?", "t\tb", "plain", "{c}", "c}"]
    rows = [(f"t{i % 7}\nß" if i % 5 else None, i % 4 or None, odd[i % len(odd)], i % 3 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "text string, run int, `the model` string, ok boolean")
    df.select(F.col("text").alias("value"), "run", "the model", "ok").repartition(1).write.partitionBy("run", "the model", "ok").text(str(tmp_path / "spark"))
    texts.write_texts(df, f"file:{tmp_path}/own", ["run", "the model", "ok"])
    ordered = lambda tree: {k: sorted(b"".join(v).split(b"\n")) for k, v in tree.items()}
    assert ordered(_tree(tmp_path / "own")) == ordered(_tree(tmp_path / "spark"))
    every = [n for _, _, names in os.walk(tmp_path / "own") for n in names]
    assert "_SUCCESS" in every and all(n.startswith("part-") for n in every if n != "_SUCCESS")
    assert sorted(os.listdir(tmp_path / "own")) == ["_SUCCESS", "run=1", "run=2", "run=3", "run=__HIVE_DEFAULT_PARTITION__"]
    texts.write_texts(df.limit(0), f"file://{tmp_path}/own", ["run", "the model", "ok"])  # writes over it
    assert os.listdir(tmp_path / "own") == ["_SUCCESS"] and texts.read_whole_texts(spark, f"file:{tmp_path}/own").count() == 0


def test_local_texts_are_read_as_spark_reads_them(spark, tmp_path):
    top = tmp_path / "a b%20ü"
    for name, content in {"run=1/é x/one.txt": "ß\n".encode(), "run=1/two.txt": b"", "run=1/.three.txt": b"hidden", "_no/four.txt": b"hidden", "_k=1/five.txt": b"5",
                          "six.txt": b"\xff\xfe bad", "seven.csv": b"other", "run=2/a#b?c;d&e'f~(g)+h,i@j!$k.txt": b"8", "run=2/nine.txt._COPYING_": b"hidden"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    own = texts.read_whole_texts(spark, f"file:{top}")
    plain = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(f"file:{top}", wholetext=True)
    plain = plain.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    shown = lambda d: sorted(d.select("path", F.hex(F.col("text").cast("binary")).alias("t")).collect())
    assert shown(own) == shown(plain) and len(shown(own)) == 4
    assert own.dtypes == plain.dtypes


def test_whole_texts_are_listed_by_tasks(spark, tmp_path):
    """The driver keeps no file list, and the scan is not a task for every 32 files."""
    rows = [(f"t{i}", i, m) for i in range(400) for m in "ab"]
    texts.write_texts(spark.createDataFrame(rows, "text string, run int, model string"), f"file:{tmp_path}/o", ["run", "model"])
    back = texts.read_whole_texts(spark, f"file:{tmp_path}/o")
    assert back.inputFiles() == [] and back.count() == 800
    assert texts.read_whole_texts(spark, str(tmp_path / "o")).rdd.getNumPartitions() <= texts._tasks(spark)
    assert {(r.text, r.path.split("/")[-3]) for r in back.collect()} == {(f"{t}\n", f"run={i}") for t, i, _ in rows}


def _numbered_files(tmp_path):
    for k in range(3):
        (tmp_path / f"a.csv/part-{k:05d}-x.csv").parent.mkdir(exist_ok=True)
        (tmp_path / f"a.csv/part-{k:05d}-x.csv").write_text("Flow ID,Label\n" + "".join(f"f{1000 * k + i},x\n" + "\n" * (i % 3 == 0) for i in range(700)))


def test_positions_need_no_copy_of_the_files(spark, tmp_path, monkeypatch):
    _numbered_files(tmp_path)
    kept = []
    monkeypatch.setattr(records, "scratch_path", lambda s, name, own=records.scratch_path: kept.append(own(s, name)) or kept[-1])
    monkeypatch.setattr(FS, "stored", lambda df, name: records.stored(df, name))
    df = FS.read_flow_csv(spark, str(tmp_path), positions=True)
    got = {r["Flow ID"]: r.position for r in df.select("Flow ID", "position").collect()}
    assert got == {f"f{1000 * k + i}": 700 * k + i for k in range(3) for i in range(700)}
    assert [os.path.basename(p).rsplit("-", 1)[0] for p in kept] == ["csv-positions"]


def test_rows_numbered_otherwise_are_an_error(spark, tmp_path):
    """The second pass has to see the numbers of the first, or none are given."""
    _numbered_files(tmp_path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 26))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 27))
        df = FS.read_flow_csv(spark, str(tmp_path), positions=True).select("Flow ID", "Label", "position")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 30))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        with pytest.raises(Exception, match="read the files again|read them again"):
            df.collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_many_small_groups_are_ranked_without_a_shuffle_of_all_rows(spark):
    """The same rows however it is done; the histogram has fewer rows than the data, the boundaries are broadcast."""
    df = spark.range(0, 6000, 1, 4).select(F.concat(F.lit("g"), (F.col("id") / 300).cast("int").cast("string")).alias("g"), F.col("id").cast("string").alias("k"))
    df = df.where("id < 5710").unionByName(df.limit(40))  # a small group, repeated keys
    df = df.withColumn("g", F.when(F.col("g") != "g3", F.col("g")))  # and a null one
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for boundaries above it
        few = S.sample_exact_per_group(df, "g", "k", 1 / 30, levels=26, many_groups=True)
        assert sorted(map(str, few.collect())) == sorted(map(str, S.sample_exact_per_group(df, "g", "k", 1 / 30).collect()))
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffles_of_the_ordered_files_are_freed(spark, monkeypatch):
    from flowsieve.plans import q_io as Q
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    monkeypatch.setattr(Q, "flows", lambda *a: spark.createDataFrame([("f1", "x", "a.csv"), ("f2", "y", "a.csv")], "`Flow ID` string, Label string, source_file string"))
    write, before = FS.write_flow_csv, spark.conf.get(name)
    monkeypatch.setattr(FS, "write_flow_csv", lambda *a, **k: seen.append(spark.conf.get(name)) or write(*a, **k))
    assert FS.read_flow_csv(spark, Q._ordered_csv(spark, "", "Label"), positions=True).count() == 2
    assert seen == ["true"] and spark.conf.get(name) == before


@pytest.mark.parametrize("dims, k, kind", [(3, 5, "spread"), (9, 7, "whole numbers"), (1, 4, "whole numbers"), (2, 600, "spread"), (4, 3, "copies"), (5, 7, "offset")])
def test_leaves_hold_every_neighbour(dims, k, kind):
    rng = np.random.default_rng(dims)
    t = rng.normal(size=(2000, dims)) if kind != "whole numbers" else rng.integers(0, 4, (2000, dims)).astype(float)
    t[:1500 if kind == "copies" else 0] = 1.5
    t += 1e8 if kind == "offset" else 0.0
    q, ids = np.concatenate([t[:40], t[-40:] + rng.normal(size=(40, dims))]), rng.permutation(len(t))
    far = np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2))
    best = [np.lexsort((ids, d))[:k] for d in far]
    for theta in (np.full(len(q), np.nan), np.where(np.arange(len(q)) % 2, np.nan, far[np.arange(len(q)), [b[-1] for b in best]])):
        qi, ti, d = knn.Leaves(t, ids, 64).top(q, k, theta)
        assert [ti[qi == i].tolist() for i in range(len(q))] == [b.tolist() for b in best]
        assert np.array_equal(d, far[qi, ti])


def test_few_dimensions_need_few_pivots_and_distances(spark, monkeypatch):
    """Pivots grow slower than rows in few dimensions, and a block is not compared row by row."""
    rng = np.random.default_rng(2)
    looked, plain = [], knn._approximate
    monkeypatch.setattr(knn, "_approximate", lambda q, t: looked.append(len(q) * len(t)) or plain(q, t))
    t, q = rng.normal(size=(20_000, 3)), rng.normal(size=(500, 3))
    knn.Leaves(t, np.arange(len(t))).top(q, 5, np.full(len(q), np.nan))
    assert sum(looked) < len(q) * len(t) / 5
    cells, made = [], knn.Cells
    monkeypatch.setattr(knn, "CELL_ROWS", 50)
    monkeypatch.setattr(knn, "Cells", lambda pivots: cells.append(len(pivots)) or made(pivots))
    monkeypatch.setattr(knn, "LEAF_ROWS", 64)
    rows = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(t.tolist())], "id long, label int, v array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(q[:40].tolist())], "id long, v array<double>")
    got = {}
    for r in knn.knn_neighbors(asked, rows, 5, "id", "v", "label").collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.tid
    far = ((q[:40, None] - t[None]) ** 2).sum(axis=2)
    assert {i: [v[j + 1] for j in range(5)] for i, v in got.items()} == {i: np.argsort(d)[:5].tolist() for i, d in enumerate(far)}
    assert cells == [-(-20_000 // 800)]
