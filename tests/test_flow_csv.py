"""Flow CSVs joined by column name: order and set differ, headers repeat, files may be empty."""

import random

import pytest
from pyspark.sql import functions as F

from flowsieve.schema import ATTACK_MAPPING_V1
from flowsieve.sources import flows as FS
from flowsieve.sources import records as FR
from flowsieve.streaming import flows as SF


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "Syn.csv").write_text(" Packets, Bytes, Label, SimillarHTTP\n1,10,Syn,0\n2,20,Syn,\"a\nb\"\n")
    (d / "TFTP.csv").write_text("Bytes,Packets,Label\n30,3,TFTP\n")
    (d / "UDPLag.csv").write_text("Packets,Label, Packets,Note\n4,UDP-lag,44,x\n")
    (d / "WebDDoS.csv").write_text("Packets,Bytes,Label\n5,50,WebDDoS\n")
    (d / "Empty.csv").write_text("Packets,Bytes,Label\n")
    (d / "Nothing.csv").write_text("")
    return str(d)


def test_columns_are_matched_by_name(spark, folder):
    df = FS.read_flow_csv(spark, folder, multiline=True)
    got = sorted((r.Packets, r.Bytes, r.Label, r["Packets.1"], r.Note) for r in df.collect())
    assert got == [(1.0, 10.0, "Syn", None, None), (2.0, 20.0, "Syn", None, None), (3.0, 30.0, "TFTP", None, None),
                   (4.0, None, "UDP-lag", "44", "x"), (5.0, 50.0, "WebDDoS", None, None)]
    assert {r.file: r.rows for r in FS.rows_per_file(df).collect()} == {"Syn": 2, "TFTP": 1, "UDPLag": 1, "WebDDoS": 1}


def test_undeclared_columns_stay_text_or_are_checked(spark, folder):
    df = FS.read_flow_csv(spark, folder, undeclared="numeric", multiline=True)
    assert dict(df.dtypes)["Packets.1"] == "double" and dict(df.dtypes)["Note"] == "string"


def test_label_from_filename_reports_skipped_files(spark, folder):
    kept, skipped = FS.label_from_filename(FS.read_flow_csv(spark, folder, multiline=True), ATTACK_MAPPING_V1)
    assert sorted(r.file_label for r in kept.collect()) == [8, 8, 9, 10]
    assert [tuple(r) for r in skipped.collect()] == [("WebDDoS", 1)]


def test_label_aliases(spark, folder):
    from flowsieve.functions.labels import map_label
    df = FS.read_flow_csv(spark, folder, multiline=True)
    assert [r.y for r in df.where("Label = 'UDP-lag'").select(map_label("Label").alias("y")).collect()] == [10]


def test_stream_matches_by_name(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("Packets,Bytes,Label\n1,10,Syn\n")
    (src / "b.csv").write_text("Bytes,Label,Packets\n20,TFTP,2\n")
    out = SF.stream_flow_csv_to_parquet(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), ["Packets", "Bytes", "Label"])
    assert sorted(tuple(r) for r in SF.read_output(spark, out).collect()) == [(1.0, 10.0, "Syn"), (2.0, 20.0, "TFTP")]


def test_stream_takes_other_orders_new_headers_and_late_files(spark, tmp_path):
    """Files of one header, then another order in the same run's checkpoint, then a header never seen, then a
    file that lands while a micro-batch runs: every value stays in its column and no file is lost."""
    src, out, ck = tmp_path / "in [1]", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    glob = str(src).replace("[", "\\[").replace("]", "\\]")
    columns = ["Packets", "Bytes", "Label", "Note"]

    def run(transform=lambda df: df.select(*columns)):
        SF.run_to_parquet(spark, glob, transform, out, ck, columns, max_files_per_trigger=1)
        return sorted(tuple(r) for r in SF.read_output(spark, out).collect())

    (src / "f1.csv").write_text("Packets,Bytes,Label\n1,100,Syn\n")
    assert run() == [(1.0, 100.0, "Syn", None)]
    (src / "f2.csv").write_text("Bytes,Packets,Label\n200,2,Syn\n")
    assert run()[1:] == [(2.0, 200.0, "Syn", None)]
    (src / "f3.csv").write_text("Note,Label, Packets\nhello,TFTP,3\n")

    def late(df):
        if not (src / "f4.csv").exists():
            (src / "f4.csv").write_text("Label,Bytes,Packets\nTFTP,400,4\n")
        return df.select(*columns)
    run(late)
    assert run()[2:] == [(3.0, None, "TFTP", "hello"), (4.0, 400.0, "TFTP", None)]
    assert len(run()) == 4


def test_stream_repeats_a_failed_micro_batch(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.csv").write_text("Packets,Label\n1,Syn\n2,Syn\n")
    failed = []

    def once(df):
        df.write.mode("overwrite").parquet(f"{out}/batch=0")  # written, and then the run dies
        failed.append(1)
        raise RuntimeError("lost")
    with pytest.raises(Exception, match="lost"):
        SF.run_to_parquet(spark, str(src), once, out, ck, ["Packets", "Label"])
    SF.run_to_parquet(spark, str(src), lambda df: df.select("Packets", "Label"), out, ck, ["Packets", "Label"])
    assert failed and sorted(tuple(r) for r in SF.read_output(spark, out).collect()) == [(1.0, "Syn"), (2.0, "Syn")]


def input_rows(df):
    """Rows that the scans of an executed plan put out."""
    def walk(p):
        own = 0
        if "Scan" in p.nodeName():
            m = p.metrics().get("numOutputRows")
            own = m.get().value() if m.isDefined() else 0
        if p.nodeName() == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        kids = [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        return own + sum(walk(k) for k in kids)
    return walk(df._jdf.queryExecution().executedPlan())


def test_headers_and_heads_read_no_more_than_they_need(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(0, 400_000, 1, 1).selectExpr("id AS Packets", "concat('x', id) AS Label").write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    files = FR.csv_files(spark, str(tmp_path))
    for n in (1, 700):
        frame, = FR.first_lines(spark, files, n)
        assert len(frame.collect()) == 2 * n and input_rows(frame) <= 2 * n + 2
    got = FS.head_rows(spark, str(tmp_path), 500).groupBy("file_path").agg(F.min("Packets").alias("lo"), F.max("Packets").alias("hi"), F.count("*").alias("n"))
    assert [(r.lo, r.hi, r.n) for r in got.collect()] == [(0.0, 499.0, 500)] * 2


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], "250")
    spark.conf.set(names[1], "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_records_of_split_files_equal_a_multiline_scan(spark, tmp_path, small_splits):
    """Quoted breaks over line, split and several splits' ends; blank lines inside and outside quotes; escaped
    and doubled quotes; a quote that never closes."""
    rng = random.Random(3)
    for f in range(4):
        rows = []
        for i in range(50):
            text = rng.choice(["", "plain", '"a, b"', '"two\nlines"', '"' + "long\n" * rng.randint(1, 90) + '"', '"a ""quoted"" word"', '"back \\" slash\n\nblank"', '"\n"'])
            rows.append(f"{i},{text},{f}" + rng.choice(["", "", "\n"]))
        (tmp_path / f"f{f}.csv").write_text("Packets,Note, Bytes\n" + "\n".join(rows) + "\n" + ('999,"open\nend' if f == 3 else ""))
    got = FS.read_flow_csv(spark, str(tmp_path), multiline=True)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    want = spark.read.schema("Packets double, Note string, Bytes double").option("header", True).option("multiLine", True).csv(str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "250")
    key = lambda r: (r[2] is None, r[2], r[0])
    rows = sorted((tuple(r) for r in got.select("Packets", "Note", "Bytes").collect()), key=key)
    assert rows == sorted((tuple(r) for r in want.collect()), key=key) and len(rows) == 201
    assert {r.file: r.rows for r in FS.count_per_file(spark, str(tmp_path)).collect()} == {"f0": 50, "f1": 50, "f2": 50, "f3": 51}


@pytest.mark.parametrize("multiline", [False, True])
def test_positions_follow_the_file(spark, tmp_path, small_splits, multiline):
    """Every row's place in its file, blank lines not counted, part files in the order of their numbers."""
    for name, n in (("a", 133), ("b", 1), ("c", 0)):
        (tmp_path / f"{name}.csv").write_text("Packets,Label\n" + "".join(f"{i},x\n" + "\n" * (i % 3 == 0) for i in range(n)))
    (tmp_path / "d.csv").mkdir()
    for part, (lo, hi) in {99999: (0, 40), 100000: (40, 41), 100001: (41, 90)}.items():
        (tmp_path / "d.csv" / f"part-{part}-x-c000.csv").write_text("Packets,Label\n" + "".join(f"{i},x\n" for i in range(lo, hi)))
    got = FS.with_chunks(FS.read_flow_csv(spark, str(tmp_path), multiline=multiline, positions=True), 50)
    rows = sorted((r.file, r.position, r.chunk_id, r.Packets) for r in got.withColumn("file", FS.file_stem()).collect())
    assert rows == [(f, i, i // 50, float(i)) for f, n in (("a", 133), ("b", 1), ("d", 90)) for i in range(n)]


def test_no_files(spark, tmp_path):
    with pytest.raises(Exception, match="no CSV files|PATH_NOT_FOUND|does not exist"):
        FS.read_flow_csv(spark, str(tmp_path / "none"))


def test_known_files_are_read_once_and_others_counted(spark, folder):
    kept, skipped = FS.read_labelled(spark, folder, ATTACK_MAPPING_V1, multiline=True)
    assert sorted(r.file_label for r in kept.collect()) == [8, 8, 9, 10]
    assert [tuple(r) for r in skipped.collect()] == [("WebDDoS", 1)]
    assert not any("WebDDoS" in f for f in kept.inputFiles())
    kept, skipped = FS.read_labelled(spark, folder, {"other": 1})
    assert kept.collect() == [] and skipped.count() == 4


def test_confusion_matrix_of_no_classes_is_refused(spark):
    from flowsieve.operators import metrics as M
    with pytest.raises(ValueError, match="more than"):
        M.confusion_matrix(spark.range(1500).selectExpr("cast(id as int) y", "cast(id as int) p"))


def test_other_splits_than_before_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n" + "1\n" * 50)
    text = FR.lines(spark, FR.csv_files(spark, str(tmp_path)))
    table = FR.split_table(text)
    assert FR.by_split(text, table, "opens").count() == 51
    with pytest.raises(Exception, match="other splits"):
        FR.by_split(text.withColumn("block", F.lit(7).cast("bigint")), table, "opens").collect()
