"""Operators against the hand-computed fixtures and brute-force references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import knn, metrics as M, reports as R, sampling as S, stats as ST
from flowsieve.operators.clean import row_index


@pytest.fixture(scope="module")
def pairs(spark):
    y = [0, 0, 1, 1, 2, 2]
    p = [0, 1, 1, 1, 2, 0]
    return spark.createDataFrame(list(zip(range(6), y, p)), "idx long, y int, p int")


def test_classification_report_fixture(pairs):
    rep = {r.label: r for r in M.classification_report(pairs).collect()}
    assert (rep["0"].precision, rep["0"].recall, rep["0"].f1_score, rep["0"].support) == (0.5, 0.5, 0.5, 2)
    assert (rep["1"].precision, rep["1"].recall, rep["1"].f1_score) == (0.666667, 1.0, 0.8)
    assert (rep["2"].precision, rep["2"].recall, rep["2"].f1_score) == (1.0, 0.5, 0.666667)
    assert rep["accuracy"].f1_score == 0.666667
    assert rep["macro avg"].f1_score == rep["weighted avg"].f1_score == 0.655556
    assert rep["weighted avg"].recall == rep["accuracy"].f1_score  # weighted recall = accuracy


def test_summary_and_mre(pairs):
    s = M.summary_metrics(pairs).first()
    assert (s.samples, s.accuracy, s.f1_weighted, s.mre, s.mra) == (6, 0.666667, 0.655556, 0.25, 0.75)
    cnt, first = M.misclassified(pairs, order_col="idx")
    assert cnt.first().n_errors == 2 and [r.idx for r in first.collect()] == [1, 5]


def test_confusion_matrix_sums_and_labels(spark, pairs):
    labels = spark.createDataFrame([(0,), (1,), (2,), (3,)], "c int")
    cm = M.confusion_matrix(pairs, labels=labels).collect()
    assert len(cm) == 16 and sum(r.n for r in cm) == 6
    rep = {r.label: r for r in M.classification_report(pairs, labels=labels).collect()}
    assert rep["3"].support == 0 and rep["3"].f1_score == 0.0


def test_one_class_truth(spark):
    # only class 0 in truth: MRE 0, MRA 1; F1 = 2a/(1+a) for accuracy a
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, 0)], "y int, p int")
    s = M.summary_metrics(df).first()
    a = 0.75
    assert s.mre == 0.0 and s.mra == 1.0 and abs(s.f1_weighted - round(2 * a / (1 + a), 6)) < 1e-9


def test_empty_input(spark):
    df = spark.createDataFrame([], "y int, p int")
    assert M.classification_report(df).count() == 0


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "x double, c double")
    m = ST.scaler_fit(df, ["x", "c"])
    assert m.means[0] == 4.0 and round(m.stds[0], 6) == 3.082207
    out = [tuple(round(v, 6) for v in r) for r in m.transform(df).collect()]
    assert [o[0] for o in out] == [-0.973329, -0.648886, 0.0, 1.622214] and all(o[1] == 0.0 for o in out)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3, "y int")
    w = {r.c: r.weight for r in S.class_weights(df, "y", [0, 1, 2]).collect()}
    assert w == {0: 0.5, 1: 1.0, 2: 0.0}


def test_sample_exact_per_group(spark):
    rows = [(f"f{g}", f"k{g}-{i}") for g, n in ((0, 10), (1, 90), (2, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k string")
    got = {r.g: r.n for r in S.sample_exact_per_group(df, "g", "k", 1 / 30).groupBy("g")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {"f0": 1, "f1": 3, "f2": 10}


def test_bounded_rank_filter_matches_full_rank(spark):
    # coarse histogram (levels=28 -> 16 buckets) so many rows share the boundary bucket
    rng = np.random.default_rng(7)
    rows = [(int(g), int(h), f"k{i}", 37 if g == 0 else 5) for i, (g, h) in
            enumerate(zip(rng.integers(0, 3, 2000), rng.integers(0, 2**32, 2000)))]
    df = spark.createDataFrame(rows, "g int, h long, k string, q long")
    got = sorted(r.k for r in S.bounded_rank_filter(df, "g", "h", "k", "q", levels=28).collect())
    exp = []
    for g in range(3):
        grp = sorted((h, k) for gg, h, k, q in rows if gg == g)
        exp += [k for _, k in grp[: (37 if g == 0 else 5)]]
    assert got == sorted(exp)


def test_splits_disjoint_and_complete(spark):
    df = spark.range(2000).withColumn("k", F.col("id").cast("string"))
    tr, va, te = S.split_three(df, F.col("k"))
    a, b, c = (set(r.id for r in x.collect()) for x in (tr, va, te))
    assert not (a & b or a & c or b & c) and len(a | b | c) == 2000
    assert 0.5 < len(a) / 2000 < 0.7 and 0.1 < len(b) / 2000 < 0.2


def test_row_index(spark):
    df = spark.range(500).withColumn("k", F.format_string("%05d", (F.col("id") * 7919) % 500)).repartition(5)
    out = sorted((r.idx, r.k) for r in row_index(df, ["k"]).collect())
    assert [i for i, _ in out] == list(range(500)) and [k for _, k in out] == sorted(k for _, k in out)


def test_row_index_of_wide_rows_written_out(spark, tmp_path):
    n = 300_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.md5(F.col("id").cast("string")).alias("a b"), F.rand(3).alias("r"))
    row_index(df, ["k"]).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == n and out.where("idx <> k").count() == 0
    same = row_index(spark.range(5000).select(F.lit(1).alias("k"), "id"), ["k"])  # one key only
    assert sorted(r.idx for r in same.collect()) == list(range(5000))
    assert row_index(df.limit(0), ["k"]).collect() == []


def test_knn_is_exact_with_equal_rows_and_large_offsets(spark):
    t = spark.createDataFrame([(i, [1.0, 2.0], i % 3) for i in range(400)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(1000, [1.0, 2.1])], "id long, v array<double>")
    nb = knn.knn_neighbors(q, t, 7, "id", "v", "label", block_rows=100)
    assert [r.tid for r in nb.orderBy("rank").collect()] == list(range(7))
    assert knn.knn_classify(q, t, 7, "id", "v", "label").first().prediction == 0
    t = spark.createDataFrame([(i, [3.2e9 + i, 1.0], 0) for i in range(400)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(0, [3.2e9 + 200.4, 1.0])], "id long, v array<double>")
    assert [r.tid for r in knn.knn_neighbors(q, t, 5, "id", "v", "label").orderBy("rank").collect()] == [200, 201, 199, 202, 198]


def test_shuffle_is_a_permutation_and_bernoulli_keeps_its_share(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    out = [r.k for r in S.shuffle_rows(df, F.col("k"), 4).collect()]
    assert out != [str(i) for i in range(20_000)] and sorted(map(int, out)) == list(range(20_000))
    assert out == [r.k for r in S.shuffle_rows(df.repartition(7), F.col("k"), 4).collect()]
    kept = S.sample_bernoulli(df, 0.1, seed=1)
    assert 1_800 < kept.count() < 2_200 and kept.exceptAll(df).count() == 0


def test_rechunk_writes_several_files_a_bucket(spark, tmp_path):
    from flowsieve.sinks import writers as W
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        W.rechunk(spark.range(20_000).select(F.col("id").cast("string").alias("k")), F.col("k"), str(tmp_path / "b"), 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "b").glob("bucket=*")]
    assert len(files) == 4 and min(files) >= 3


def test_exact_sample_of_a_null_group(spark):
    df = spark.range(600).select(F.when(F.col("id") % 2 == 0, F.lit("g")).alias("g"), "id")
    out = S.sample_exact_per_group(df, "g", "id", 1 / 30).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in out} == {"g": 10, None: 10}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(240, 8))
    lab = rng.integers(0, 4, 240)
    rows = [(i, X[i].tolist(), int(lab[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    q, t = df.where("id < 40"), df.where("id >= 40")
    got = {r.qid: r.prediction for r in knn.knn_classify(q, t, 5, "id", "v", "label", block_rows=70).collect()}
    for i in range(40):
        d = ((X[40:] - X[i]) ** 2).sum(1)
        order = np.lexsort((np.arange(40, 240), d))[:5]
        votes = np.bincount(lab[40:][order], minlength=4)
        assert got[i] == int(np.argmax(votes))  # argmax = smallest label among ties


def test_parse_result_text(spark):
    text = ("=== knn_model (DrDoS_LDAP) ===\nTổng mẫu: 2179930\nSố chunk: 22\nAccuracy TB: 19.26%\n"
            "F1 TB: 0.3229\nMRE TB: 1.4843\nMRA TB: -0.4843\nTổng thời gian: 305.56s\n")
    en = "Total samples: 1,234,567\nNumber of chunks: 3\nAccuracy: 80,5%\nF1: 0.5\nTotal time: 2s\n"
    df = spark.createDataFrame([("/r/knn_model_DrDoS_LDAP.txt", text), ("/r/svm-Syn.txt", en)], "path string, text string")
    rows = {r.model: r for r in R.parse_result_text(df, "text", "path").collect()}
    k = rows["knn_model"]
    assert (k.attack, k.attack_id, k.total_samples, k.num_chunks) == ("DrDoS_LDAP", 1, 2179930, 22)
    assert (k.accuracy_percent, k.f1, k.mre, k.mra, k.total_time_s) == (19.26, 0.3229, 1.4843, -0.4843, 305.56)
    s = rows["svm"]
    assert (s.attack, s.total_samples, s.num_chunks, s.accuracy_percent, s.total_time_s) == ("Syn", 1234567, 3, 80.5, 2.0)


def test_report_writer_reads_back_and_known_models(spark):
    row = spark.createDataFrame([("knn_model", "Syn", 2179930, 22, 19.26, 0.3229, 1.4843, -0.4843, 305.56)],
                                "model string, attack string, n long, c int, a double, f double, e double, r double, t double")
    numbers = [F.col(c) for c in ("n", "c", "a", "f", "e", "r", "t")]
    texts = row.select(F.lit("/r/x.txt").alias("path"), R.result_text("vi", F.col("model"), F.col("attack"), *numbers).alias("text"))
    texts = texts.unionByName(row.select(F.lit("/r/random_forest_model_Syn.txt").alias("path"),
                                         R.result_text("en", F.lit(None).cast("string"), F.col("attack"), *numbers).alias("text")))
    texts = texts.unionByName(spark.createDataFrame([("/r/svm_model_TFTP.txt", ""), ("/r/knn_model_TFTP.txt", "stray")], "path string, text string"))
    out = R.parse_result_text(texts, "text", "path", ["knn_model", "random_forest_model", "svm_model"])
    got = {r.path: r for r in out.collect()}
    for path, model in (("/r/x.txt", "knn_model"), ("/r/random_forest_model_Syn.txt", "random_forest_model")):
        r = got[path]
        assert (r.model, r.attack, r.attack_id, r.total_samples, r.num_chunks) == (model, "Syn", 8, 2179930, 22)
        assert (r.accuracy_percent, r.f1, r.mre, r.mra, r.total_time_s) == (19.26, 0.3229, 1.4843, -0.4843, 305.56)
    assert (got["/r/svm_model_TFTP.txt"].model, got["/r/svm_model_TFTP.txt"].attack) == ("svm_model", "TFTP")
    assert sorted(r.path for r in R.drop_rows_without_metrics(out).collect()) == ["/r/random_forest_model_Syn.txt", "/r/x.txt"]


def test_comparison_matrix_takes_its_columns_from_the_data(spark):
    df = spark.createDataFrame([("Syn", "a", 1.0), ("Syn", "a", 3.0), ("TFTP", "new", 5.0)], "attack string, model string, v double")
    got = {r.attack: (r.a, r.new) for r in ST.comparison_matrix(df, "attack", "model", "v").collect()}
    assert got == {"Syn": (2.0, 0.0), "TFTP": (0.0, 5.0)}


def test_diff_within_group(spark):
    chunks = [13, 16, 22, 27, 32, 41, 46, 51, 52, 202]
    df = spark.createDataFrame([("knn", f"f{c}", c) for c in chunks[::-1]], "model string, file string, n int")
    out = ST.diff_within_group(df, "model", ["n", "file"], "n", "d").orderBy("n").collect()
    assert [r.d for r in out] == [13, 3, 6, 5, 5, 9, 5, 5, 1, 150]


def _knn_by_hand(q, t, ids, k):
    out = []
    for x in q:
        d = np.sqrt(((t - x) ** 2).sum(axis=1))
        out.append([int(ids[i]) for i in np.lexsort((ids, d))[:k]])
    return out


@pytest.mark.parametrize("dims,k,cell", [(1, 3, 5), (2, 4, 16), (9, 7, 30), (40, 5, 25)])
def test_knn_pruning_keeps_every_neighbour(spark, dims, k, cell):
    """Clusters, a third of the rows equal, ties on a grid, far queries, blocks of a few rows."""
    rng = np.random.default_rng(dims)
    t = np.concatenate([rng.integers(0, 4, (150, dims)).astype(float), np.full((150, dims), 2.0), rng.normal(50, 0.01, (100, dims)), rng.normal(0, 30, (50, dims))])
    q = np.concatenate([t[::9], rng.integers(-1, 5, (30, dims)).astype(float), rng.normal(0, 200, (10, dims))])
    train = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(t)], "id long, v array<double>, label int").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, v array<double>").repartition(3)
    got = {}
    for r in knn.knn_neighbors(asked, train, k, "id", "v", "label", block_rows=cell).collect():
        got.setdefault(r.qid, {})[r.rank] = r.tid
    assert [[got[i][j + 1] for j in range(k)] for i in range(len(q))] == _knn_by_hand(q, t, np.arange(len(t)), k)


def test_knn_on_awkward_rows(spark):
    schema = "id long, v array<double>, label int"
    train = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 3), (4, [float("nan"), 0.0], 3), (5, [float("inf"), 0.0], 3), (6, [0.0], 3)], schema)
    q = spark.createDataFrame([(7, [0.1, 0.0], 0), (7, [0.1, 0.0], 0), (8, None, 0), (9, [1.0, None], 0)], schema)
    out = sorted((r.qid, r.rank, r.tid) for r in knn.knn_neighbors(q, train, 5, "id", "v", "label").collect())
    assert out == [(7, 1, 1), (7, 1, 1), (7, 2, 2), (7, 2, 2)]
    assert knn.knn_neighbors(q, train.limit(0), 5, "id", "v", "label").collect() == []


def test_knn_sends_queries_in_proportion_to_the_rows(spark, monkeypatch):
    """Twice the rows and queries: about twice the (query, block) visits, not four times."""
    visits = []
    routes = knn._routes

    def counted(queries, cells, dims, k, count=False):
        out = routes(queries, cells, dims, k, count)
        if count:
            visits.append(out.agg(F.sum("n")).first()[0] or 0)
        return out
    monkeypatch.setattr(knn, "_routes", counted)
    rng = np.random.default_rng(1)
    sums = []
    for n in (4000, 8000):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(n, 2)).tolist())], "id long, v array<double>").withColumn("label", F.lit(0))
        visits.clear()
        assert knn.knn_neighbors(rows.where("id % 4 = 0"), rows, 5, "id", "v", "label", block_rows=50).count() == 5 * n // 4
        sums.append(sum(visits))
    assert sums[0] < 4000 // 4 * 8 and sums[1] < 2.6 * sums[0]
