"""Scalar / array expressions against the hand-computed fixtures."""

import math

from pyspark.sql import functions as F

from flowsieve.functions import ipv4, labels, numbers, vectors


def _col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")


IPS = ["0.0.0.0", "1.2.3.4", "192.168.50.1", "255.255.255.255", "256.1.1.1", "", None, "123.9", "01.2.3.4",
       "1.2.3", "1.2.3.4.5", " 1.2.3.4", "+1.2.3.4"]


def test_ipv4_strict_and_safe(spark):
    df = _col(spark, IPS).select("i", ipv4.ipv4_to_int("v").alias("a"), ipv4.ipv4_to_int_null0("v").alias("b"),
                                 ipv4.ipv4_to_int_safe("v").alias("c")).orderBy("i")
    rows = df.collect()
    strict = [r.a for r in rows]
    assert strict == [0, 16909060, 3232248321, 4294967295, None, None, None, None, None, None, None, None, None]
    assert [r.b for r in rows][:8] == [0, 16909060, 3232248321, 4294967295, 0, 0, 0, 0]
    assert [r.c for r in rows][:8] == [0, 16909060, 3232248321, 4294967295, 0, 0, 0, 123]


INFER = [None, "", " benign ", "DrDoS_DNS", "syn", "drdos_ntp_x", "UDP-lag", "3", "3.7", "0", "-1", "99", "nan",
         "WebDDoS"]
INFER_OUT = [8, 8, 0, 1, 9, 5, 8, 3, 3, 0, 8, 8, 8, 8]


def test_infer_label(spark):
    df = _col(spark, INFER).select("i", labels.infer_label("v", 8).alias("o")).orderBy("i")
    assert [r.o for r in df.collect()] == INFER_OUT


def test_map_label_and_inverse(spark):
    df = _col(spark, ["DrDoS_DNS", "UDPLag", "BENIGN", None]).select(labels.map_label("v").alias("o"))
    assert [r.o for r in df.orderBy(F.monotonically_increasing_id()).collect()] == [0, 10, None, None]
    inv = spark.createDataFrame([(0,), (9,), (42,)], "c int").select(labels.map_label_inverse("c").alias("n"))
    assert sorted(r.n for r in inv.collect()) == ["42", "DrDoS_DNS", "TFTP"]


CLEAN = ["80.42%", "5071011", "1,234,567", "1,234.5", "5,071", "–0.48", "x", None]
CLEAN_OUT = [80.42, 5071011.0, 1234567.0, 1234.5, 5.071, -0.48, None, None]


def test_clean_number(spark):
    df = _col(spark, CLEAN).select("i", numbers.clean_number("v").alias("o")).orderBy("i")
    assert [r.o for r in df.collect()] == CLEAN_OUT


def test_inf_policies(spark):
    vals = [1.5, float("inf"), float("-inf"), float("nan"), None]
    df = _col(spark, vals, "double").select("i", numbers.inf_to_zero("v").alias("z"),
                                            numbers.inf_to_sentinel("v").alias("s")).orderBy("i")
    rows = df.collect()
    assert [r.z for r in rows] == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert [r.s for r in rows][:3] == [1.5, 1e10, -1e10] and math.isnan(rows[3].s) and rows[4].s is None


def test_vectors(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.0], [0.0, 3.0, 0.0], [0.3, 0.7])],
                               "a array<double>, b array<double>, two array<double>")
    r = df.select(vectors.weighted_vote_class("a", "b").alias("c"), vectors.weighted_vote("a", "b").alias("v"),
                  vectors.softmax("a").alias("sm"), vectors.topk_scores("two", 3).alias("top"),
                  vectors.argmax("a").alias("am"),
                  vectors.pad_to_square(F.array(*[F.lit(float(x)) for x in range(5)]), 5).alias("sq")).first()
    assert r.c == 1 and [round(x, 9) for x in r.v] == [1.2, 1.8, 0.0]
    assert abs(sum(r.sm) - 1.0) < 1e-12 and r.am == 0
    assert r.top == [0.7, 0.3, 0.0] and len(r.sq) == 9 and r.sq[5:] == [0.0] * 4


def test_split_stem_and_flags(spark):
    df = _col(spark, ["knn_model_DrDoS_LDAP", "svm-Syn", "plain"]).select(
        "i", numbers.split_stem("v").alias("p")).orderBy("i")
    assert [r.p for r in df.collect()] == [["knn", "model_DrDoS_LDAP"], ["svm", "Syn"], ["plain"]]
    fl = _col(spark, ["SYN", "SYN,ACK", "", None, "ACK"]).select("i", numbers.flag_contains("v").alias("f")).orderBy("i")
    assert [r.f for r in fl.collect()] == [1, 1, 0, 0, 0]
