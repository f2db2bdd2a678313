"""Moments kept per file, and medians by refinement, against whole computations."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import medians as MD
from flowsieve.operators import moments as MO
from flowsieve.operators.clean import part_order


def test_moments_of_new_files_only(spark, tmp_path):
    rng = random.Random(2)
    src, store, all_rows = tmp_path / "in", str(tmp_path / "store"), {}
    src.mkdir()

    def write(name, n, base):
        rows = [(base + rng.gauss(0, 1), rng.choice([None, 5.0, 7.0])) for _ in range(n)]
        all_rows[name] = rows
        (src / name).write_text("Packets,Bytes\n" + "".join(f"{a!r},{'' if b is None else b}\n" for a, b in rows))

    def check(expected):
        read = MO.add_files(spark, str(src), store, ["Packets", "Bytes"])
        assert sorted(p.rsplit("/", 1)[1] for p in read) == expected
        m = MO.scaler_of(spark, store, ["Packets", "Bytes"])
        for i in (0, 1):
            x = [r[i] for rows in all_rows.values() for r in rows if r[i] is not None]
            assert m.means[i] == pytest.approx(statistics.fmean(x), rel=1e-9) and m.stds[i] == pytest.approx(statistics.pstdev(x), rel=1e-9)
    write("a.csv", 300, 1e6)  # a large offset: sums of squares alone would lose it
    write("b 1.csv", 1, 1e6 + 3)
    write("none.csv", 0, 0)
    check(["a.csv", "b 1.csv", "none.csv"])
    check([])
    write("c.csv", 500, 1e6 - 7)
    check(["c.csv"])
    write("a.csv", 200, 1e6 + 50)  # rewritten
    check(["a.csv"])


def test_medians_equal_sorting(spark):
    """A third of the rows in one group; ties, outliers, subnormals, infinities, NaN, nulls, one value, null keys."""
    rng = random.Random(7)
    groups = {("hot", 1): [rng.gauss(0, 1) * 10 ** rng.randint(-300, 300) for _ in range(1500)], ("ties", 1): [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(801)],
              ("one", 2): [4.25], ("two", None): [-1.0, 2.0], (None, None): [0.1, 0.2, 0.30000000000000004, None], ("none", 3): [None, None],
              ("inf", 1): [float("-inf"), 1.0, float("inf")], ("tiny", 1): [5e-324, 1e-323, 1.5e-323, -5e-324, 0.0], ("large", 1): [1.7e308, 1.6e308, -1.7e308, 1.75e308],
              ("even", 1): [rng.random() for _ in range(1000)], ("nan", 0): [1.0, float("nan"), 2.0]}
    rows = [(a, b, x) for (a, b), xs in groups.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(4).withColumn("y", F.lit(1.5))
    got = {(r.a, r.b): r.median for r in MD.exact_medians(df, ["a", "b"], ["x", "y"]).where(F.col("column") == "x").collect()}
    nan_last = lambda v: (math.isnan(v), v)
    for key, xs in groups.items():
        v = sorted((x for x in xs if x is not None), key=nan_last)
        if v:
            lo, hi = v[(len(v) - 1) // 2], v[len(v) // 2]
            assert got[key] == (lo / 2 + hi / 2 if math.isinf(lo + hi) else (lo + hi) / 2), key
    assert ("none", 3) not in got
    assert MD.exact_medians(df.limit(0), ["a"], ["x"]).collect() == []


def test_part_files_sort_by_number(spark):
    names = [f"part-{i:05d}-x-c000.snappy.parquet" for i in (99999, 100000, 7, 1000000)]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r.f[5:].split("-")[0] for r in df.orderBy(part_order("f")).collect()] == ["00007", "99999", "100000", "1000000"]
