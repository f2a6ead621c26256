"""Exact statistics against plain Python, with the known values."""

import math

import pytest
from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.operators import labels


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (5, 0, 0.0625), (85, 11, 2.547339085237751e-15), (3, 3, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert value(spark, stats.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(p, rel=1e-9)


def test_wilson(spark):
    assert value(spark, stats.wilson(F.lit(94), F.lit(300))[0]) == pytest.approx(0.26348, abs=1e-5)
    assert value(spark, stats.wilson(F.lit(57), F.lit(300))[0]) == pytest.approx(0.1496, abs=1e-4)
    assert value(spark, stats.wilson(F.lit(0), F.lit(300))[1]) == pytest.approx(0.0126, abs=1e-4)
    assert value(spark, stats.zero_upper(F.lit(300))) == pytest.approx(0.0122, abs=1e-4)
    assert [value(spark, x) for x in stats.wilson(F.lit(0), F.lit(0))] == [0.0, 1.0]


def test_fisher(spark):
    k1, n1, k2, n2 = 7, 20, 1, 18
    h = lambda x: math.comb(n1, x) * math.comb(n2, k1 + k2 - x) / math.comb(n1 + n2, k1 + k2)
    want = sum(h(x) for x in range(0, 9) if h(x) <= h(k1) * (1 + 1e-9))
    assert value(spark, stats.fisher(F.lit(k1), F.lit(n1), F.lit(k2), F.lit(n2))) == pytest.approx(want, rel=1e-9)


def test_newcombe_and_agreement(spark):
    low, high = (value(spark, x) for x in stats.newcombe(F.lit(10), F.lit(81), F.lit(0), F.lit(209)))
    assert low < 0.27 < high
    assert [value(spark, x) for x in stats.newcombe(*[F.lit(0)] * 4)] == [0.0, 0.0]
    assert value(spark, stats.kappa(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 0.0
    assert value(spark, stats.gwet_ac1(F.lit(91), F.lit(95), F.lit(94), F.lit(100))) == pytest.approx(0.9, abs=0.02)


def test_labels(spark):
    rows = [("m", 1, "a", True, 1), ("m", 1, "a", False, 2), ("m", 1, "b", True, 1), ("m", 2, "a", True, 1), ("m", 2, "b", None, 1), ("m", 3, "a", True, 9)]
    df = spark.createDataFrame(rows, "model string, cluster int, condition string, absorbed boolean, seq int")
    latest = labels.latest(df, ["model", "cluster", "condition"], ["seq"])
    assert latest.count() == 5
    cells = labels.cells(latest.drop("seq"), "a", "b").first()
    assert (cells.e11, cells.e10, cells.e01, cells.e00) == (0, 0, 1, 0)
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "k string, p double").withColumn("f", F.lit(1))
    got = {r.k: round(r.p_holm, 6) for r in labels.holm(p, "p", ["f"], ["k"]).collect()}
    assert got == {"x": 0.03, "z": 0.06, "y": 0.06}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "model string, cluster int, condition string, absorbed boolean")
    assert labels.rates(df, ["model"]).count() == 0
    assert labels.contrast(labels.cells(df, "a", "b")).count() == 0
    assert labels.spearman(df.selectExpr("cluster as x", "cluster as y"), "x", "y").first().rho == 0.0


def test_large_counts_take_little_time(spark):
    import math
    import time

    def exact(b, c):
        return min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))

    pairs = [(0, 0), (1, 0), (5, 0), (85, 11), (30, 30), (500, 430), (1500, 1400)]
    df = spark.createDataFrame(pairs, "b long, c long").withColumn("p", stats.mcnemar(F.col("b"), F.col("c")))
    for r in df.collect():
        assert abs(r.p - exact(r.b, r.c)) <= 1e-9 * max(1e-3, exact(r.b, r.c))
    big = spark.createDataFrame([(500_000, 501_000)], "b long, c long")
    ask = lambda: big.select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()[0].p
    ask()
    began = time.time()
    p = ask()
    assert time.time() - began < 1 and abs(p - math.erfc(999 / math.sqrt(1_001_000) / math.sqrt(2))) < 1e-4


def test_fisher_equals_exact_sums(spark):
    import math

    def exact(k1, n1, k2, n2):
        k = k1 + k2
        p = lambda x: math.comb(n1, x) * math.comb(n2, k - x)
        return sum(p(x) for x in range(max(0, k - n2), min(n1, k) + 1) if p(x) * 10**9 <= p(k1) * (10**9 + 1)) / math.comb(n1 + n2, k)

    rows = [(3, 10, 7, 12), (0, 0, 0, 0), (0, 5, 0, 9), (5, 5, 0, 9), (40, 300, 80, 310), (1, 1000, 900, 1000), (500, 1000, 490, 1000)]
    df = spark.createDataFrame(rows, "k1 long, n1 long, k2 long, n2 long")
    for r in df.withColumn("p", stats.fisher(*[F.col(c) for c in df.columns])).collect():
        want = 1.0 if not r.n1 + r.n2 else exact(r.k1, r.n1, r.k2, r.n2)
        assert abs(r.p - want) <= 1e-9


def test_ranks_over_many_ranges(spark):
    rows = [(i % 7, (i * 37) % 100 / 10, i % 3 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, x double, y boolean").repartition(5)
    got = {r.g: r.auc for r in labels.auc(df, "x", "y", ["g"]).collect()}
    for g in range(7):
        pos = [x for k, x, y in rows if k == g and y]
        neg = [x for k, x, y in rows if k == g and not y]
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-12
    assert labels.spearman(df.withColumn("z", -F.col("x")), "x", "z").first().rho == -1.0
    assert labels.spearman(df.withColumn("z", F.lit(1)), "x", "z").first().rho == 0.0
    assert tuple(labels.spearman(df.limit(0), "x", "g").first()) == (0, 0.0)
