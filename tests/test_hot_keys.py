"""Exact quantiles and long series: one key with very many rows takes another way and gives the same values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import quantiles as qs
from facetry.operators import scaling as sc
from facetry.operators import series as se

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def values():
    rng = random.Random(6)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(6000)] + [("ties", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(5000)]
    rows += [("tail", math.exp(rng.gauss(0, 60))) for _ in range(4000)] + [("same", 3.5)] * 3000 + [("half", float(i // 2000)) for i in range(4000)]
    return rows + [("few", 1.0), ("few", 2.0), ("few", None), ("none", None), (None, 4.0), (None, 5.0)] + [(None, float(i)) for i in range(900)]


def test_quantiles_of_hot_keys(spark):
    df = spark.createDataFrame(values(), "k string, x double").repartition(5)
    want = {}
    for k in {k for k, _ in values()}:
        x = [v for key, v in values() if key == k and v is not None]
        want[k] = np.percentile(x, [100 * p for p in PROBS]).tolist() if x else None
    for limit in (100_000, 150):
        got = {r["k"]: r["q"] for r in qs.quantiles(df, ["k"], "x", PROBS, limit=limit, accuracy=100).collect()}
        assert got.keys() == want.keys()
        for k, q in want.items():
            assert (q is None and (got[k] is None or set(got[k]) == {None})) or np.allclose(got[k], q, rtol=1e-9), (limit, k)


def test_quantiles_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "x double")
    for limit in (10, 10_000):
        assert qs.quantiles(df, [], "x", [0.25, 0.5], limit=limit).first()["q"] == [250.0, 500.0]
    assert qs.quantiles(df.limit(0), [], "x", [0.5]).count() == 0
    fitted = sc.fit(df, ["x"], "robust").first()
    assert (fitted["x_shift"], fitted["x_scale"]) == (500.0, 500.0)


@pytest.fixture(scope="module")
def long_series(spark):
    rng = random.Random(8)
    rows = [("long", t, rng.gauss(0, 1), rng.random()) for t in rng.sample(range(100_000), 700)] + [("short", t, float(t), 1.0) for t in range(5)] + [("one", 1, 2.0, 3.0)]
    return spark.createDataFrame([(k, float(t), x, y) for k, t, x, y in rows], "k string, t double, x double, y double").repartition(4).cache()


def test_long_series_equal_whole_ones(long_series):
    each = {
        "integral": lambda n: se.integral(long_series, ["k"], "t", "x", F.lit(60_000.0), rows=n), "value": lambda n: se.value_at(long_series, ["k"], "t", "x", F.lit(51_234.5), rows=n),
        "average": lambda n: se.moving_average(long_series, ["k"], "t", "x", 0.97, rows=n), "autocorrelation": lambda n: se.autocorrelation(long_series, ["k"], "t", "x", rows=n),
        "angle": lambda n: se.step_angles(long_series, ["k"], "t", ("x", "y"), rows=n).groupBy("k").agg(F.sum("angle").alias("angle")),
    }
    for name, make in each.items():
        whole, parts = ({r["k"]: r[name] for r in make(n).collect()} for n in (10**6, 40))
        assert whole.keys() == parts.keys()
        assert all((whole[k] is None and parts[k] is None) or math.isclose(whole[k], parts[k], rel_tol=1e-9, abs_tol=1e-12) for k in whole), name


def test_long_series_against_numpy(long_series):
    rows = sorted((r["t"], r["x"]) for r in long_series.where("k = 'long'").collect())
    t, x = map(np.array, zip(*rows))
    pick = lambda df: df.where("k = 'long'").first()[1]
    assert math.isclose(pick(se.value_at(long_series, ["k"], "t", "x", F.lit(51_234.5), rows=50)), np.interp(51_234.5, t, x))
    inside = t <= 60_000
    assert math.isclose(pick(se.integral(long_series, ["k"], "t", "x", F.lit(60_000.0), rows=50)), max(0.0, np.trapezoid(x[inside], t[inside])), rel_tol=1e-9)
    average = x[0]
    for v in x[1:]:
        average = 0.97 * average + 0.03 * v
    assert math.isclose(pick(se.moving_average(long_series, ["k"], "t", "x", 0.97, rows=50)), average, rel_tol=1e-9)
    assert math.isclose(pick(se.autocorrelation(long_series, ["k"], "t", "x", rows=50)), np.corrcoef(x[:-1], x[1:])[0, 1], rel_tol=1e-9)


def test_segments_of_a_long_series_are_even(long_series):
    seg, long = se.segmented(long_series, ["k"], "t", 40)
    counts = [r["count"] for r in seg.where("k = 'long'").groupBy("_seg").count().collect()]
    assert [r[0] for r in long.collect()] == ["long"] and len(counts) >= 15 and max(counts) <= 80 and sum(counts) == 700
    assert {r["_seg"] for r in seg.where("k <> 'long'").collect()} == {0}
