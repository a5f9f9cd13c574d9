"""Paths that carry their values equal paths whose values are joined afterwards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import paths as pa
from facetry.plans.registry import QUERIES


@pytest.mark.parametrize("length", [2, 3, 4])
def test_walked_paths_carry_what_joins_bring(spark, length):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 1), (2, 4), (4, 5), (2, 2), (9, 1)]
    e = spark.createDataFrame([("m", u, v, [float(u), float(v)], [float(i % 2)]) for i, (u, v) in enumerate(pairs)], "material string, u int, v int, step array<double>, image array<double>")
    n = spark.createDataFrame([("m", i, float(i * i), None if i == 5 else -1.0 * i) for i in (1, 2, 3, 4, 5)] + [("other", 9, 1.0, 1.0)], "material string, node int, x double, y double")
    paths = pa.simple_paths(e, ["material"], length)
    want = pa.path_values(paths, n, ["material"], ["x", "y"]).join(pa.path_steps(paths, e, ["material"], ["step", "image"]), ["material", "path"])
    got = pa.walked(e, n, ["material"], length, ["x", "y"], ["step", "image"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 3
    assert sorted(map(str, pa.walked(e, n, ["material"], length, ["x"]).collect())) == sorted(map(str, want.select("material", "path", "x").collect()))


def test_values_of_paths_are_not_collected_again(spark):
    for name in ("b12_path_features", "b12_b13_path_statistics"):
        assert "collect_list" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_longer_arrays_keep_their_entropy_and_autocorrelation(spark):
    x = [1.0, 4.0, 4.1, 9.0, 2.0, 9.0]
    row = spark.createDataFrame([(x, [3.0] * 4, [1.0])], "x array<double>, c array<double>, o array<double>").select(
        pa.path_entropy(F.col("x")), pa.path_autocorrelation(F.col("x")), pa.path_entropy(F.col("c")), pa.path_autocorrelation(F.col("c")), pa.path_autocorrelation(F.col("o"))).first()
    p = np.array([1, 1, 2, 2]) / 6  # bins 0, 1, 3 and 9
    assert math.isclose(row[0], -(p * np.log2(p)).sum()) and math.isclose(row[1], np.corrcoef(x[:-1], x[1:])[0, 1]) and tuple(row[2:]) == (0.0, None, None)
