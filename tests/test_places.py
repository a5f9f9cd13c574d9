"""Range joins shuffle both sides, whatever Spark estimates of them, and compare sites at one place once."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from facetry.operators import sites as s
from facetry.plans.registry import QUERIES

CELL = (3.0, 0.0, 0.0, 2.0, 8.0, 0.0, 0.0, 0.0, 9.0)


def joined_by_cells(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_g0" in line]


def periodic(spark, n):
    site = spark.range(0, n, 1, 1).select(F.lit("a").alias("material"), F.col("id").alias("site"), F.array(F.col("id") % 7 / 7, F.col("id") % 3 / 4, F.lit(0.25)).alias("frac"))
    return site, spark.createDataFrame([("a", list(CELL))], "material string, cell array<double>")


def test_no_side_of_a_range_join_is_broadcast(spark):
    points = spark.range(0, 100, 1, 1).select(F.lit("a").alias("m"), F.col("id").alias("site"), F.col("id").cast("double").alias("x"))
    for got in (s.range_join(points, 2.0, ["m"], "site", ("x",)), s.periodic_range_join(*periodic(spark, 50), 4.0)):
        assert [line for line in joined_by_cells(got) if "SortMergeJoin" in line] == joined_by_cells(got) != []


@pytest.mark.parametrize("block", [8192, 8])
def test_sites_at_one_place_keep_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK", block, raising=False)
    monkeypatch.setattr(s, "LIST", 4, raising=False)
    rows = [("a" if i % 5 else "b", i, float(i % 4), float(i % 3) if i % 41 else None) for i in range(120)] + [("a", None, 1.0, 1.0), ("a", 7, 9.0, 9.0)]
    points = spark.createDataFrame(rows, "m string, site int, x double, y double")
    got = sorted(tuple(r) for r in s.range_join(points, 1.5, ["m"], "site", ("x", "y")).collect())
    want = [(a[0], a[1], b[1], math.hypot(a[2] - b[2], a[3] - b[3])) for a, b in itertools.product([r for r in rows if None not in r], repeat=2) if a[0] == b[0] and a[1] != b[1]]
    assert got == sorted(r for r in want if r[3] <= 1.5) and len(got) > 3000


@pytest.mark.parametrize("block", [8192, 8])
def test_periodic_sites_at_one_place_keep_every_image(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK", block, raising=False)
    monkeypatch.setattr(s, "LIST", 2, raising=False)
    site, cells = periodic(spark, 50)
    got = sorted((r["center"], r["nbr"], *r["image"], round(r["distance"], 9)) for r in s.periodic_range_join(site, cells, 4.0003).collect())
    f, want = {r["site"]: r["frac"] for r in site.collect()}, []
    for a, b, i, j, k in itertools.product(f, f, range(-3, 4), range(-2, 3), range(-2, 3)):
        d = [f[b][0] + i - f[a][0], f[b][1] + j - f[a][1], f[b][2] + k - f[a][2]]
        at = math.sqrt((3 * d[0] + 2 * d[1]) ** 2 + (8 * d[1]) ** 2 + (9 * d[2]) ** 2)
        if at <= 4.0003 and (a, b, i, j, k) != (a, a, 0, 0, 0):
            want.append((a, b, i, j, k, round(at, 9)))
    assert got == sorted(want) and len(got) > 2000


@pytest.mark.parametrize("name", ["j8_range_join", "j8_periodic_range_join"])
def test_distances_of_pairs_are_rounded_without_decimals(spark, name):
    """``round`` makes a decimal number of every pair."""
    assert " round(" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().replace("(round(", " round(")
