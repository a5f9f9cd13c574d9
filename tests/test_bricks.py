"""Sampling from bricks against NumPy, path features against NumPy, external tensors and images on small rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.functions import tensor as t
from facetry.operators import graphs as gr
from facetry.operators import grids as gd
from facetry.operators import paths as pa
from facetry.operators import scaling as sc
from facetry.operators import sites as s

SIZES = (9, 7, 5)


def trilinear(values, point):
    out, corner = 0.0, []
    for x, n in zip(point, SIZES):
        y = min(x - math.floor(x), (n - 1) / n - 1e-10) * n
        corner.append((math.floor(y), y - math.floor(y)))
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                w = np.prod([f if u else 1 - f for u, (_, f) in zip((a, b, c), corner)])
                v = values.get(tuple(i + u for u, (i, _) in zip((a, b, c), corner)))
                if v is None:
                    return None
                out += w * v
    return out


@pytest.mark.parametrize("edge", [2, 4, 16])
def test_samples_from_bricks(spark, edge):
    rng = np.random.default_rng(edge)
    cells = {(i, j, k): float(rng.normal()) for i in range(SIZES[0]) for j in range(SIZES[1]) for k in range(SIZES[2]) if (i, j, k) not in ((4, 3, 2), (0, 0, 0))}
    cells[8, 6, 4] = None
    grid = spark.createDataFrame([("m", *c, v, None if v is None else 2 * v) for c, v in cells.items()], "material string, i int, j int, k int, value double, other double")
    points = [("m", n, *map(float, rng.uniform(-1, 2, 3))) for n in range(300)] + [("m", 300, 0.999, 0.999, 0.999), ("other", 301, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(points, "material string, point int, x double, y double, z double")
    got = {r["point"]: (r["value"], r["other"]) for r in gd.sampled_values(df, grid, ["value", "other"], SIZES, ["material"], "point", edge=edge).collect()}
    assert len(got) == 302 and got[301] == (None, None)
    for _, n, *p in points[:-1]:
        want = trilinear(cells, p)
        assert (got[n] == (None, None)) if want is None else np.allclose(got[n], (want, 2 * want)), (n, p)
    assert sum(v[0] is None for v in got.values()) > 5
    full, holes = (gd.bricks(grid, SIZES, ["material"], ["value"], edge).where(f"places is {x}null").count() for x in ("", "not "))
    assert holes and (full or edge == 16)


def test_features_of_paths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=n).tolist(), rng.normal(size=n).tolist(), rng.normal(size=(n - 1, 3)).tolist(), rng.integers(-1, 2, (n - 1, 3)).astype(float).tolist(), rng.normal(size=(n, 3)).tolist()) for i, n in enumerate((2, 3, 5, 9))]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>, steps array<array<double>>, images array<array<double>>, forces array<array<double>>")
    cell = np.array([[4.0, 0, 0], [1, 5, 0], [0, 2, 6]])
    c = F.array(*[F.lit(float(v)) for v in cell.ravel()])
    got = df.select("id", pa.path_covariance(F.col("x"), F.col("y")).alias("cov"), pa.path_entropy(F.col("x"), 4).alias("entropy"), pa.path_curvature(F.col("steps")).alias("curvature"), pa.path_wrapping(F.col("images"), c).alias("wrapping"), pa.path_gradient(F.col("forces")).alias("gradient"), pa.path_autocorrelation(F.col("x")).alias("auto")).orderBy("id").collect()
    for r, (_, x, y, steps, images, forces) in zip(got, rows):
        x, y, steps, forces = map(np.array, (x, y, steps, forces))
        assert np.isclose(r["cov"], np.cov(x, y, bias=True)[0, 1])
        p = np.histogram(x, 4)[0] / len(x)
        assert np.isclose(r["entropy"], -sum(v * np.log2(v) for v in p if v))
        angles = [np.arccos(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) for a, b in zip(steps, steps[1:])]
        assert (r["curvature"] is None) if not angles else np.isclose(r["curvature"], np.mean(angles))
        assert np.isclose(r["wrapping"], np.linalg.norm(np.sum(images, 0) @ cell) / len(x))
        assert np.isclose(r["gradient"], np.mean((np.diff(forces, axis=0) ** 2).sum(1)))
        assert (r["auto"] is None) if len(x) < 3 else np.isclose(r["auto"], np.corrcoef(x[:-1], x[1:])[0, 1])


def test_steps_of_paths_turn_with_the_walk(spark):
    e = spark.createDataFrame([("m", 1, 2, [1.0, 0.0, 0.0]), ("m", 2, 3, [0.0, 1.0, 0.0])], "material string, u int, v int, step array<double>")
    p = spark.createDataFrame([("m", [3, 2, 1]), ("m", [1, 2, 3]), ("m", [1, 3])], "material string, path array<int>")
    got = {tuple(r["path"]): r["step"] for r in pa.path_steps(p, e, ["material"], ["step"]).collect()}
    assert got == {(3, 2, 1): [[0.0, -1.0, 0.0], [-1.0, 0.0, 0.0]], (1, 2, 3): [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]}


def test_external_tensors_fall_back_for_sites_only(spark):
    sites = spark.createDataFrame([(i, [float(v) for v in (a, 0, 0, 0, b, 0, 0, 0, c)]) for i, a, b, c in ((1, 4, 1, 1), (2, 1, 9, 1), (3, 1, 1, 7))], "site int, tensor array<double>")
    known = spark.createDataFrame([(1, [0.0, -2.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (3, None)], "site int, external array<double>")
    rows = {r["site"]: r for r in s.with_external(sites, known, ["site"]).withColumn("norm", t.lie_norm(F.col("algebra"))).collect()}
    assert rows[1]["from_external"] and np.isclose(rows[1]["norm"], math.sqrt(8))
    assert not rows[2]["from_external"] and np.isclose(rows[2]["norm"], math.sqrt(2)) and np.isclose(abs(rows[2]["algebra"][2]), 1)
    assert not rows[3]["from_external"] and np.isclose(abs(rows[3]["algebra"][1]), 1)
    bonds = spark.createDataFrame([(1, 2), (1, 1)], "u int, v int")
    got = {(r["u"], r["v"]): (r["external_u"] is None, r["external_v"] is None) for r in s.ends_with_external(bonds, known, [], ["u", "v"], "site").collect()}
    assert got == {(1, 2): (False, True), (1, 1): (False, False)}


def test_images_of_wedges_are_the_nearest(spark):
    e = spark.createDataFrame([("m", 1, 2, [1, 0, 0], 2.0), ("m", 1, 2, [0, 0, 0], 3.0), ("m", 2, 3, [0, 1, 0], 1.0)], "material string, u int, v int, image array<int>, distance double")
    c = spark.createDataFrame([("m", 1, 2, 3, 2)], "material string, i int, j int, k int, centre int")
    r = gr.wedge_images(c, e, ["material"]).first()
    assert (r["first"], r["second"], r["image_first"], r["image_second"]) == (1, 3, [-1, 0, 0], [0, 1, 0])


def test_jitter_makes_geometry_anew(spark):
    nodes = spark.createDataFrame([("m", 1, 0.0, 0.0, 0.0), ("m", 2, 1.0, 0.0, 0.0), ("m", 3, 0.0, 2.0, 0.0)], "material string, node int, x double, y double, z double")
    edges = spark.createDataFrame([("m", 1, 2), ("m", 1, 9)], "material string, u int, v int")
    triangles = spark.createDataFrame([("m", 1, 2, 3)], "material string, i int, j int, k int")
    n, e, f = sc.jittered(nodes, edges, triangles, ["material"], [F.col("node") * 0.1, F.lit(0.0), F.lit(0.5)])
    steps = {r["v"]: r["step"] for r in e.collect()}
    assert np.allclose(steps[2], [1.1, 0, 0]) and (steps[9] is None or None in steps[9]) and np.allclose(f.first()["normal"], [0, 0, 1])
    noise = [sc.jitter(k, 0.05, "node") for k in (1, 3, 5)]
    again = [sc.jittered(nodes, edges, triangles, ["material"], noise)[0].orderBy("node").collect() for _ in range(2)]
    assert again[0] == again[1] and max(abs(r["z"]) for r in again[0]) < 0.5 and n.count() == 3
