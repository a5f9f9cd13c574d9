import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import tensor as t
from facetry.operators import evaluation as ev
from facetry.operators import graphs as gr
from facetry.operators import grids as gd
from facetry.operators import paths as pa
from facetry.operators import scaling
from facetry.operators import series as se
from facetry.operators import sites as s
from facetry.operators import triangles as tr
from facetry.operators.components import components


def bag(spark, vectors, key=1):
    return spark.createDataFrame([(key, "O", *map(float, v), float(np.linalg.norm(v))) for v in vectors], "center int, element string, x double, y double, z double, d double")


def test_octahedron(spark):
    n = bag(spark, [*np.eye(3), *-np.eye(3)])
    row = s.site_geometry(n, ["center"]).withColumn("an", t.anisotropy(F.col("tensor"))).first()
    assert np.allclose(np.array(row["tensor"]).reshape(3, 3), 2 * np.eye(3)) and row["asymmetry_norm_sq"] == 0
    assert row["distortion"] == 0 and abs(row["an"]) < 1e-9 and row["coordination"] == 6
    assert s.bag_entropy(n, ["center"], F.col("element"), F.col("d")).first()["entropy"] == 0
    row = tr.solid_angles(n, ["center"]).first()
    assert row["solid_angle"] > 4 * math.pi - 1e-9


def test_single_bond(spark):
    row = s.site_geometry(bag(spark, [(1, 2, 2)]), ["center"]).withColumn("e", t.eigenvalues(F.col("tensor"))).withColumn("an", t.anisotropy(F.col("tensor"))).first()
    assert np.allclose(row["e"], (9, 0, 0), atol=1e-6) and math.isclose(row["an"], 1, abs_tol=1e-9) and row["distortion"] == 0


def graph(spark, pairs, material="m"):
    return gr.simple_edges(spark.createDataFrame([(material, *p) for p in pairs], "material string, a int, b int"), ["material"], "a", "b")


def test_ring_and_complete_graph(spark):
    ring = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (2, 1)])
    assert {tuple(r) for r in gr.three_cycles(ring, ["material"]).select("n3").collect()} == {(0,)}
    assert {tuple(r) for r in gr.four_cycles(ring, ["material"]).select("n4", "n4_halved").collect()} == {(1, 0)}
    row = gr.graph_summary(ring, ["material"]).first()
    assert (row["betti1"], row["components"]) == (1, 1)
    assert gr.path_lengths(ring, ["material"]).first()["diameter"] == 2
    k4 = graph(spark, [(a, b) for a in range(4) for b in range(a)])
    assert {tuple(r) for r in gr.three_cycles(k4, ["material"]).select("n3").collect()} == {(2,)}
    assert gr.wedges(k4, ["material"]).count() == 4 and gr.graph_summary(k4, ["material"]).first()["density"] == 1
    assert math.isclose(gr.spectral_entropy(k4, ["material"]).first()["spectral_entropy"], math.log2(3))


def test_components_of_a_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u int, v int")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert got[40] == 0 and got[101] == 100 and len(got) == 43
    assert components(chain.limit(0)).count() == 0


def test_spanning_forest_and_persistence(spark):
    e = spark.createDataFrame([("m", 1, 2, 1.0), ("m", 2, 3, 2.0), ("m", 1, 3, 2.5), ("m", 4, 5, 9.0)], "material string, u int, v int, w double")
    assert sorted(r["w"] for r in gr.spanning_forest(e, ["material"], "w").collect()) == [1.0, 2.0, 9.0]
    row = gr.h0_persistence(e, spark.createDataFrame([("m",), ("lonely",)], "material string"), ["material"], "w", 6.0)
    got = {r["material"]: (r["max_death"], r["death_std"]) for r in row.collect()}
    assert got == {"m": (2.0, 0.5), "lonely": (0.0, 0.0)}


def test_relabelling_keeps_the_graph_hash(spark):
    names = {1: 30, 2: 10, 3: 20, 4: 40}
    pairs = [(1, 2), (2, 3), (3, 4), (1, 3)]
    a, b = graph(spark, pairs), graph(spark, [(names[x], names[y]) for x, y in pairs])
    n = spark.createDataFrame([("m", i, "C") for i in (1, 2, 3, 4, 10, 20, 30, 40)], "material string, node int, label string")
    h = [gr.wl_hash(e, n.where(c), ["material"], "label").first()["wl_hash"] for e, c in ((a, "node < 10"), (b, "node >= 10"))]
    assert h[0] == h[1] and len(h[0]) == 32


def test_periodic_neighbours_and_skewed_images(spark):
    sites = spark.createDataFrame([("m", 0, [0.05, 0.0, 0.0]), ("m", 1, [0.95, 0.0, 0.0])], "material string, site int, frac array<double>")
    cells = spark.createDataFrame([("m", [4.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0])], "material string, cell array<double>")
    got = s.periodic_range_join(sites, cells, 1.0).collect()
    assert sorted((r["center"], r["nbr"]) for r in got) == [(0, 1), (1, 0)] and all(math.isclose(r["distance"], 0.4) for r in got)
    skewed = spark.createDataFrame([([0.4, 0.4, 0.0], [-0.05, -0.05, 0.0], [4.0, 0.0, 0.0, 2.0, 2 * math.sqrt(3), 0.0, 0.0, 0.0, 4.0])], "frac_u array<double>, frac_v array<double>, cell array<double>")
    cell = np.array([[4, 0, 0], [2, 2 * math.sqrt(3), 0], [0, 0, 4]])
    best = min(np.linalg.norm((np.array([-0.45, -0.45, 0]) + (i, j, k)) @ cell) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
    assert math.isclose(s.minimum_image(skewed, skewed=True).first()["distance"], best)


def field(spark, f, n=4):
    return spark.createDataFrame([("m", i, j, k, float(f(i, j, k))) for i in range(n) for j in range(n) for k in range(n)], "material string, i int, j int, k int, value double")


def test_linear_field(spark):
    grid = field(spark, lambda i, j, k: i / 4 + 2 * j / 4)
    points = spark.createDataFrame([("m", 0, 0.3, 0.2, 0.1), ("m", 1, 0.9, 0.0, 0.0), ("m", 2, 1.3, 0.2, 0.1)], "material string, point int, x double, y double, z double")
    got = {r["point"]: r["value"] for r in gd.sampled(points, grid, (4, 4, 4), ["material"], "point").collect()}
    assert math.isclose(got[0], 0.7) and math.isclose(got[1], 0.75, abs_tol=1e-8) and math.isclose(got[2], got[0])
    inner = gd.laplacian(grid, ["material"]).where("i between 1 and 2 and j between 1 and 2")
    assert inner.agg(F.max(F.abs("laplacian"))).first()[0] < 1e-12
    assert gd.laplacian(grid, ["material"]).where("i = 0 and j = 1").first()["laplacian"] != 0
    g = gd.gradient(grid, (4, 4, 4), ["material"]).agg(F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy"), F.max(F.abs("gz"))).first()
    assert np.allclose(g, (1, 1, 2, 2, 0))
    assert gd.sampled(points, grid.where("i > 0"), (4, 4, 4), ["material"], "point").where("point = 0").first()["value"] is not None


def test_series(spark):
    two = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0)], "k int, x double, y double")
    at = lambda b: se.integral(two, ["k"], "x", "y", F.lit(b)).first()["integral"]
    assert at(1.0) == 2 and at(0.5) == 0
    value = lambda b: se.value_at(two, ["k"], "x", "y", F.lit(b)).first()["value"]
    assert value(0.25) == 1.5 and value(-1.0) == 1 and value(9.0) == 3
    rows = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(6)], "k int, x double, y double")
    fold = 0.0
    for i in range(1, 6):
        fold = fold * 0.9 + 0.1 * i * i
    assert math.isclose(se.moving_average(rows, ["k"], "x", "y", 0.9).first()["average"], fold)
    assert se.autocorrelation(two.withColumn("y", F.lit(1.0)), ["k"], "x", "y").first()["autocorrelation"] is None


def test_scalers(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 4, 9)], "a double, b double")
    f = scaling.fit(df, ["a", "b"], "robust").first()
    assert (f["a_shift"], f["a_scale"], f["b_scale"]) == (3.0, 5.25 - 1.75, 1.0)
    with pytest.raises(ValueError):
        scaling.fit(df, ["a"], "unheard")
    holes = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", None)], "k string, a double")
    assert {r["a"] for r in scaling.normalized(holes, ["a"], ["k"], compat=True).collect()} == {0.0}
    assert len({r["a"] for r in scaling.normalized(holes, ["a"], ["k"]).collect()}) == 3


def test_probe_and_leave_one_out_match_refits(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 3))
    y = x @ (1.0, -2.0, 0.5) + 3 + rng.normal(size=12)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(12)], "id int, x array<double>, y double")
    got = {r["id"]: r["test_error"] for r in ev.leave_one_out(df, ["id"], "x", "y").collect()}
    ones = np.column_stack((np.ones(12), x))
    for i in range(12):
        keep = np.arange(12) != i
        w = np.linalg.lstsq(ones[keep], y[keep], rcond=None)[0]
        assert math.isclose(got[i], y[i] - ones[i] @ w, abs_tol=1e-6)
    pcs = np.array([tuple(r) for r in ev.principal_components(df, ["id"], "x").orderBy("id").select("pc1", "pc2").collect()])
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(pcs), np.abs(centred @ vt[:2].T), atol=1e-6)


def test_silhouette_and_cosine(spark):
    pts = [(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [5.0, 0.0], 1), (3, [5.0, 1.0], 1), (4, [50.0, 0.0], 2)]
    df = spark.createDataFrame(pts, "id int, e array<double>, c int")
    got = {r["id"]: r["silhouette"] for r in ev.silhouette(df, df, "id", "e", "c").collect()}
    b = (5 + math.sqrt(26)) / 2
    assert math.isclose(got[0], (b - 1) / b) and got[4] == 0
    cos = {(r[0], r[1]): r[2] for r in ev.cosine_similarity(df, df, "id", "e").collect()}
    assert len(cos) == 25 and cos[0, 1] == 0 and math.isclose(cos[2, 4], 1)


def test_mean_silhouettes_cover_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(6 * (i % 3), 1, 2)], i % 2, i % 3) for i in range(60)] + [(60, [50.0, 50.0], 0, 0)]
    df = spark.createDataFrame(rows, "id int, e array<double>, k2 int, k3 int")
    got = {r["k"]: r for r in ev.mean_silhouettes(df, "id", "e", {2: "k2", 3: "k3"}, block=7).collect()}
    for k in (2, 3):
        want = ev.silhouette(df, df, "id", "e", f"k{k}").agg(F.avg("silhouette")).first()[0]
        assert math.isclose(got[k]["silhouette"], want, abs_tol=1e-9) and got[k]["n"] == 61
    assert got[3]["best"] and not got[2]["best"]


def test_paths(spark):
    line = graph(spark, [(1, 2), (2, 3), (3, 4)])
    assert sorted(r["path"] for r in pa.simple_paths(line, ["material"], 3).collect()) == [[1, 2, 3], [2, 3, 4]]
    assert pa.simple_paths(line, ["material"], 3, per_start=1).count() <= 2
    flat = spark.createDataFrame([("m", 1.0)] * 5, "material string, v double")
    assert pa.histogram_entropy(flat, ["material"], "v").first()["entropy"] == 0
    units = spark.createDataFrame([("m", 12), ("m", 18), ("m", 30)], "material string, n int")
    assert pa.formula_units(units, ["material"], "n").first()["units"] == 6


def test_triangles_skip_missing_sides(spark):
    e = graph(spark, [(1, 2), (2, 3)]).withColumn("w", F.lit(2.0))
    w = gr.wedges(e, ["material"])
    row = tr.edge_statistics(w, e, ["material"], ["w"]).first()
    assert (row["n_sides"], row["sum_w"], row["var_w"]) == (2, 4.0, 0.0)
    assert gr.wedge_centres(w, e, ["material"]).first()["centre"] == 2
    assert tr.side_vectors(w, e.withColumn("f", F.array("w")), ["material"], "f", 1).first()["sides"] == [2.0, 2.0, 0.0]
    n = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 2.0), ("m", 3, 6.0)], "material string, node int, v double")
    got = tr.energy_variance(tr.vertex_statistics(w, n, ["material"], ["v"]), "v").first()
    assert math.isclose(got["vfe_laplacian_variance"], 9 * np.var([1, 2, 6]))
