import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import descriptors as d
from facetry.functions import geometry as g
from facetry.functions import rules
from facetry.functions import tensor as t
from facetry.operators import triangles as tr


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict(recursive=True)


def lit(values):
    return F.array(*[F.lit(float(v)) for v in values])


def random_tensor(seed):
    a = np.random.default_rng(seed).normal(size=(3, 3))
    return a @ a.T


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tensor_algebra_matches_numpy(spark, seed):
    a, b = random_tensor(seed), random_tensor(seed + 10)
    x, y = lit(a.ravel()), lit(b.ravel())
    got = one(spark, e=t.eigenvalues(x), det=t.determinant(x), c=t.frobenius(t.commutator(x, y)), al=t.alignment(x, y), an=t.anisotropy(x), p=t.principal_direction(x), inv=g.inverse(x))
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(got["e"], values[::-1], atol=1e-7)
    assert math.isclose(got["det"], np.linalg.det(a), rel_tol=1e-9)
    assert math.isclose(got["c"], np.linalg.norm(a @ b - b @ a), rel_tol=1e-9)
    assert math.isclose(got["al"], np.trace(a.T @ b) / np.linalg.norm(a) / np.linalg.norm(b), rel_tol=1e-9)
    lam = values
    assert math.isclose(got["an"], math.sqrt(((lam[:, None] - lam) ** 2).sum() / 2 / (2 * lam.sum() ** 2)), rel_tol=1e-7)
    assert abs(np.dot(got["p"], vectors[:, 2])) > 1 - 1e-6
    assert np.allclose(np.array(got["inv"]).reshape(3, 3), np.linalg.inv(a))


def test_equilateral_and_flat_triangles(spark):
    flat = [lit(p) for p in ((0, 0, 0), (1, 0, 0), (2, 0, 0))]
    even = [lit(p) for p in ((0, 0, 0), (1, 0, 0), (0.5, math.sqrt(3) / 2, 0))]
    got = one(spark, a=g.triangle(*even), b=g.triangle(*flat), n=d.normal_projection([lit(np.eye(3).ravel())] * 3, *flat), flow=d.stress_flow(*even, F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert math.isclose(got["a"]["area"], math.sqrt(3) / 4)
    assert math.isclose(got["a"]["shape_factor"], 1) and abs(got["a"]["angle_variance"]) < 1e-12
    assert math.isclose(got["a"]["sphericity"], 0.5) and math.isclose(got["a"]["circumradius2"], 1 / 3)
    assert got["b"]["area"] == 0 and got["b"]["shape_factor"] == 0 and got["n"] is None
    assert abs(got["flow"]) < 1e-12


def test_stress_flows_are_compiled_and_equal_the_sum_of_normals(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, x)) for x in rng.normal(size=(100, 9))] + [(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0), (1.0,) * 9]
    df = spark.createDataFrame([(n, *x) for n, x in enumerate(rows)] + [(-1, None, *rows[0][1:])], "id int, " + ", ".join(f"{c}{v} double" for v in "ijk" for c in "xyz"))
    found = tr.stress_flows(df, {"closed": None, "flow": (1.0, 2.0, 3.0)})
    p = [g.vec(*[f"{c}{v}" for c in "xyz"]) for v in "ijk"]
    got = {x["id"]: x for x in found.withColumn("want", d.stress_flow(*p, F.lit(1.0), F.lit(2.0), F.lit(3.0))).collect()}
    assert "transform" not in found._jdf.queryExecution().toString()
    assert got[-1]["flow"] is None and got[-1]["area"] is None and len(got) == 103
    assert all(math.isclose(x["flow"], x["want"], abs_tol=1e-9) and abs(x["closed"]) < 1e-9 for n, x in got.items() if n >= 0)
    assert got[100]["flow"] == got[101]["flow"] == 0


def test_axis_alignment_is_compiled_and_equals_the_commutator(spark):
    """Nothing is interpreted row by row (no higher-order function); nulls stay null, zero vectors give 1."""
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, x)) for x in rng.normal(size=(200, 6))] + [(0.0,) * 3 + (1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, x double, y double, z double")
    u, v = g.vec("a", "b", "c"), g.vec("x", "y", "z")
    by_definition = F.exp(-t.frobenius(t.commutator(t.lie_generator(u), t.lie_generator(v))))
    got = df.select(d.axis_alignment(u, v).alias("got"), by_definition.alias("want"))
    assert "transform" not in df.select(d.axis_alignment(u, v))._jdf.queryExecution().toString() and all(math.isclose(r["got"], r["want"]) for r in got.collect())
    assert one(spark, x=d.axis_alignment(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0)), lit((1, 0, 0))))["x"] is None


def test_generators_and_degenerate_inputs(spark):
    zero, v = lit((0, 0, 0)), lit((1, 2, 2))
    got = one(spark, n=t.lie_norm(t.skew(v)), a=t.principal_angle(t.skew(v)), z=t.frobenius(t.skew(zero)), u=g.unit(zero), ang=g.angle(zero, v), al=t.alignment(lit([0] * 9), lit([1] * 9)), bad=t.lie_norm(lit([1] * 9)))
    assert math.isclose(got["n"], math.sqrt(2) * got["a"]) and math.isclose(got["a"], 3)
    assert got["z"] == 0 and got["u"] == [0, 0, 0] and got["ang"] is None and got["al"] is None and got["bad"] is None


def test_cell_round_trip(spark):
    cell = g.lattice(F.lit(4.0), F.lit(5.0), F.lit(6.0), F.lit(80.0), F.lit(95.0), F.lit(60.0))
    got = one(spark, c=cell, back=g.cart_to_frac(cell, g.frac_to_cart(cell, lit((0.1, 0.7, 0.4)))))
    rows = np.array(got["c"]).reshape(3, 3)
    lengths = np.linalg.norm(rows, axis=1)
    assert np.allclose(lengths, (4, 5, 6)) and np.allclose(got["back"], (0.1, 0.7, 0.4))
    assert math.isclose(math.degrees(math.acos(rows[0] @ rows[1] / 20)), 60)


def test_solid_angle_of_an_octant(spark):
    axes = [lit(p) for p in np.eye(3)]
    got = one(spark, s=g.solid_angle(*axes), z=g.solid_angle(axes[0], axes[1], lit((0, 0, 0))))
    assert math.isclose(got["s"], math.pi / 2) and got["z"] == 0


@pytest.mark.parametrize("label, number", [("6", 6), ("VI", 6), ("ivsq", 4), ("IVPY", 4), ("XIII", 13), ("VIIIhb", 8), ("zzXIIzz", 12), ("??", None), (None, None)])
def test_coordination_labels(spark, label, number):
    assert one(spark, n=rules.coordination_number(F.lit(label).cast("string")))["n"] == number


def test_d_rules(spark):
    rows = {r["z"]: r for r in spark.range(1, 119).select(F.col("id").alias("z"), rules.d_class(F.col("id")).alias("c"), rules.d_relevant(F.col("id")).alias("r")).collect()}
    assert rows[20]["c"]["orbital_type"] == "too_high_energy" and rows[22]["c"]["energy_level"] == "valence"
    assert rows[37]["c"]["orbital_type"] == "filled_d_sublayer" and rows[88]["c"]["orbital_type"] == "post_transition_d"
    assert rows[57]["c"]["orbital_type"] is None and rows[82]["r"] and not rows[90]["r"] and rows[104]["r"]


def test_missing_chemical_attributes(spark):
    got = one(spark, v=rules.chemical_vector({"electronegativity": F.lit(9.0), "covalent_radius": F.lit(100.0)}))["v"]
    assert got[0] == 1 and got[2] == 0.5 and math.isclose(got[5], 0.9 / 59.9)
