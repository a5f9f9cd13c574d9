"""0-simplex queries. Binding: an order is a site, its line items are its neighbours (a bag): vector
(quantity / 10, price / 10000, discount * 10), kind = return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import descriptors as d
from facetry.functions import geometry as g
from facetry.functions import rules
from facetry.functions import tensor as t
from facetry.operators import matching as mt
from facetry.operators import sites as s
from facetry.plans.registry import query
from facetry.session import table

NB = """nb AS (SELECT l_orderkey AS center, l_returnflag AS element, l_partkey, l_tax, x, y, z, sqrt(x*x + y*y + z*z) AS d FROM
    (SELECT *, l_quantity / 10 AS x, l_extendedprice / 10000 AS y, l_discount * 10 AS z FROM lineitem))"""
SITE = """site AS (SELECT center, sum(x*x) AS xx, sum(y*y) AS yy, sum(z*z) AS zz, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*z) AS yz, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz,
    count(*) AS n, avg(d) AS md, stddev_pop(d) AS sd, sum(d*d) AS dd, count(DISTINCT element) AS kinds FROM nb GROUP BY center)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("center"), F.col("l_returnflag").alias("element"), "l_linenumber", "l_partkey", "l_tax", x.alias("x"), y.alias("y"), z.alias("z"), F.sqrt(x * x + y * y + z * z).alias("d"))


def r(c, name: str, digits: int = 6):
    return (F.round(c, digits) + 0.0).alias(name)


def near(c, name: str):
    """As ``r``, of numbers from 0 on, by plain arithmetic: ``round`` makes a decimal number of every row."""
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(name)


@query("a1_structure_tensor", f"WITH {NB}, {SITE} SELECT center, round(xx, 7) AS t00, round(xy, 7) AS t01, round(xz, 7) AS t02, round(yy, 7) AS t11, round(yz, 7) AS t12, round(zz, 7) AS t22 FROM site")
def a1(spark, sf_dir):
    tensor = F.col("tensor")
    return s.structure_tensors(neighbours(spark, sf_dir), ["center"]).select("center", *[r(tensor[i], n, 7) for i, n in ((0, "t00"), (1, "t01"), (2, "t02"), (4, "t11"), (5, "t12"), (8, "t22"))])


@query("a2_weighted_tensor_trace", f"WITH {NB} SELECT center, round(sum(abs(l_tax) * d * d), 6) AS charge_weighted_size FROM nb GROUP BY center")
def a2(spark, sf_dir):
    w = F.coalesce(F.abs(F.col("l_tax")), F.lit(1.0))
    return s.structure_tensors(neighbours(spark, sf_dir), ["center"], w).select("center", r(t.trace(F.col("tensor")), "charge_weighted_size"))


@query("a3_asymmetry", f"WITH {NB}, {SITE} SELECT center, round(sx, 6) AS ax, round(sy, 6) AS ay, round(sz, 6) AS az, round(sx*sx + sy*sy + sz*sz, 5) AS norm_sq FROM site")
def a3(spark, sf_dir):
    a = F.col("asymmetry")
    return s.site_geometry(neighbours(spark, sf_dir), ["center"]).select("center", r(a[0], "ax"), r(a[1], "ay"), r(a[2], "az"), r(F.col("asymmetry_norm_sq"), "norm_sq", 5))


@query("a4_coordination", f"WITH {NB}, a AS (SELECT center, count(*) AS n FROM nb WHERE d < 3 GROUP BY center), b AS (SELECT center, count(*) AS n FROM nb WHERE d < 6 GROUP BY center), c AS (SELECT center, count(*) AS n FROM nb GROUP BY center) SELECT c.center, coalesce(a.n, b.n, c.n) AS coordination FROM c LEFT JOIN b ON b.center = c.center LEFT JOIN a ON a.center = c.center")
def a4(spark, sf_dir):
    n = neighbours(spark, sf_dir)
    return s.first_coordination(n.where("d < 3"), n.where("d < 6"), n, keys=["center"])


@query("a5_a6_distortion", f"WITH {NB}, {SITE} SELECT center, round(CASE WHEN n < 2 THEN 0 ELSE sd / md END, 6) AS distortion, round(dd / n, 6) AS mean_squared_distance, round((xx + yy + zz) / n - dd / n, 6) + 0.0 AS trace_identity FROM site")
def a5(spark, sf_dir):
    return s.site_geometry(neighbours(spark, sf_dir), ["center"]).select("center", r(F.col("distortion"), "distortion"), r(F.col("mean_squared_distance"), "mean_squared_distance"), r(t.trace(F.col("tensor")) / F.col("coordination") - F.col("mean_squared_distance"), "trace_identity"))


ENTROPY = "env AS (SELECT center, -sum(p * log2(p)) + 0.0 AS entropy FROM (SELECT center, count(*) / sum(count(*)) OVER (PARTITION BY center) AS p FROM nb GROUP BY center, element, floor(d)) GROUP BY center)"


@query("a7_environment_entropy", f"WITH {NB}, {ENTROPY} SELECT center, round(entropy, 6) + 0.0 AS entropy FROM env")
def a7(spark, sf_dir):
    return s.bag_entropy(neighbours(spark, sf_dir), ["center"], F.col("element"), F.floor("d")).select("center", r(F.col("entropy"), "entropy"))


@query("a8_bond_valence", f"WITH {NB}, p AS (SELECT l_returnflag AS element, avg(l_quantity) / 10 AS r0, 0.37 + count(DISTINCT l_linenumber) AS b FROM lineitem GROUP BY l_returnflag) SELECT center, round(sum(exp((r0 - d) / b)), 6) AS bond_valence_sum FROM nb JOIN p USING (element) GROUP BY center")
def a8(spark, sf_dir):
    parameters = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("element")).agg((F.avg("l_quantity") / 10).alias("r0"), (F.lit(0.37) + F.countDistinct("l_linenumber")).alias("b"))
    return s.bond_valence(neighbours(spark, sf_dir), parameters, ["center"], ["element"]).select("center", r(F.col("bond_valence_sum"), "bond_valence_sum"))


@query("a9_symmetry_fallback", f"WITH {NB}, {SITE} SELECT center, round(1 + CASE WHEN n < 2 THEN 0 ELSE sd / md END + kinds / n, 6) AS symmetry FROM site")
def a9(spark, sf_dir):
    return s.site_geometry(neighbours(spark, sf_dir), ["center"]).select("center", r(F.col("symmetry_fallback"), "symmetry"))


@query("m7_tensor_invariants", f"WITH {NB}, {SITE} SELECT center, round(xx + yy + zz, 6) AS trace, round(xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz), 3) + 0.0 AS determinant, round(sqrt(xx*xx + yy*yy + zz*zz + 2*(xy*xy + xz*xz + yz*yz)), 6) AS frobenius FROM site")
def m7(spark, sf_dir):
    x = F.col("tensor")
    return s.structure_tensors(neighbours(spark, sf_dir), ["center"]).select("center", r(t.trace(x), "trace"), r(t.determinant(x), "determinant", 3), r(t.frobenius(x), "frobenius"))


EIGEN = """q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM site), p AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q),
    f AS (SELECT *, CASE WHEN p > 1e-150 THEN ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (p*p*p) / 2 ELSE 0 END AS h FROM p),
    e AS (SELECT *, q + 2*p*cos(acos(greatest(-1, least(1, h))) / 3) AS e1, q + 2*p*cos(acos(greatest(-1, least(1, h))) / 3 + 2*pi()/3) AS e3 FROM f)"""
# The longest cross product of two rows of T - e1 I, by its length.
DIRECTION = """c AS (SELECT *, unnest([{'x': xy*yz - xz*(yy-e1), 'y': xz*xy - (xx-e1)*yz, 'z': (xx-e1)*(yy-e1) - xy*xy},
        {'x': xy*(zz-e1) - xz*yz, 'y': xz*xz - (xx-e1)*(zz-e1), 'z': (xx-e1)*yz - xy*xz},
        {'x': (yy-e1)*(zz-e1) - yz*yz, 'y': yz*xz - xy*(zz-e1), 'z': xy*yz - (yy-e1)*xz}]) AS c FROM e),
    v AS (SELECT * FROM (SELECT *, sqrt(c.x*c.x + c.y*c.y + c.z*c.z) AS len FROM c) QUALIFY row_number() OVER (PARTITION BY center ORDER BY len DESC) = 1)"""


@query("m8_eigenvalues", f"""WITH {NB}, {SITE}, {EIGEN}
    SELECT center, round(e1, 4) AS e1, round(3*q - e1 - e3, 4) + 0.0 AS e2, round(e3, 4) + 0.0 AS e3, round(((e1-q)*(e1-q) + (2*q-e1-e3)*(2*q-e1-e3) + (e3-q)*(e3-q)) / 3, 3) AS variance FROM e""")
def m8(spark, sf_dir):
    e, q = F.col("e"), t.trace(F.col("tensor")) / 3
    variance = sum((e[i] - q) ** 2 for i in range(3)) / 3
    return s.structure_tensors(neighbours(spark, sf_dir), ["center"]).withColumn("e", t.eigenvalues(F.col("tensor"))).select("center", r(e[0], "e1", 4), r(e[1], "e2", 4), r(e[2], "e3", 4), r(variance, "variance", 3))


ANISO = "sqrt(greatest(0, 1.5 * (xx*xx + yy*yy + zz*zz + 2*(xy*xy + xz*xz + yz*yz)) / ((xx+yy+zz)*(xx+yy+zz)) - 0.5))"


@query("m9_anisotropy", f"WITH {NB}, {SITE} SELECT center, round(CASE WHEN xx+yy+zz > 1e-12 THEN {ANISO} ELSE 0 END, 6) AS anisotropy FROM site")
def m9(spark, sf_dir):
    return s.structure_tensors(neighbours(spark, sf_dir), ["center"]).select("center", r(t.anisotropy(F.col("tensor")), "anisotropy"))


@query("m10_principal_direction", f"WITH {NB}, {SITE}, {EIGEN}, {DIRECTION} SELECT center, round(abs(c.x) / len, 4) AS p0, round(abs(c.y) / len, 4) AS p1, round(abs(c.z) / len, 4) AS p2 FROM v")
def m10(spark, sf_dir):
    v = t.principal_direction(F.col("tensor"))
    return s.structure_tensors(neighbours(spark, sf_dir), ["center"]).select("center", *[F.round(F.abs(v[i]), 4).alias(f"p{i}") for i in range(3)])


@query("m15_lie_invariants", f"WITH {NB}, {SITE} SELECT center, round(sqrt(2), 6) AS generator_norm, round(sqrt(2 * (sx*sx + sy*sy + sz*sz)), 6) AS lie_norm, round(sqrt(sx*sx + sy*sy + sz*sz), 6) AS principal_angle FROM site")
def m15(spark, sf_dir):
    m, u = t.skew(F.col("asymmetry")), t.lie_generator(F.col("asymmetry"))
    return s.site_geometry(neighbours(spark, sf_dir), ["center"]).select("center", r(t.frobenius(u), "generator_norm"), r(t.lie_norm(m), "lie_norm"), r(t.principal_angle(m), "principal_angle"))


@query("m13_structure_chemistry_commutator", f"WITH {NB}, {SITE}, c AS (SELECT *, sx / sqrt(sx*sx+sy*sy+sz*sz) AS a, sy / sqrt(sx*sx+sy*sy+sz*sz) AS b, sz / sqrt(sx*sx+sy*sy+sz*sz) AS c FROM site), m AS (SELECT center, xx*0 + xy*c - xz*b AS p00, xx*(-c) + xz*a AS p01, xx*b - xy*a AS p02, yy*c - yz*b AS p10, -xy*c + yz*a AS p11, xy*b - yy*a AS p12, yz*c - zz*b AS p20, -xz*c + zz*a AS p21, xz*b - yz*a AS p22 FROM c) SELECT center, round(sqrt(4*(p00*p00 + p11*p11 + p22*p22) + 2*((p01+p10)*(p01+p10) + (p02+p20)*(p02+p20) + (p12+p21)*(p12+p21))), 5) AS incompatibility FROM m")
def m13(spark, sf_dir):
    # For symmetric S and skew M: [S, M] = S M + (S M)^T.
    return s.site_geometry(neighbours(spark, sf_dir), ["center"]).select("center", r(t.frobenius(t.commutator(F.col("tensor"), t.lie_generator(F.col("asymmetry")))), "incompatibility", 5))


@query("m20_chemical_vector", "SELECT p_partkey, round(greatest(0, least(1, (p_size / 10.0 - 0.7) / (4.0 - 0.7))), 6) AS v0, round(greatest(0, least(1, (p_retailprice / 10 - 30) / 220)), 6) AS v1, 0.5 AS v2, round(greatest(0, least(1, (p_size * 5 + 50) / 400.0)), 6) AS v3, round(greatest(0, least(1, (CASE WHEN p_size % 7 <> 0 THEN p_size ELSE NULL END - 5) / 65.0)), 6) AS v4_raw, round(greatest(0, least(1, (power(p_retailprice / 10 / 100.0, 3) - 0.1) / 59.9)), 6) AS v5, round(greatest(0, least(1, (p_size % 11 - 3 + 3.0) / 11.0)), 6) AS v6 FROM part".replace("round(greatest(0, least(1, (CASE WHEN p_size % 7 <> 0 THEN p_size ELSE NULL END - 5) / 65.0)), 6) AS v4_raw", "CASE WHEN p_size % 7 = 0 THEN 0.5 ELSE round(greatest(0, least(1, (p_size - 5) / 65.0)), 6) END AS v4"))
def m20(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    v = rules.chemical_vector({"electronegativity": size / 10.0, "covalent_radius": price / 10, "electron_affinity": (size * 5).cast("double"), "atomic_volume": F.when(size % 7 != 0, size.cast("double")), "effective_charge": (size % 11 - 3).cast("double")})
    return table(spark, sf_dir, "part").withColumn("v", v).select("p_partkey", *[r(F.col("v")[i], f"v{i}") for i in range(7)])


FREE = f"""WITH {NB}, {SITE}, {ENTROPY}, f AS (SELECT center, n, round(CASE WHEN n < 2 THEN 0 ELSE sd / md END + {ANISO} + abs(n - 4) - (1 - 1 / n) * entropy, 6) AS free_energy, round(sx*sx + sy*sy + sz*sz, 4) AS asymmetry_norm_sq FROM site JOIN env USING (center))"""


def site_energy(spark, sf_dir):
    n = neighbours(spark, sf_dir)
    both = s.site_geometry(n, ["center"]).join(s.bag_entropy(n, ["center"], F.col("element"), F.floor("d")), "center")
    energy = d.free_energy(F.col("distortion"), t.anisotropy(F.col("tensor")), F.col("coordination") - 4, 1 / F.col("coordination"), F.col("entropy"))
    return both.select("center", F.col("coordination").alias("n"), r(energy, "free_energy"), r(F.col("asymmetry_norm_sq"), "asymmetry_norm_sq", 4))


@query("m21_free_energy", f"{FREE} SELECT * FROM f")
def m21(spark, sf_dir):
    return site_energy(spark, sf_dir)


@query("f0_site_free_energy", f"{FREE} SELECT * FROM f ORDER BY free_energy DESC, center LIMIT 20")
def f0(spark, sf_dir):
    return site_energy(spark, sf_dir).orderBy(F.desc("free_energy"), "center").limit(20)


@query("m22_m23_quotient_elf", f"WITH {NB}, {SITE} SELECT center, round(n / kinds, 6) AS quotient, round((sx*sx + sy*sy + sz*sz) * 0.5 / n, 5) AS elf_asymmetry FROM site")
def m22(spark, sf_dir):
    n = neighbours(spark, sf_dir)
    kinds = n.groupBy("center").agg(F.countDistinct("element").alias("kinds"))
    return s.site_geometry(n, ["center"]).join(kinds, "center").select("center", r(g.safe_div(F.col("coordination"), F.col("kinds"), 1.0), "quotient"), r(F.col("asymmetry_norm_sq") * 0.5 / F.col("coordination"), "elf_asymmetry", 5))


@query("j7_nearest_match", """WITH t AS (SELECT p_brand, p_type, min(p_retailprice) AS low FROM part GROUP BY p_brand, p_type), c AS (SELECT a.p_brand, a.p_partkey, b.p_type, abs(a.p_retailprice - b.low) AS gap, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.low), b.p_type) AS k FROM part a JOIN t b ON a.p_brand = b.p_brand)
    SELECT p_brand, p_partkey, p_type, round(gap, 4) AS gap FROM c WHERE k = 1""")
def j7(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    types = part.groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("low"))
    got = s.nearest_match(part.select("p_brand", "p_partkey", "p_retailprice"), types, ["p_brand"], ["p_partkey"], F.abs(F.col("p_retailprice") - F.col("low")), [F.col("p_type")])
    return got.select("p_brand", "p_partkey", "p_type", r(F.col("gap"), "gap", 4))


@query("j8_range_join", "SELECT a.p_brand, a.p_partkey AS center, b.p_partkey AS nbr, round(sqrt((a.p_size-b.p_size)*(a.p_size-b.p_size) + (a.p_retailprice-b.p_retailprice)*(a.p_retailprice-b.p_retailprice)), 6) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE (a.p_size-b.p_size)*(a.p_size-b.p_size) + (a.p_retailprice-b.p_retailprice)*(a.p_retailprice-b.p_retailprice) <= 36.0")
def j8(spark, sf_dir):
    return s.range_join(table(spark, sf_dir, "part"), 6.0, ["p_brand"], "p_partkey", ("p_size", "p_retailprice")).select("p_brand", "center", "nbr", near(F.col("distance"), "distance"))


@query("j8_periodic_range_join", """WITH p AS (SELECT p_brand, p_partkey, p_partkey % 7 / 7 AS fx, p_size / 50 - floor(p_size / 50) AS fy, p_partkey % 11 / 11 AS fz FROM part),
    m AS (SELECT a.p_brand, a.p_partkey AS center, b.p_partkey AS nbr, i, j, k, 3 * (b.fx + i - a.fx) + 2 * (b.fy + j - a.fy) AS x, 8 * (b.fy + j - a.fy) AS y, 9 * (b.fz + k - a.fz) AS z FROM p a JOIN p b ON a.p_brand = b.p_brand, range(-2, 3) s(i), range(-1, 2) t(j), range(-1, 2) u(k))
    SELECT p_brand, center, nbr, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(sqrt(x*x + y*y + z*z), 6) AS distance FROM m WHERE sqrt(x*x + y*y + z*z) <= 4.0003 AND NOT (center = nbr AND i = 0 AND j = 0 AND k = 0)""")
def j8_periodic(spark, sf_dir):
    """Parts of a brand as sites of a skewed cell whose first height is under the radius."""
    part = table(spark, sf_dir, "part")
    frac = g.vec(F.col("p_partkey") % 7 / 7, F.col("p_size") / 50, F.col("p_partkey") % 11 / 11)
    site = part.select("p_brand", F.col("p_partkey").alias("site"), frac.alias("frac"))
    cells = part.select("p_brand").distinct().select("p_brand", F.array(*[F.lit(x) for x in (3.0, 0.0, 0.0, 2.0, 8.0, 0.0, 0.0, 0.0, 9.0)]).alias("cell"))
    got = s.periodic_range_join(site, cells, 4.0003, keys=("p_brand",))
    return got.select("p_brand", "center", "nbr", *[F.col("image")[i].alias(c) for i, c in enumerate("ijk")], near(F.col("distance"), "distance"))


@query("j9_minimum_image", "WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 7 AS f, l_tax * 11 AS h, l_quantity / 50 AS k FROM lineitem), q AS (SELECT *, f - round_even(f, 0) AS a, h - round_even(h, 0) AS b, k - round_even(k, 0) AS c FROM p) SELECT l_orderkey, l_linenumber, round(sqrt(16*a*a + 25*b*b + 36*c*c), 6) AS distance FROM q")
def j9(spark, sf_dir):
    zero = F.array(*[F.lit(0.0)] * 3)
    cell = F.array(*[F.lit(x) for x in (4.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 6.0)])
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", zero.alias("frac_u"), g.vec(F.col("l_discount") * 7, F.col("l_tax") * 11, F.col("l_quantity") / 50).alias("frac_v"), cell.alias("cell"))
    return s.minimum_image(pairs).select("l_orderkey", "l_linenumber", r(F.col("distance"), "distance"))


@query("j10_rounded_lookup", "WITH k AS (SELECT DISTINCT round(p_retailprice, 0) AS r, 2.5 AS w FROM part WHERE p_size < 10) SELECT c_custkey, coalesce(w, 1.0) AS w FROM customer LEFT JOIN k ON round(c_acctbal, 0) = r")
def j10(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_retailprice").alias("v"), F.lit(2.5).alias("w"))
    return s.rounded_lookup(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), known, ["v"], 0, "w", 1.0).select("c_custkey", "w")


# Points of one sequence lie far apart, so each site's own image is its nearest; where a group lacks a site on one side, nothing is paired.
@query("j11_match_orderings", """WITH l AS (SELECT c_nationkey AS material, c_mktsegment AS f, c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN 0.15 ELSE 0.02 + 0.01 * (c_custkey % 3) END AS shift FROM customer),
    g AS (SELECT material, f, count(*) = count(*) FILTER (WHERE k % 149 <> 0) AS fair FROM l GROUP BY material, f), b AS (SELECT * FROM l JOIN g USING (material, f))
    SELECT material, k AS left_site, CASE WHEN fair THEN k + 1000000 END AS right_site, CASE WHEN fair THEN CAST(round(shift, 6) AS DOUBLE) END AS distance, CASE WHEN fair THEN shift > 0.1 END AS far, CASE WHEN fair THEN k % 29 <> 0 END AS same_element, CASE WHEN fair THEN 'matched' ELSE 'left_only' END AS status FROM b
    UNION ALL SELECT material, NULL, k + 1000000, NULL, NULL, NULL, 'right_only' FROM b WHERE NOT fair AND k % 149 <> 0""")
def j11(spark, sf_dir):
    """Customers of a nation as sites of a periodic cell in two orders: by key, and moved by a little, some over the cell's
    faces and some far, a few with another element, and a few left out."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("material"), k, F.col("c_mktsegment").alias("fingerprint"))
    shift = F.when(k % 50 == 0, 0.15).otherwise(0.02 + 0.01 * (k % 3))
    part = lambda step, extra=0.0: k * step - F.floor(k * step) + extra
    steps = (0.8191725134, 0.6710436067, 0.5497004779)
    cell = F.array(*[F.lit(x) for x in (40.0, 0.0, 0.0, 0.0, 30.0, 0.0, 0.0, 0.0, 20.0)]).alias("cell")
    left = c.select("material", k.alias("site"), "fingerprint", F.col("fingerprint").alias("element"), g.vec(*map(part, steps)).alias("pos"), cell)
    right = c.where(k % 149 != 0).select(
        "material", (k + 1_000_000).alias("site"), "fingerprint", F.when(k % 29 == 0, F.lit("OTHER")).otherwise(F.col("fingerprint")).alias("element"),
        g.vec(g.wrap01(part(steps[0], shift / 40)), part(steps[1]), part(steps[2])).alias("pos"))
    got = mt.match_orderings(left, right, ["material"])
    return got.select("material", "left_site", "right_site", r(F.col("distance"), "distance"), "far", "same_element", "status")


V_SQL = "v AS (SELECT o_orderkey AS center, o_totalprice / 100000 AS x, o_custkey % 7 - 3.0 AS y, o_custkey % 5 - 2.0 AS z FROM orders WHERE o_orderkey % 3 <> 1)"


def external(spark, sf_dir):
    """Skew tensors of two thirds of the sites."""
    v = g.vec(F.col("o_totalprice") / 100000, F.col("o_custkey") % 7 - 3.0, F.col("o_custkey") % 5 - 2.0)
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("center"), t.skew(v).alias("external"))


@query("j6_site_external_tensor", f"""WITH {NB}, {V_SQL} SELECT c.center, v.center IS NOT NULL AS from_external, round(CASE WHEN v.center IS NULL THEN sqrt(2) ELSE sqrt(2 * (x*x + y*y + z*z)) END, 8) AS lie_norm,
    round(CASE WHEN v.center IS NULL THEN 1 ELSE sqrt(x*x + y*y + z*z) END, 8) AS principal_angle FROM (SELECT DISTINCT center FROM nb) c LEFT JOIN v USING (center)""")
def j6(spark, sf_dir):
    """External tensor of a site, else the generator of its structure tensor's principal direction."""
    met = s.with_external(s.structure_tensors(neighbours(spark, sf_dir), ["center"]), external(spark, sf_dir), ["center"])
    return met.select("center", "from_external", r(t.lie_norm(F.col("algebra")), "lie_norm", 8), r(t.principal_angle(F.col("algebra")), "principal_angle", 8))


@query("j6_fallback_incompatibility", f"""WITH {NB}, {SITE}, {EIGEN}, {DIRECTION}, {V_SQL},
    m AS (SELECT w.center, coalesce(v.x, w.c.x / w.len) AS a, coalesce(v.y, w.c.y / w.len) AS b, coalesce(v.z, w.c.z / w.len) AS c FROM (SELECT * EXCLUDE v FROM (SELECT center, c, len, 0 AS v FROM v_)) w LEFT JOIN v USING (center))
    SELECT center, round(sqrt(2) * sqrt((b*3 - c*2)*(b*3 - c*2) + (c*1 - a*3)*(c*1 - a*3) + (a*2 - b*1)*(a*2 - b*1)) / sqrt(14), 3) AS incompatibility FROM m""".replace("    v AS (SELECT * FROM (SELECT *, sqrt(c.x", "    v_ AS (SELECT * FROM (SELECT *, sqrt(c.x"))
def j6_incompatibility(spark, sf_dir):
    """Commutator of the tensor, external or derived, with the generator of the direction 1, 2, 3."""
    met = s.with_external(s.structure_tensors(neighbours(spark, sf_dir), ["center"]), external(spark, sf_dir), ["center"])
    return met.select("center", r(t.frobenius(t.commutator(F.col("algebra"), t.lie_generator(g.vec(1.0, 2.0, 3.0)))), "incompatibility", 3))


@query("j6_bond_external_tensors", f"""WITH {V_SQL}, b AS (SELECT o_orderkey AS u, o_orderkey + 1 AS v FROM orders)
    SELECT b.u, b.v, p.center IS NOT NULL AS has_u, q.center IS NOT NULL AS has_v, round(sqrt(2) * sqrt((p.y*q.z - p.z*q.y)*(p.y*q.z - p.z*q.y) + (p.z*q.x - p.x*q.z)*(p.z*q.x - p.x*q.z) + (p.x*q.y - p.y*q.x)*(p.x*q.y - p.y*q.x)), 8) AS lie_incompatibility
    FROM b LEFT JOIN v p ON p.center = b.u LEFT JOIN v q ON q.center = b.v""")
def j6_bonds(spark, sf_dir):
    """Bonds between an order and the next number: NULL unless both ends have an external tensor."""
    bonds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("u"), (F.col("o_orderkey") + 1).alias("v"))
    met = s.ends_with_external(bonds, external(spark, sf_dir), [], ["u", "v"], "center")
    return met.select("u", "v", F.col("external_u").isNotNull().alias("has_u"), F.col("external_v").isNotNull().alias("has_v"), r(t.frobenius(t.commutator(F.col("external_u"), F.col("external_v"))), "lie_incompatibility", 8))


@query("j14_element_lookup", "SELECT l.l_orderkey, count(*) AS n, count(p.p_partkey) AS known, round(avg(p.p_size), 6) AS mean_size FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size < 40) p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey")
def j14(spark, sf_dir):
    elements = table(spark, sf_dir, "part").where("p_size < 40").select("p_partkey", "p_size")
    both = table(spark, sf_dir, "lineitem").join(elements, F.col("l_partkey") == F.col("p_partkey"), "left")
    return both.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("p_partkey").alias("known"), r(F.avg("p_size"), "mean_size"))


OPS = "ops AS (SELECT r, (r % 4) AS a, CASE WHEN r >= 4 THEN -1.0 ELSE 1.0 END AS f FROM range(8) t(r))"


def operations(spark, materials: DataFrame, name: str) -> DataFrame:
    """The eight rotations and mirrored rotations about z, as operations of every material."""
    rot = [[1, 0, 0, 1], [0, -1, 1, 0], [-1, 0, 0, -1], [0, 1, -1, 0]]
    rows = [(m[0], m[1], 0, m[2], m[3], 0, 0, 0, f) for f in (1, -1) for m in rot]
    ops = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])
    each = materials.select(F.col(name).alias("material")).distinct().select("material", F.explode(ops).alias("r"))
    return each.select("material", *[F.col("r")[3 * i + j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.lit(0.0).alias(f"t{i}") for i in range(3)])


@query("j17_site_symmetry", f"""WITH {OPS}, p AS (SELECT p_brand AS material, p_partkey AS site, (p_size % 4) / 4.0 AS x, (p_partkey % 2) / 2.0 AS y, (p_partkey % 3) / 2.0 AS z FROM part),
    m AS (SELECT p.*, CASE a WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END - x AS dx, CASE a WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END - y AS dy, f * z - z AS dz FROM p, ops)
    SELECT material, site, count(*) AS "order" FROM m WHERE abs(dx - round(dx)) < 1e-5 AND abs(dy - round(dy)) < 1e-5 AND abs(dz - round(dz)) < 1e-5 GROUP BY material, site""")
def j17(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    site = part.select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("site"), (F.col("p_size") % 4 / 4.0).alias("x"), (F.col("p_partkey") % 2 / 2.0).alias("y"), (F.col("p_partkey") % 3 / 2.0).alias("z"))
    return s.fixed_by(site, operations(spark, part, "p_brand"))


@query("m24_orbit", f"""WITH {OPS}, p AS (SELECT p_brand AS material, p_partkey AS site, (p_size % 3) * 1.0 AS x, (p_partkey % 3) * 1.0 AS y, (p_partkey % 2) * 1.0 AS z FROM part),
    m AS (SELECT p.*, CASE a WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + 0.0 AS u, CASE a WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END + 0.0 AS v, f * z + 0.0 AS w FROM p, ops)
    SELECT site, count(DISTINCT CAST(u AS INT) * 100 + CAST(v AS INT) * 10 + CAST(w AS INT)) AS orbit_size, CAST(8 / count(DISTINCT CAST(u AS INT) * 100 + CAST(v AS INT) * 10 + CAST(w AS INT)) AS BIGINT) AS stabilizer_size FROM m GROUP BY site""")
def m24(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    v = part.select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("site"), (F.col("p_size") % 3 * 1.0).alias("x"), (F.col("p_partkey") % 3 * 1.0).alias("y"), (F.col("p_partkey") % 2 * 1.0).alias("z"))
    return s.orbit(v, operations(spark, part, "p_brand"), ["site"])


@query("a17_tensor_validation", "SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_discount = 0) AS passed, count(*) FILTER (WHERE l_discount <> 0) AS failed, CAST(0 AS BIGINT) AS zero, count(*) AS nonzero, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, CAST(3 AS BIGINT) AS rank FROM lineitem GROUP BY l_returnflag")
def a17(spark, sf_dir):
    m = t.skew(g.vec("l_quantity", F.col("l_extendedprice") / 1000, "l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(*[m[i] + (F.col("l_discount") if i == 0 else F.lit(0.0)) for i in range(9)]).alias("tensor"))
    return s.tensor_validation(rows, ["l_returnflag"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("a18_rank", "SELECT p_brand, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE 2 END AS BIGINT) AS rank FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1")
def a18(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_size").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    many = v.groupBy("p_brand").agg(F.countDistinct("p_size").alias("c")).where("c > 1")
    return s.rank_of(v.join(many, "p_brand", "left_semi"), ["p_brand"])


@query("r5_fingerprint", f"""WITH {NB} SELECT center, sha256('{{"bag":[' || string_agg('{{"element":"' || element || '","d":' || round_even(d, 4) || '}}', ',' ORDER BY element, round_even(d, 4)) || ']}}') AS fingerprint FROM nb GROUP BY center""")
def r5(spark, sf_dir):
    return s.fingerprints(neighbours(spark, sf_dir), ["center"])


D_SQL = """CASE WHEN p_size2 < 21 THEN 'too_high_energy' WHEN p_size2 BETWEEN 21 AND 30 THEN '3d_transition' WHEN p_size2 BETWEEN 39 AND 48 THEN '4d_transition' WHEN p_size2 BETWEEN 72 AND 80 THEN '5d_transition' WHEN p_size2 BETWEEN 81 AND 118 THEN 'post_transition_d' WHEN p_size2 BETWEEN 31 AND 38 OR p_size2 BETWEEN 49 AND 56 OR p_size2 BETWEEN 58 AND 71 THEN 'filled_d_sublayer' END"""
LEVEL_SQL = """CASE WHEN p_size2 BETWEEN 21 AND 30 OR p_size2 BETWEEN 39 AND 48 OR p_size2 BETWEEN 72 AND 80 THEN 'valence' WHEN p_size2 BETWEEN 81 AND 118 THEN 'semi_core' WHEN p_size2 BETWEEN 31 AND 38 OR p_size2 BETWEEN 49 AND 56 OR p_size2 BETWEEN 58 AND 71 THEN 'core_like' END"""
Z = "z AS (SELECT p_partkey, p_size, 1 + (p_partkey * 7 + p_size) % 118 AS p_size2 FROM part)"


def atoms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", (1 + (F.col("p_partkey") * 7 + F.col("p_size")) % 118).alias("z"))


@query("p7_p8_d_class", f"WITH {Z} SELECT p_partkey, p_size2 AS z, (p_size2 BETWEEN 21 AND 30 OR p_size2 BETWEEN 39 AND 48 OR p_size2 BETWEEN 72 AND 86 OR p_size2 BETWEEN 104 AND 118) AS relevant, {D_SQL} AS orbital_type, {LEVEL_SQL} AS energy_level, ({LEVEL_SQL} = 'valence' OR p_size2 BETWEEN 81 AND 86) IS TRUE AS physical FROM z")
def p7(spark, sf_dir):
    k = rules.d_class(F.col("z"))
    return atoms(spark, sf_dir).select("p_partkey", "z", rules.d_relevant(F.col("z")).alias("relevant"), k["orbital_type"].alias("orbital_type"), k["energy_level"].alias("energy_level"), F.coalesce(k["physical"], F.lit(False)).alias("physical"))


@query("p9_p10_d_activation", f"""WITH {Z}, c AS (SELECT *, p_size % 9 AS cn, p_size % 2 AS strong, {LEVEL_SQL} AS level FROM z), f AS (SELECT *, level IS NOT NULL AS has, CASE WHEN level IS NOT NULL AND cn >= 4 THEN least(1.0, cn / 8.0) ELSE 0 END AS factor FROM c)
    SELECT p_partkey, (has AND (cn >= 4 OR strong > 0)) AS activated, CAST(factor AS DOUBLE) AS factor, CASE WHEN has AND strong > 0 THEN 'strong' ELSE 'weak' END AS field, CASE WHEN p_size2 IN (35, 53) THEN 'environment_fingerprint' WHEN p_size2 BETWEEN 81 AND 86 THEN 'semi_core_interaction' WHEN factor > 0.5 AND has THEN 'coordination_induced' END AS value_type,
    CAST(CASE WHEN level = 'valence' THEN 1e-3 WHEN p_size2 BETWEEN 81 AND 86 THEN 1e-4 WHEN level = 'semi_core' THEN 5e-3 WHEN level = 'core_like' THEN 1e-2 ELSE 1e-3 END AS DOUBLE) AS threshold FROM f""")
def p9(spark, sf_dir):
    z, a = F.col("z"), rules.d_activation(F.col("z"), F.col("p_size") % 9, F.col("p_size") % 2)
    return atoms(spark, sf_dir).select("p_partkey", a["activated"].alias("activated"), a["factor"].alias("factor"), a["field"].alias("field"), rules.d_value(z, a["factor"])["value_type"].alias("value_type"), rules.density_threshold(z, F.lit("d")).alias("threshold"))


@query("a15_element_relevance", f"WITH {Z} SELECT p_size2 AS z, count(*) AS total, count(*) FILTER (WHERE p_size2 BETWEEN 21 AND 30 OR p_size2 BETWEEN 39 AND 48 OR p_size2 BETWEEN 72 AND 86 OR p_size2 BETWEEN 104 AND 118) AS relevant FROM z GROUP BY p_size2")
def a15(spark, sf_dir):
    return atoms(spark, sf_dir).groupBy("z").agg(F.count(F.lit(1)).alias("total"), F.sum(rules.d_relevant(F.col("z")).cast("int")).alias("relevant"))


@query("r1_r2_coordination_labels", "WITH l AS (SELECT p_partkey, p_size % 14 + 1 AS n FROM part), m AS (SELECT *, ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV'][n] AS roman FROM l) SELECT p_partkey, roman, CAST(n AS INTEGER) AS plain, CAST(n AS INTEGER) AS suffixed, CAST(n AS INTEGER) AS digits FROM m")
def r1(spark, sf_dir):
    n = F.col("n")
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 14 + 1).alias("n")).withColumn("roman", rules.roman(n)).select(
        "p_partkey", "roman", rules.coordination_number(F.lower("roman")).alias("plain"), rules.coordination_number(F.concat("roman", F.lit("PY"))).alias("suffixed"), rules.coordination_number(n.cast("string")).alias("digits"))


@query("p12_p11_finite", "SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN l_discount = 0 THEN 1.0 ELSE l_tax / l_discount END), 6) AS ratio FROM lineitem GROUP BY l_orderkey")
def p12(spark, sf_dir):
    ratio = rules.finite(F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(g.safe_div(F.col("l_tax"), F.col("l_discount"), tol=0.0)), 0.0, 1.0, -1.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum(ratio), "ratio"))


@query("p15_net_charge", "WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS e FROM orders GROUP BY o_custkey) SELECT c_custkey, round(CASE WHEN n = 15 THEN c_acctbal - e / 100000 END, 4) AS net FROM customer LEFT JOIN o ON c_custkey = o_custkey")
def p15(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("e"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", r(F.when(F.col("n") == 15, F.col("c_acctbal") - F.col("e") / 100000), "net", 4))
